"""A taxonomy as tables: what was loaded, and what is derived from it once.

The derived tables hold each taxon's path from the root (by leaf peeling), over all edges and over
preferred ones. Lineages, common ancestors, subtrees, contexts and distances are then filters and
aggregations on paths, without a recursive join at query time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith import schema
from arbolith.functions import taxon
from arbolith.operators.hierarchy import hierarchy
from arbolith.runtime import materialize


#: Tables of a store, loaded and derived ones.
TABLES = ("taxa", "synonyms", "aliases", "deprecated", "metadata", "contexts", "tree", "pref_tree", "name_index", "source_index", "context_members", "least_contexts")


@dataclass(frozen=True)
class LoadOptions:
    """What is loaded and made: names besides a taxon's own, old ids, barrier clades, edges without dubious taxa
    and the index over them, the index of source ids. Ids need no index here, so ``id_index`` changes nothing."""

    synonyms: bool = True
    aliases: bool = True
    deprecated: bool = True
    barriers: bool = True
    preferred_edges: bool = True
    preferred_index: bool = True
    id_index: bool = True
    source_index: bool = True

    def __post_init__(self) -> None:
        if self.preferred_index and not self.preferred_edges:
            raise ValueError("the preferred index needs the preferred edges")

    @property
    def tables(self) -> tuple[str, ...]:
        """The tables of a store that are made under these options."""
        without = () if self.preferred_edges else ("pref_tree", "context_members", "least_contexts")
        return tuple(t for t in TABLES if t not in without and (t != "source_index" or self.source_index))


class Store:
    """Tables of one taxonomy. Loaded tables are DataFrames of the schemas in ``arbolith.schema``.

    ``context_roots`` (name, root_ott_id) places contexts at other roots than the fixed ones.
    Repeated rows count once; synonyms and aliases of unknown ids are kept apart, not joined.
    """

    def __init__(
        self, taxa: DataFrame, synonyms: DataFrame, aliases: DataFrame, deprecated: DataFrame, metadata: DataFrame | None = None, context_roots: DataFrame | None = None,
        options: LoadOptions | None = None,
    ) -> None:
        self.spark: SparkSession = taxa.sparkSession
        self.options = options or LoadOptions()
        self._taxa, self._synonyms, self._aliases, self._deprecated = taxa, synonyms, aliases, deprecated
        self._metadata, self._roots = metadata, context_roots

    # --- loaded tables with derived columns

    @cached_property
    def taxa(self) -> DataFrame:
        flags = F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: f.isNotNull() & (f != ""))
        rows = self._taxa.where("ott_id is not null").distinct()
        made = rows.withColumn("flags", flags).select(
            "ott_id",
            "parent_ott_id",
            "name",
            F.lower("name").alias("name_lc"),
            F.coalesce("rank", F.lit("")).alias("rank"),
            F.coalesce("input_sources", F.lit("")).alias("input_sources"),
            F.coalesce("uniqname", F.lit("")).alias("uniqname"),
            "flags",
            taxon.dubious(F.col("flags")).alias("dubious"),
            taxon.rank_class(F.col("rank")).alias("rank_class"),
            F.col("parent_ott_id").isNull().alias("is_root"),
        )
        return materialize(made)  # nearly every question reads it: repeated rows are dropped once

    @cached_property
    def synonyms(self) -> DataFrame:
        return materialize(self._synonyms.where("name is not null").distinct().withColumn("name_lc", F.lower("name")))

    @cached_property
    def aliases(self) -> DataFrame:
        return materialize(self._aliases.where("alias_id is not null and ott_id is not null").distinct())

    @cached_property
    def deprecated(self) -> DataFrame:
        return materialize(self._deprecated.distinct().withColumn("name_lc", F.lower("name")))

    @cached_property
    def metadata(self) -> DataFrame:
        return self._metadata if self._metadata is not None else self.spark.createDataFrame([], schema.METADATA)

    @cached_property
    def contexts(self) -> DataFrame:
        fixed = schema.contexts(self.spark)
        if self._roots is None:
            return fixed
        moved = self._roots.select("name", F.col("root_ott_id").alias("own_root")).distinct()
        return fixed.join(F.broadcast(moved), "name", "left").withColumn("root_ott_id", F.coalesce("own_root", "root_ott_id")).drop("own_root").select(fixed.columns)

    # --- derived tables

    @cached_property
    def tree(self) -> DataFrame:
        """(ott_id, parent_ott_id, root, depth, path, n_below) over all edges; path starts at the root."""
        return self._paths(self.taxa.select(F.col("ott_id").alias("id"), F.col("parent_ott_id").alias("parent")))

    @cached_property
    def pref_tree(self) -> DataFrame:
        """The same over preferred edges: the edge above a dubious taxon is left out."""
        if not self.options.preferred_edges:
            raise ValueError("the store was loaded without preferred edges")
        hidden = self.taxa.where("dubious").select("ott_id").distinct()
        if not self.tree.where("on_ring").limit(1).count() and not self._several_parents():
            return materialize(cut_paths(self.tree, hidden))
        edge = F.when(~F.col("dubious"), F.col("parent_ott_id"))  # cutting an edge may open a ring, or leave another parent
        return self._paths(self.taxa.select(F.col("ott_id").alias("id"), edge.alias("parent")))

    def _several_parents(self) -> bool:
        twice = self.taxa.groupBy("ott_id").agg(F.count("*").alias("n")).where("n > 1")
        return twice.limit(1).count() > 0

    def _paths(self, edges: DataFrame) -> DataFrame:
        return materialize(
            hierarchy(edges).select(F.col("id").alias("ott_id"), F.col("parent").alias("parent_ott_id"), "root", "depth", "path", "n_below", "on_ring")
        )

    @cached_property
    def name_index(self) -> DataFrame:
        """One row per name key: every index of names is a predicate on it.

        Written in the order of the key, so that lookups read few row groups.
        """
        return materialize(name_rows(self.taxa, self.synonyms).repartitionByRange("key_lc").sortWithinPartitions("key_lc"))

    @cached_property
    def source_index(self) -> DataFrame:
        if not self.options.source_index:
            raise ValueError("the store was loaded without an index of source ids")
        return materialize(self.taxa.select(F.explode(taxon.source_ids(F.col("input_sources"))).alias("source_id"), "ott_id").distinct())

    @cached_property
    def barriers(self) -> DataFrame:
        """(clade, code, root_ott_id) of the barrier clades that are in the store; none if they weren't asked for."""
        from arbolith.operators.tree import resolve_barriers

        found = resolve_barriers(self)
        return found if self.options.barriers else found.limit(0)

    # --- contexts

    @cached_property
    def context_paths(self) -> DataFrame:
        """(ott_id, context, root_depth) of each taxon and each context root on its preferred path."""
        roots = self.contexts.select(F.col("root_ott_id").alias("node"), F.col("name").alias("context"))  # a few dozen rows
        on_path = self.pref_tree.select("ott_id", F.posexplode("path").alias("root_depth", "node"))
        return materialize(on_path.join(F.broadcast(roots), "node").select("ott_id", "context", "root_depth"))

    @cached_property
    def context_members(self) -> DataFrame:
        """(context, ott_id): what lies under each context's root over preferred edges, root included."""
        return self.context_paths.select("context", "ott_id")

    @cached_property
    def least_contexts(self) -> DataFrame:
        """(ott_id, least_context): the context with the nearest root, on a tie the first by name."""
        nearest = self.context_paths.groupBy("ott_id").agg(F.min_by("context", F.struct(-F.col("root_depth"), "context")).alias("least_context"))
        return materialize(nearest)

    def with_metadata(self, **entries: str) -> Store:
        """The same store with entries of its description set (source, author, weburl)."""
        rows = self.metadata if self.metadata.limit(1).count() else self.spark.createDataFrame([(None, None, None)], schema.METADATA)
        return Store(self._taxa, self._synonyms, self._aliases, self._deprecated, rows.withColumns({k: F.lit(v) for k, v in entries.items()}), self._roots, self.options)

    def register(self, prefix: str = "") -> None:
        """The tables as temporary views, for questions in SQL."""
        for name in self.options.tables:
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")

    def save(self, path: str) -> None:
        """All tables as parquet below ``path``; fails if something is there. Each table is written in one job commit."""
        for name in self.options.tables:
            getattr(self, name).write.mode("errorifexists").parquet(f"{path}/{name}")


def cut_paths(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """The path table ``tree``, free of rings, without the edges above the taxa of ``tops`` (ott_id).

    Each path is cut before the last of these taxa on it, which no peeling is needed for; what
    stands below each taxon is counted anew where there was a cut.
    """
    places = tree.select("ott_id", F.posexplode("path").alias("place", "node"))
    cuts = places.join(tops.select(F.col("ott_id").alias("node")), "node", "left_semi").groupBy("ott_id").agg(F.max("place").alias("cut"))
    itself = F.coalesce(F.col("cut") == F.size("path") - 1, F.lit(False))
    cut = materialize(tree.join(cuts, "ott_id", "left").withColumn("itself", itself).withColumn("cut", F.coalesce("cut", F.lit(0))))
    # A taxon loses what was cut off below it: from each of those above the cut, once for each taxon below.
    lost = cut.where("cut > 0").select(F.explode(F.slice("path", F.lit(1), F.col("cut"))).alias("ott_id")).groupBy("ott_id").agg(F.count("*").alias("lost"))
    path = F.slice("path", F.col("cut") + 1, F.size("path"))
    return cut.join(lost, "ott_id", "left").select(
        "ott_id", F.when(~F.col("itself"), F.col("parent_ott_id")).alias("parent_ott_id"), F.when(F.col("cut") > 0, F.get("path", F.col("cut"))).otherwise(F.col("root")).alias("root"),
        (F.col("depth") - F.col("cut")).alias("depth"), path.alias("path"), (F.col("n_below") - F.coalesce("lost", F.lit(0))).alias("n_below"), "on_ring",
    )


def name_rows(taxa: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Rows of the name index for these taxa: their own names and the synonyms they have."""
    about = ("ott_id", "rank", "rank_class", "dubious")
    own = taxa.where("name is not null").select(F.col("name_lc").alias("key_lc"), F.lit("taxon").alias("kind"), "name", *about)
    other = synonyms.join(taxa.select(*about), "ott_id").select(F.col("name_lc").alias("key_lc"), F.lit("synonym").alias("kind"), "name", *about).distinct()
    return own.unionByName(other)


def open_store(spark: SparkSession, path: str, options: LoadOptions | None = None) -> Store:
    """A saved store, its derived tables read instead of made; ``options`` are those it was saved with."""
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    store = Store(table("taxa"), table("synonyms"), table("aliases"), table("deprecated"), table("metadata"), table("contexts").select("name", "root_ott_id"), options)
    for name in store.options.tables:
        setattr(store, name, table(name))
    return store
