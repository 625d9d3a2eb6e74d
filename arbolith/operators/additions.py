"""Addition documents applied to a taxonomy: checked, resolved, and appended once.

A taxon whose id is known already (live, alias or retired) is skipped, which makes replaying a
document harmless. Parents are ids or tags of taxa that stand earlier in the same document.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.operators import nested
from arbolith.operators import tree as trees
from arbolith.operators.hierarchy import hierarchy
from arbolith.runtime import materialize
from arbolith.store import Store, name_rows


def known_ids(store) -> DataFrame:
    ids = store.taxa.select("ott_id").union(store.aliases.select(F.col("alias_id").alias("ott_id"))).union(store.deprecated.select("ott_id"))
    return ids.where("ott_id is not null").distinct()


def document_taxa(documents: DataFrame, order: str | None = None) -> DataFrame:
    """(doc_key, doc_order, doc_id, taxon_pos, ott_id, name, rank, parent, parent_tag, tag, sources, flags) of raw documents."""
    parsed = nested.parse_documents(documents)
    position = documents.groupBy("doc_key").agg(F.min(order).alias("doc_order")) if order else documents.select("doc_key", F.col("doc_key").alias("doc_order")).distinct()
    names = parsed.select("doc_key", F.col("id").alias("doc_id"))
    sources = nested.flat_sources(parsed).groupBy("doc_key", "taxon_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_pos", "source"))), lambda s: s["source"]), ",").alias("sources"))
    flags = nested.flat_flags(parsed).groupBy("doc_key", "taxon_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("child_pos", "flag"))), lambda s: s["flag"]).alias("flags"))
    taxa = nested.flat_taxa(parsed).withColumn("ott_id", F.col("ott_id").try_cast("long")).withColumn("parent", F.trim("parent").try_cast("long"))
    return taxa.join(sources, ["doc_key", "taxon_pos"], "left").join(flags, ["doc_key", "taxon_pos"], "left").join(names, "doc_key", "left").join(position, "doc_key", "left")


def judged(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``document_taxa`` with parent_ott_id and status.

    ``known`` (already there: skipped), ``no_id``, ``no_name``, ``no_parent`` (neither id nor tag,
    or a tag that isn't defined earlier in the document by a taxon that isn't skipped),
    ``bad_parent`` (an id that is neither known nor added before), ``repeated`` (the id was added
    by an earlier taxon of these documents), else ``new``.
    """
    seen = rows.join(known.withColumn("there", F.lit(True)), "ott_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    # No window: one id may hold a third of all rows.
    place = F.struct("doc_order", "doc_key", "taxon_pos")
    first = rows.where("ott_id is not null").groupBy("ott_id").agg(F.min(place).alias("first_place"))
    turn = F.when(place == F.col("first_place"), 1).when(F.col("ott_id").isNotNull(), 2)
    seen = materialize(seen.join(first, "ott_id", "left").withColumn("turn", turn).drop("first_place"))
    tags = seen.where("tag is not null and ott_id is not null and not there").groupBy("doc_key", F.col("tag").alias("parent_tag")).agg(F.min(F.struct("taxon_pos", "ott_id")).alias("t"))
    linked = seen.join(tags, ["doc_key", "parent_tag"], "left").withColumn("by_tag", F.when(F.col("t.taxon_pos") < F.col("taxon_pos"), F.col("t.ott_id")))
    linked = linked.withColumn("parent_ott_id", F.coalesce("parent", "by_tag"))
    added = seen.where("turn = 1 and not there").select(F.col("ott_id").alias("parent_ott_id"), F.struct("doc_order", "doc_key", "taxon_pos").alias("since"))
    linked = linked.join(known.select(F.col("ott_id").alias("parent_ott_id"), F.lit(True).alias("up")), "parent_ott_id", "left").join(added, "parent_ott_id", "left")
    before = F.coalesce(F.col("since") < F.struct("doc_order", "doc_key", "taxon_pos"), F.lit(False))
    status = (
        F.when(F.col("ott_id").isNull(), "no_id")
        .when(F.col("there"), "known")
        .when(F.col("turn") > 1, "repeated")
        .when(F.coalesce("name", F.lit("")) == "", "no_name")
        .when(F.col("parent_ott_id").isNull(), "no_parent")
        .when(F.col("up").isNull() & ~before, "bad_parent")
        .otherwise("new")
    )
    return linked.withColumn("status", status).drop("there", "turn", "t", "by_tag", "up", "since")


def new_taxa(checked: DataFrame) -> DataFrame:
    """Rows to append, in the form of loaded taxa: the source is document:id if the document has an id, else the listed ones."""
    source = F.when(F.col("doc_id").isNotNull(), F.concat_ws(":", "doc_id", F.col("ott_id").cast("string"))).otherwise(F.coalesce("sources", F.lit("")))
    return checked.where("status = 'new'").select(
        "ott_id", "parent_ott_id", "name", F.coalesce("rank", F.lit("")).alias("rank"), source.alias("input_sources"), F.lit("").alias("uniqname"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("flags"),
    )


def apply(store, documents: DataFrame, order: str | None = None, derive: bool = True) -> tuple:
    """(store with the new taxa, the judged rows).

    Tables that the store has derived already are carried on by the branches that grow
    (``GrownStore``), the others are made; both when asked for. Without ``derive`` they stay as they
    are: the new taxa then have no place in paths, contexts and indexes.
    """
    checked = materialize(judged(document_taxa(documents, order), known_ids(store)))
    plain = store.taxa.select("ott_id", "parent_ott_id", "name", "rank", "input_sources", "uniqname", "flags")
    new = materialize(new_taxa(checked))
    parts = (plain.unionByName(new), store._synonyms, store._aliases, store._deprecated, store._metadata, store._roots, store.options)
    if derive:
        return GrownStore(store, new, *parts), checked
    grown = Store(*parts)
    for name in DERIVED:
        if name in store.__dict__:
            setattr(grown, name, store.__dict__[name])
    return grown, checked


#: Tables of a store that are carried on when taxa are added.
DERIVED = ("tree", "pref_tree", "name_index", "source_index")


def _grown_paths(old: DataFrame, edges: DataFrame) -> DataFrame:
    """The path table ``old`` with more taxa (id, parent), each below one of them or of the table or a root.

    Only the new taxa are peeled; their paths go on from those of the taxa they hang on, and what
    stands above them counts them.
    """
    made = hierarchy(edges)
    first = made.withColumn("hung", F.element_at("path", 1))
    tops = edges.select(F.col("id").alias("hung"), F.col("parent").alias("above"))
    stem = old.select(F.col("ott_id").alias("above"), F.col("path").alias("stem"), F.col("root").alias("stem_root"), F.col("depth").alias("stem_depth"))
    none = F.array().cast("array<long>")
    new = materialize(
        first.join(tops, "hung").join(stem, "above", "left").select(
            F.col("id").alias("ott_id"), F.col("parent").alias("parent_ott_id"), F.coalesce("stem_root", "root").alias("root"), (F.col("depth") + F.coalesce(F.col("stem_depth") + 1, F.lit(0))).alias("depth"),
            F.concat(F.coalesce("stem", none), "path").alias("path"), "n_below", "on_ring",
        )
    )
    more = new.select(F.explode(F.slice("path", 1, F.size("path") - 1)).alias("ott_id")).groupBy("ott_id").agg(F.count("*").alias("more"))
    rest = old.join(more, "ott_id", "left").withColumn("n_below", F.col("n_below") + F.coalesce("more", F.lit(0))).select(new.columns)
    return materialize(rest.unionByName(new))


class GrownStore(Store):
    """A store whose derived tables go on from those that ``base`` has made, by the taxa ``new`` (in the loaded form).

    Where a taxon that was an orphan finds its parent among the new ones, the paths are made anew,
    as whole branches move.
    """

    def __init__(self, base: Store, new: DataFrame, *parts) -> None:
        super().__init__(*parts)
        self._base, self._new = base, Store(new, base._synonyms, base._aliases, base._deprecated, None, base._roots)

    @cached_property
    def _moved(self) -> bool:
        added = self._new.taxa.select(F.col("ott_id").alias("parent_ott_id"))
        return trees.orphans(self._base.taxa).join(added, "parent_ott_id", "left_semi").limit(1).count() > 0

    def _carried(self, name: str) -> bool:
        return name in self._base.__dict__ and not (name in ("tree", "pref_tree") and self._moved)

    @cached_property
    def tree(self) -> DataFrame:
        if not self._carried("tree"):
            return Store.tree.func(self)
        return _grown_paths(self._base.tree, self._new.taxa.select(F.col("ott_id").alias("id"), F.col("parent_ott_id").alias("parent")))

    @cached_property
    def pref_tree(self) -> DataFrame:
        if not self._carried("pref_tree"):
            return Store.pref_tree.func(self)
        edge = F.when(~F.col("dubious"), F.col("parent_ott_id"))
        return _grown_paths(self._base.pref_tree, self._new.taxa.select(F.col("ott_id").alias("id"), edge.alias("parent")))

    @cached_property
    def name_index(self) -> DataFrame:
        if not self._carried("name_index"):
            return Store.name_index.func(self)
        more = name_rows(self._new.taxa, self._new.synonyms)
        return materialize(self._base.name_index.unionByName(more).repartitionByRange("key_lc").sortWithinPartitions("key_lc"))

    @cached_property
    def source_index(self) -> DataFrame:
        return self._base.source_index.unionByName(self._new.source_index) if self._carried("source_index") else Store.source_index.func(self)
