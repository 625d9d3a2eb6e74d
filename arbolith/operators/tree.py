"""Questions on the hierarchy, answered from the paths of a store's tree tables.

``tree`` is a store's ``tree`` (all edges) or ``pref_tree`` (preferred edges). Ids come as
DataFrames, many questions at a time; nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbolith import schema
from arbolith.functions import taxon
from arbolith.operators.hierarchy import hierarchy
from arbolith.runtime import materialize

#: Stands after every id in the order of paths.
_LAST = (1 << 63) - 1


def closure(tree: DataFrame) -> DataFrame:
    """(desc_id, anc_id, dist) of each taxon and each on its path, itself with dist 0 included."""
    pairs = F.transform("path", lambda a, i: F.struct(F.col("ott_id").alias("desc_id"), a.alias("anc_id"), (F.size("path") - 1 - i).alias("dist")))
    return tree.select(F.inline(pairs))


def lineage(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(ott_id, anc_id, dist) from the parent (dist 1) to the root; an unknown id has no rows."""
    return closure(tree.join(ids.select("ott_id").distinct(), "ott_id", "left_semi")).where("dist > 0").withColumnRenamed("desc_id", "ott_id")


def children(taxa: DataFrame, ids: DataFrame) -> DataFrame:
    """(parent_ott_id, ott_id) of the direct children, dubious ones included."""
    wanted = ids.select(F.col("ott_id").alias("parent_ott_id")).distinct()
    return taxa.select("parent_ott_id", "ott_id").join(wanted, "parent_ott_id", "left_semi").distinct()


def parents(taxa: DataFrame, ids: DataFrame) -> DataFrame:
    """(ott_id, parent_ott_id) of each id, null for a root."""
    return taxa.select("ott_id", "parent_ott_id").join(ids.select("ott_id").distinct(), "ott_id", "left_semi").distinct()


def descendants(tree: DataFrame, root_id: int) -> DataFrame:
    """The rows of ``tree`` at or below a taxon."""
    return tree.where(F.array_contains("path", F.lit(root_id).cast("long")))


def tips(tree: DataFrame, root_id: int) -> DataFrame:
    """(ott_id) of what has nothing below, at or below a taxon; a tip's only tip is itself."""
    return descendants(tree, root_id).where("n_below = 0").select("ott_id")


def tip_counts(tree: DataFrame) -> DataFrame:
    """(anc_id, n_tips, n_inner): tips and inner taxa at or below each taxon."""
    counts = tree.select(F.explode("path").alias("anc_id"), (F.col("n_below") == 0).alias("tip"))
    return counts.groupBy("anc_id").agg(F.count_if("tip").alias("n_tips"), F.count_if(~F.col("tip")).alias("n_inner"))


def below_members(tree: DataFrame) -> DataFrame:
    """(anc_id, ott_id, is_tip): what stands at or below each taxon, a row each; a tip's only one is itself."""
    return tree.select(F.explode("path").alias("anc_id"), "ott_id", (F.col("n_below") == 0).alias("is_tip"))


def below_sets(tree: DataFrame, most: int = 50_000) -> DataFrame:
    """(ott_id, mrca, nested_mrca): sorted ids of the tips and of the inner taxa at or below each taxon, as two lists.

    A tip's lists are itself and none. As a list stands in one row, a taxon with more than ``most``
    below it is an error when the rows are read; ``below_members`` has the same as rows, for any size.
    """
    kept = tree.select("path", "ott_id", "n_below").withColumn("ott_id", F.when(F.col("n_below") <= most, F.col("ott_id")).otherwise(F.raise_error(F.concat(F.lit("too many below taxon "), F.col("ott_id")))))
    pick = lambda tip: F.array_sort(F.collect_list(F.when(F.col("is_tip") == tip, F.col("ott_id"))))
    return below_members(kept).groupBy(F.col("anc_id").alias("ott_id")).agg(pick(True).alias("mrca"), pick(False).alias("nested_mrca"))


def is_descendant(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ott_id, anc_id, is_descendant) for pairs of ids; each is its own descendant; unknown ids are nobody's."""
    found = pairs.join(tree.select("ott_id", "path"), "ott_id", "left")
    return found.select("ott_id", "anc_id", F.coalesce(F.array_contains("path", F.col("anc_id")), F.lit(False)).alias("is_descendant"))


def mrca(tree: DataFrame, sets: DataFrame, strict: bool = False) -> DataFrame:
    """(set_id, mrca, n_ids, n_used) for rows of (set_id, ott_id).

    The deepest taxon on the paths of all ids. Ids that don't meet the others (below a dubious
    taxon in the preferred tree, or unknown) are left out: the component of most ids counts, on a
    tie that with the smaller root. With ``strict`` the answer is then null. Repeated ids count once.
    """
    asked = sets.select("set_id", "ott_id").distinct()
    found = asked.join(tree.select("ott_id", "root", "path"), "ott_id")
    sizes = found.groupBy("set_id", "root").agg(F.count("*").alias("n"))
    base = sizes.groupBy("set_id").agg(F.min_by(F.struct("root", "n"), F.struct(-F.col("n"), "root")).alias("b")).select("set_id", "b.root", F.col("b.n").alias("n_used"))
    nodes = found.select("set_id", "root", F.posexplode("path").alias("depth", "node"))
    shared = nodes.groupBy("set_id", "root", "node", "depth").agg(F.count("*").alias("n"))
    deepest = shared.join(base, ["set_id", "root"]).where("n = n_used").groupBy("set_id", "n_used").agg(F.max_by("node", "depth").alias("mrca"))
    total = asked.groupBy("set_id").agg(F.count("*").alias("n_ids"))
    out = total.join(deepest, "set_id", "left")
    answer = F.when(F.col("n_used") == F.col("n_ids"), F.col("mrca")) if strict else F.col("mrca")
    return out.select("set_id", answer.alias("mrca"), "n_ids", F.coalesce("n_used", F.lit(0)).alias("n_used"))


def internodal_distance(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, dist, compat_dist) for pairs of ids.

    ``dist`` is the number of edges by way of the common ancestor, null if there is none.
    ``compat_dist`` is the number of nodes before the first common one on the way up from a plus
    the number of all nodes from b to its root, or of all from a if the ways don't meet.
    """
    a = tree.select(F.col("ott_id").alias("id_a"), F.col("path").alias("path_a"))
    b = tree.select(F.col("ott_id").alias("id_b"), F.col("path").alias("path_b"))
    both = pairs.select("id_a", "id_b").distinct().join(a, "id_a").join(b, "id_b")
    common = F.size(F.array_intersect("path_a", "path_b"))
    up = F.size("path_a") - common
    return both.select(
        "id_a",
        "id_b",
        F.when(common > 0, up + F.size("path_b") - common).alias("dist"),
        F.when(common > 0, up + F.size("path_b")).otherwise(F.size("path_a")).alias("compat_dist"),
    )


def path_lengths(tree: DataFrame) -> DataFrame:
    """(ott_id, to_root): edges to the root of its tree, null if its way up has a ring."""
    ringed = tree.where("on_ring").select(F.col("ott_id").alias("start"))
    return tree.select("ott_id", "depth", F.col("path")[0].alias("start")).join(ringed.withColumn("bad", F.lit(True)), "start", "left").select(
        "ott_id", F.when(F.col("bad").isNull(), F.col("depth")).alias("to_root")
    )


def verify(taxa: DataFrame, tree: DataFrame) -> DataFrame:
    """(check_name, n): taxa with several parents, own parents, orphans, on rings, roots."""
    edges = taxa.select("ott_id", "parent_ott_id").distinct()
    several = edges.where("parent_ott_id is not null").groupBy("ott_id").count().where("count > 1")
    known = edges.select(F.col("ott_id").alias("parent_ott_id")).distinct()
    orphan = edges.where("parent_ott_id is not null").join(known, "parent_ott_id", "left_anti")
    checks = {
        "several_parents": several,
        "own_parent": edges.where("ott_id = parent_ott_id"),
        "orphans": orphan,
        "on_rings": tree.where("on_ring"),
        "roots": edges.where("parent_ott_id is null"),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("check_name"), "n") for k, df in checks.items()])


def orphans(taxa: DataFrame) -> DataFrame:
    """(ott_id, parent_ott_id) of taxa whose parent is no taxon."""
    known = taxa.select(F.col("ott_id").alias("parent_ott_id")).distinct()
    return taxa.where("parent_ott_id is not null").select("ott_id", "parent_ott_id").distinct().join(known, "parent_ott_id", "left_anti").select("ott_id", "parent_ott_id")


def genus_members(tree: DataFrame, taxa: DataFrame) -> DataFrame:
    """(genus_ott_id, ott_id): taxa at species rank or below under each genus (over the edges of ``tree``)."""
    specific = taxa.where("rank_class = 'specific'").select("ott_id")
    genera = taxa.where("rank_class = 'genus'").select(F.col("ott_id").alias("genus_ott_id"))
    # Both grow with the taxonomy; packed on disk they look small enough to the planner to be sent through the driver.
    return tree.join(specific.hint("merge"), "ott_id", "left_semi").select("ott_id", F.explode("path").alias("genus_ott_id")).join(genera.hint("merge"), "genus_ott_id", "left_semi")


def taxcodes(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(ott_id, taxcode) by the nearest clade of (root_ott_id, code) at or above each taxon."""
    marked = tree.select("ott_id", F.posexplode("path").alias("depth", "root_ott_id")).join(F.broadcast(roots), "root_ott_id")
    return marked.groupBy("ott_id").agg(F.max_by("code", F.struct("depth", "code")).alias("taxcode"))


def resolve_barriers(store, barriers=schema.BARRIERS, alternatives=schema.BARRIER_ALTERNATIVES) -> DataFrame:
    """(clade, code, root_ott_id): each barrier clade by its name, else another name of it, else a synonym.

    Of several taxa the one nearest the root counts, then the smaller id. Two clades at one taxon
    are an error, which is raised when the rows are read.
    """
    spark = store.spark
    rows = [(n, c, n.lower(), 1) for n, c in barriers] + [(n, c, o.lower(), 2) for n, c in barriers for m, o in alternatives if n == m]
    asked = spark.createDataFrame(rows, "clade string, code string, key_lc string, stage int")
    named = asked.join(store.name_index.where("kind = 'taxon'").select("key_lc", "ott_id"), "key_lc")
    other = asked.join(store.name_index.where("kind = 'synonym'").select("key_lc", "ott_id"), "key_lc").withColumn("stage", F.lit(3))
    hits = named.unionByName(other).join(store.tree.select("ott_id", "depth"), "ott_id")
    best = hits.groupBy("clade", "code").agg(F.min_by("ott_id", F.struct("stage", "depth", "ott_id")).alias("root_ott_id"))
    twice = F.count("*").over(Window.partitionBy("root_ott_id")) > 1
    message = F.concat(F.lit("two barrier clades at taxon "), F.col("root_ott_id").cast("string"))
    return best.withColumn("code", F.when(twice, F.raise_error(message)).otherwise(F.col("code")))


def context_parents(store) -> DataFrame:
    """(context, parent_context): the context whose root is the nearest above each context's root."""
    inside = store.context_paths.select("ott_id", F.col("context").alias("parent_context"), "root_depth")
    own = store.contexts.select(F.col("root_ott_id").alias("ott_id"), F.col("name").alias("context"))
    above = inside.join(F.broadcast(own), "ott_id").where("context <> parent_context")
    return above.groupBy("context").agg(F.max_by("parent_context", "root_depth").alias("parent_context"))


def induced_subtree(tree: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, ott_id, parent_ott_id, is_tip) of the tree that the taxa of each set span.

    Taxa on the ways from the set's common ancestor to its members are kept if two or more of
    their children lead to members, or none; those with one are passed over, members too. The
    parent is the nearest kept taxon above, null at the top. Ids that don't meet are left out.
    """
    tops = mrca(tree, sets).where("mrca is not null").select("set_id", "mrca")
    asked = sets.select("set_id", "ott_id").distinct()
    paths = asked.join(tree.select("ott_id", "path"), "ott_id").join(tops, "set_id").where(F.array_contains("path", F.col("mrca")))
    inside = materialize(paths.select("set_id", F.slice("path", F.array_position("path", F.col("mrca")).cast("int"), F.size("path")).alias("path")))
    links = inside.select("set_id", F.inline(F.transform("path", lambda x, i: F.struct(x.alias("node"), F.get("path", i - 1).alias("above")))))
    links = links.distinct()
    heavy = links.where("above is not null").groupBy("set_id", F.col("above").alias("node")).agg(F.count("*").alias("n"))
    kept = links.select("set_id", "node").distinct().join(heavy, ["set_id", "node"], "left").where("n is null or n > 1")
    kept = materialize(kept.select("set_id", "node", F.col("n").isNull().alias("is_tip")))
    places = inside.select("set_id", "path", F.posexplode("path").alias("place", "node")).join(kept, ["set_id", "node"])
    above = places.select("set_id", "node", "place", "path", "is_tip")
    upper = above.groupBy("set_id", "path").agg(F.sort_array(F.collect_list(F.struct("place", "node", "is_tip"))).alias("chain"))
    pairs = F.transform("chain", lambda x, i: F.struct(x["node"].alias("ott_id"), F.get("chain", i - 1)["node"].alias("parent_ott_id"), x["is_tip"].alias("is_tip")))
    return upper.select("set_id", F.inline(pairs)).distinct()


def newick_pieces(nodes: DataFrame) -> DataFrame:
    """(key, ott_id, piece) of nodes (ott_id, path, label), paths starting at the tree's top: read in the order of key they are its Newick text.

    In the order of paths that end above every id each node stands after its children. An inner
    node's piece closes its children; a leaf's opens the taxa whose first leaf it is, and has a
    comma before those that aren't first children. Nothing is gathered or sorted.
    """
    above = F.element_at("path", -2)
    first = nodes.where("size(path) > 1").groupBy(above.alias("up")).agg(F.min("ott_id").alias("node")).select("node", F.lit(True).alias("first"))
    inner = nodes.where("size(path) > 1").select(above.alias("ott_id")).distinct().withColumn("inner", F.lit(True))
    marked = nodes.join(inner, "ott_id", "left")
    # How many of the lowest taxa on a leaf's way up are first children, without a break: what it opens.
    ways = marked.where("inner is null").select("ott_id", F.posexplode("path").alias("place", "node")).where("place > 0")
    breaks = ways.join(first, "node", "left").where("first is null").groupBy("ott_id").agg(F.max("place").alias("last"))
    opened = F.size("path") - 1 - F.coalesce("last", F.lit(0))
    start = F.concat(F.when(F.col("last").isNotNull(), F.lit(",")).otherwise(""), F.repeat(F.lit("("), opened))
    piece = F.concat(F.when(F.col("inner"), F.lit(")")).otherwise(start), F.col("label"), F.when(F.size("path") == 1, F.lit(";")).otherwise(""))
    key = F.concat("path", F.array(F.lit(_LAST)))
    return marked.join(breaks, "ott_id", "left").select(key.alias("key"), "ott_id", piece.alias("piece"))


def subtree_labels(store, root_id: int, label_format: str = "name_and_id") -> DataFrame:
    """(ott_id, path, label) of the preferred subtree of a taxon, paths starting there."""
    labels = store.taxa.select("ott_id", taxon.label(label_format, F.col("name"), F.col("ott_id")).alias("label"))
    below = F.slice("path", F.array_position("path", F.lit(root_id).cast("long")).cast("int"), F.size("path"))
    return descendants(store.pref_tree, root_id).select("ott_id", below.alias("path")).join(labels, "ott_id")


#: Pieces that one task sorts and puts together.
PIECES_AT_ONCE = 20_000


def _written(nodes: DataFrame, root_id: int, limit: int | None) -> DataFrame:
    """One row (ott_id, newick) of nodes (ott_id, path, label); more than ``limit``, if given, are an error.

    The pieces are parted by ranges of their keys and put together range by range; only the few
    texts that this gives meet in one task.
    """
    nodes = materialize(nodes)
    total = nodes.count()
    if limit is not None and total > limit:
        raise ValueError(f"the tree has more than {limit} taxa")
    joined = lambda key, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text]), "")
    ranges = newick_pieces(nodes).repartitionByRange(max(1, -(-total // PIECES_AT_ONCE)), "key").withColumn("part", F.spark_partition_id())
    texts = ranges.groupBy("part").agg(joined("key", "piece").alias("text"))
    rows = texts.agg(joined("part", "text").alias("newick")).where("newick <> ''")
    return rows.select(F.lit(root_id).cast("long").alias("ott_id"), "newick")


def newick(store, root_id: int, label_format: str = "name_and_id", limit: int | None = None) -> DataFrame:
    """(ott_id, newick) of the preferred subtree of a taxon, children in the order of their ids.

    The whole text of any number of taxa, as long as one string can be (2 GB); more taxa than
    ``limit``, if given, are an error. ``newick_pieces`` of ``subtree_labels`` has the same in pieces.
    """
    return _written(subtree_labels(store, root_id, label_format), root_id, limit)


def induced_newick(store, ids: DataFrame, label_format: str = "name_and_id", limit: int | None = None) -> DataFrame:
    """(ott_id, newick) of the tree that a set of taxa (ott_id) spans in the preferred tree; more taxa than ``limit``, if given, are an error."""
    edges = materialize(induced_subtree(store.pref_tree, ids.select(F.lit(0).alias("set_id"), "ott_id")))
    top = edges.where("parent_ott_id is null").select("ott_id").first()
    labels = store.taxa.select("ott_id", taxon.label(label_format, F.col("name"), F.col("ott_id")).alias("label"))
    if top is None:
        return store.spark.createDataFrame([], "ott_id long, newick string")
    kept = hierarchy(edges.select(F.col("ott_id").alias("id"), F.col("parent_ott_id").alias("parent")))
    return _written(kept.select(F.col("id").alias("ott_id"), "path").join(labels, "ott_id"), top["ott_id"], limit)


def first_neighbour(edges: DataFrame, ids: DataFrame, outgoing: bool = True, source: str | None = None) -> DataFrame:
    """(ott_id, neighbour) of the first edge (child_id, parent_id, source) of each id by source and id; null if none."""
    own, other = ("child_id", "parent_id") if outgoing else ("parent_id", "child_id")
    used = edges if source is None else edges.where(F.col("source") == source)
    first = used.groupBy(F.col(own).alias("ott_id")).agg(F.min(F.struct("source", F.col(other).alias("to"))).alias("e"))
    return ids.select("ott_id").distinct().join(first, "ott_id", "left").select("ott_id", F.col("e.to").alias("neighbour"))


def preferred_edges(edges: DataFrame, priority: list[str]) -> DataFrame:
    """(child_id, parent_id, source): of edges from several sources the one of the first source listed, others after."""
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(k)) for k, s in enumerate(priority)], F.lit(len(priority)))
    return edges.groupBy("child_id").agg(F.min_by(F.struct("parent_id", "source"), F.struct(rank, "source", "parent_id")).alias("e")).select("child_id", "e.parent_id", "e.source")


def same_names(taxa: DataFrame) -> DataFrame:
    """(name_lc, n_taxa, first_id) of names that several taxa bear: homonyms, or one taxon in several sources."""
    return taxa.where("name_lc is not null").groupBy("name_lc").agg(F.countDistinct("ott_id").alias("n_taxa"), F.min("ott_id").alias("first_id")).where("n_taxa > 1")


def wide_nodes(tree: DataFrame, root_id: int, threshold: int = 100) -> DataFrame:
    """Rows at or below a taxon, but nothing below a taxon with ``threshold`` children or more, the start excepted."""
    inside = materialize(descendants(tree, root_id))
    wide = inside.where("parent_ott_id is not null").groupBy(F.col("parent_ott_id").alias("node")).count().where((F.col("count") >= threshold) & (F.col("node") != root_id)).select("node")
    above = inside.select("ott_id", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("node"))
    cut = above.join(wide, "node", "left_semi").select("ott_id").distinct()
    return inside.join(cut, "ott_id", "left_anti")


def inner_and_direct(tree: DataFrame, root_id: int) -> DataFrame:
    """Rows below a taxon that are its direct children or have taxa below themselves."""
    return descendants(tree, root_id).where((F.col("parent_ott_id") == root_id) | ((F.col("n_below") > 0) & (F.col("ott_id") != root_id)))
