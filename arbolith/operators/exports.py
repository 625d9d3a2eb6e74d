"""Text and JSON forms of a taxonomy: graph files, taxon lists, name lists, subsets, result listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.functions import taxon
from arbolith.operators import tree as trees
from arbolith.runtime import with_ordinals

SEPARATOR = "\t|\t"


def dot_lines(store, root_id: int) -> DataFrame:
    """(part, position, line) of a directed graph of the edges into each taxon of a preferred subtree.

    Nodes are numbered from 1 by depth and id. ``part`` orders head, nodes, edges and foot.
    """
    inside = trees.descendants(store.pref_tree, root_id).select(F.col("ott_id").alias("parent_ott_id"))
    edges = store.taxa.select("ott_id", "parent_ott_id").distinct().join(inside, "parent_ott_id", "left_semi").select("ott_id", "parent_ott_id")
    nodes = edges.select("ott_id").union(edges.select("parent_ott_id")).distinct().join(store.tree.select("ott_id", "depth"), "ott_id")
    numbered = with_ordinals(nodes, ["depth", "ott_id"], "k").select("ott_id", F.concat(F.lit("n"), (F.col("k") + 1).cast("string")).alias("node"), "k")
    names = numbered.join(store.taxa.select("ott_id", "name"), "ott_id")
    node_lines = names.select(F.lit(1).alias("part"), F.col("k").alias("position"), F.concat(F.lit("\t"), "node", F.lit(' [label="'), F.coalesce("name", F.lit("")), F.lit('"] ;')).alias("line"))
    a = numbered.select("ott_id", F.col("node").alias("from"), "k")
    b = numbered.select(F.col("ott_id").alias("parent_ott_id"), F.col("node").alias("to"))
    edge_lines = edges.join(a, "ott_id").join(b, "parent_ott_id").select(F.lit(2).alias("part"), F.col("k").alias("position"), F.concat(F.lit("\t"), "from", F.lit(" -> "), "to", F.lit(" [color=black] ;")).alias("line"))
    frame = store.spark.createDataFrame([(0, 0, "strict digraph  {"), (0, 1, "\trankdir = RL ;"), (3, 0, "}")], "part int, position long, line string")
    return frame.unionByName(node_lines).unionByName(edge_lines)


def taxon_list_lines(store, root_id: int) -> DataFrame:
    """(position, line) of a flat list: two head lines, then id, parent and cleaned name of what is below a taxon."""
    below = trees.descendants(store.pref_tree, root_id).where(F.col("ott_id") != root_id).select("ott_id", "parent_ott_id").join(store.taxa.select("ott_id", "name"), "ott_id")
    join = lambda *c: F.concat(F.concat_ws(SEPARATOR, *c), F.lit(SEPARATOR))
    first = store.spark.createDataFrame([(0, SEPARATOR.join(["1", "0", "life", ""]))], "position long, line string")
    top = store.taxa.where(F.col("ott_id") == root_id).select(F.lit(1).cast("long").alias("position"), join(F.col("ott_id").cast("string"), F.lit("1"), F.coalesce("name", F.lit(""))).alias("line"))
    rest = below.select(F.col("ott_id").alias("position"), join(F.col("ott_id").cast("string"), F.col("parent_ott_id").cast("string"), taxon.list_name(F.coalesce("name", F.lit("")))).alias("line"))
    return first.unionByName(top).unionByName(rest)


def graph_json(store, root_id: int) -> DataFrame:
    """(kind, position, json) of the nodes that have something below, and their edges, as lines of valid JSON."""
    inside = trees.descendants(store.tree, root_id).where("n_below > 0")
    numbered = with_ordinals(inside.select("depth", "ott_id", "parent_ott_id"), ["depth", "ott_id"], "k")
    nodes = numbered.join(store.taxa.select("ott_id", "name"), "ott_id").select(F.lit("node").alias("kind"), F.col("k").alias("position"), F.to_json(F.struct("name", F.col("k").alias("group"))).alias("json"))
    up = numbered.select(F.col("ott_id").alias("parent_ott_id"), F.col("k").alias("target"))
    links = numbered.join(up, "parent_ott_id").select(F.lit("link").alias("kind"), F.col("k").alias("position"), F.to_json(F.struct(F.col("k").alias("source"), "target", F.lit(1).alias("value"))).alias("json"))
    return nodes.unionByName(links)


def name_dump(store) -> DataFrame:
    """(ott_id, json) with name, id and source ids of each taxon."""
    sources = taxon.source_ids(F.col("input_sources"))
    return store.taxa.select("ott_id", F.to_json(F.struct("name", F.col("ott_id").cast("string").alias("treestoreId"), sources.alias("sourceIds"))).alias("json"))


def subset_lines(store, name: str) -> DataFrame:
    """(ott_id, line) of a taxon and all below it, the last by id if several bear the name, in the dump's form."""
    start = store.taxa.where(F.col("name") == name).agg(F.max("ott_id").alias("start"))
    wanted = store.tree.select("ott_id", F.explode("path").alias("start")).join(F.broadcast(start), "start", "left_semi").select("ott_id")
    rows = store.taxa.join(wanted, "ott_id", "left_semi")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.concat_ws(SEPARATOR, text("ott_id"), text("parent_ott_id"), text("name"), text("rank"), text("input_sources"), text("uniqname")), F.lit(SEPARATOR))
    return rows.select("ott_id", line.alias("line"))


def result_lines(names: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(query_id, qname, lines) listing each name's matches in words; none for an unmatched name."""
    listed = descriptions.groupBy("query_id").agg(F.array_sort(F.collect_list("description")).alias("lines"))
    return names.join(listed, "query_id", "left").select("query_id", "qname", F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n").alias("lines"))


def write_newick(store, root_id: int, path: str, label_format: str = "name_and_id") -> None:
    """The preferred subtree of a taxon as Newick in text files: line after line, part by part, they are one text of any size."""
    write_lines(trees.newick_pieces(trees.subtree_labels(store, root_id, label_format)), ["key"], path, "piece")


def write_lines(lines: DataFrame, order: list[str], path: str, column: str = "line") -> None:
    """Text files in the given order, part by part; the folder must not exist."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(column).write.mode("errorifexists").text(path)
