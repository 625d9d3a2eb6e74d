"""Parent-child rows to full hierarchies by leaf peeling.

Each round takes the leaves off and sends their subtree sizes to their parents. Where rounds take
off little, as in long chains, the chains in between are taken out too: a node with one child hands
its way up to that child, by doubling pointers, so that a chain of any length ends in few rounds.
What has no leaves any more is on rings. In reverse order the parents then hand path, depth and
root down to what was taken off before them. Every round is a join, whatever the size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from arbolith.runtime import free, materialize

#: Chains are taken out where a round takes off less than this share of the nodes left.
SLOW_SHARE = 0.2

# The state of a node: ``given`` is its parent as it came, ``parent`` the next node above that isn't
# taken out; n_over nodes of weight w_over, smallest id low_over, topmost top_over stand in between
# (``over``, from the top down, with paths only). ``size`` counts it and what was taken off below it.

_PLACED = "id long, parent long, n_below long, root long, depth int, path array<long>, on_ring boolean, to_ring boolean"


def _none() -> Column:
    return F.array().cast("array<long>")


def _sum_or(c: str, other: int) -> Column:
    return F.coalesce(c, F.lit(other))


def _start(nodes: DataFrame, paths: bool) -> DataFrame:
    plain = nodes.where("id is not null").groupBy("id").agg(F.min("parent").alias("given"))
    plain = materialize(plain)
    # Pre-aggregated: a parent of a third of all rows is one row of this side.
    kids = plain.where("given is not null").groupBy(F.col("given").alias("id")).agg(F.count("*").alias("kids"))
    one = F.lit(1).cast("long")
    return (
        plain.join(kids, "id", "left").select(
            "id", "given", F.col("given").alias("parent"), one.alias("size"), _sum_or("kids", 0).alias("kids"), F.lit(0).cast("long").alias("n_over"), F.lit(0).cast("long").alias("w_over"),
            F.lit(None).cast("long").alias("low_over"), F.lit(None).cast("long").alias("top_over"), *([_none().alias("over")] if paths else []),
        )
    )


def _counted(state: DataFrame) -> tuple[DataFrame, int, int]:
    """The state, written, with its number of nodes and of leaves; both are told by the writing."""
    seen = Observation()
    made = materialize(state.observe(seen, F.count("*").alias("total"), F.count_if(F.col("kids") == 0).alias("leaves")))
    return made, seen.get["total"], seen.get["leaves"]


def _peeled(state: DataFrame) -> DataFrame:
    """The nodes that aren't leaves, with what their leaves send."""
    sent = state.where("kids = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("size") + F.col("w_over")).alias("sent"), F.count("*").alias("gone"))
    left = state.where("kids > 0").join(sent, "id", "left")
    return left.withColumn("size", F.col("size") + _sum_or("sent", 0)).withColumn("kids", F.col("kids") - _sum_or("gone", 0)).drop("sent", "gone")


def _doubled(walk: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame | None]:
    """(walks up to the next node that isn't in ``walk``; walks that never end, as all stand on a ring, or None).

    A walk (id, given, size, far, head, n, w, low, top, seg) has passed n nodes of weight w between
    id and far, ``head`` being the last node passed or id itself. Each turn doubles its length.
    """
    before = None
    while True:
        last = walk
        there = last.select(F.col("id").alias("far"), *[F.col(c).alias(f"{c}2") for c in ("far", "head", "n", "w", "low", "top", "size", *(["seg"] if paths else []))])
        there = there.withColumnRenamed("far2", "beyond")
        met = F.col("size2").isNotNull()
        seen = Observation()
        walk = materialize(
            last.join(there, "far", "left").select(
                "id", "given", "size", F.when(met, F.col("beyond")).otherwise(F.col("far")).alias("far"), F.coalesce("head2", "head").alias("head"),
                (F.col("n") + F.when(met, F.col("n2") + 1).otherwise(0)).alias("n"), (F.col("w") + F.when(met, F.col("w2") + F.col("size2")).otherwise(0)).alias("w"),
                F.least("low", "low2", F.when(met, F.col("far"))).alias("low"), F.when(met, F.coalesce("top2", "far")).otherwise(F.col("top")).alias("top"),
                *([F.when(met, F.concat("seg2", F.array("far"), "seg")).otherwise(F.col("seg")).alias("seg")] if paths else []), met.alias("open"),
            ).observe(seen, F.count_if("open").alias("open"))
        )
        free(last)
        now = seen.get["open"]
        # Of a chain each turn ends some walks; where none ended all that are open go round.
        if not now or now == before:
            return walk.where("not open"), walk.where("open") if now else None
        before = now


_UNARY = "kids = 1 and parent is not null"


def _without_chains(state: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(state without the nodes of one child, the walks of those taken out, the lower ends of their chains, rings of them if any)."""
    walk = state.where(_UNARY).select(
        "id", "given", "size", F.col("parent").alias("far"), F.col("id").alias("head"), F.col("n_over").alias("n"), F.col("w_over").alias("w"),
        F.col("low_over").alias("low"), F.col("top_over").alias("top"), *([F.col("over").alias("seg")] if paths else []),
    )
    chains, round_ = _doubled(walk, paths)
    up = chains.drop("given", "open").withColumnRenamed("id", "parent").withColumnRenamed("size", "up_size")
    met = F.col("up_size").isNotNull()
    rest = state.where(f"not ({_UNARY})").join(up, "parent", "left")
    rest = materialize(
        rest.select(
            "id", "given", F.when(met, F.col("far")).otherwise(F.col("parent")).alias("parent"), "size", "kids",
            (F.col("n_over") + F.when(met, F.col("n") + 1).otherwise(0)).alias("n_over"), (F.col("w_over") + F.when(met, F.col("w") + F.col("up_size")).otherwise(0)).alias("w_over"),
            F.least("low_over", "low", F.when(met, F.col("parent"))).alias("low_over"), F.when(met, F.coalesce("top", "parent")).otherwise(F.col("top_over")).alias("top_over"),
            *([F.when(met, F.concat("seg", F.array("parent"), "over")).otherwise(F.col("over")).alias("over")] if paths else []), F.when(met, F.col("head")).alias("head"),
        )
    )
    ends = rest.where("head is not null").select("head", "id", F.col("parent").alias("far"), F.col("w_over").alias("whole"))
    return rest.drop("head"), chains, ends, None if round_ is None else state.join(round_.select("id"), "id", "left_semi")


def _on_rings(rest: DataFrame, paths: bool) -> DataFrame:
    """Rows of the result for nodes that stand on rings and nowhere else: the smallest id of each by doubling pointers."""
    low = F.least("id", "parent", "low_over")
    walk = materialize(rest.select("id", "given", F.col("parent").alias("far"), low.alias("root"), (F.col("size") + F.col("w_over")).alias("weight")))
    while True:
        there = walk.select(F.col("id").alias("far"), F.col("far").alias("far2"), F.col("root").alias("root2"))
        last = walk
        seen = Observation()
        step = last.join(there, "far").select("id", "given", F.col("far2").alias("far"), F.least("root", "root2").alias("root"), "weight", (F.col("root2") < F.col("root")).alias("fell"))
        walk = materialize(step.observe(seen, F.count_if("fell").alias("fell")).drop("fell"))
        free(last)
        if not seen.get["fell"]:
            break
    totals = walk.groupBy("root").agg(F.sum("weight").alias("all"))
    return walk.join(totals, "root").select(
        "id", F.col("given").alias("parent"), (F.col("all") - 1).alias("n_below"), "root", F.lit(0).alias("depth"), (F.array("id") if paths else F.lit(None).cast("array<long>")).alias("path"),
        F.lit(True).alias("on_ring"), F.lit(True).alias("to_ring"),
    )


def _above(done: DataFrame, key: str, paths: bool) -> DataFrame:
    return done.select(F.col("id").alias(key), *[F.col(c).alias(f"up_{c}") for c in ("root", "depth", "to_ring", *(["path"] if paths else []))])


def _place(paths: bool, over: str, n: str, top: str) -> list[Column]:
    """root, depth and path of a node with nodes ``over`` it (n of them, ``top`` the topmost) below what stands above."""
    way = F.concat(F.coalesce("up_path", _none()), over, F.array("id")) if paths else F.lit(None).cast("array<long>")
    return [F.coalesce("up_root", top, "id").alias("root"), (_sum_or("up_depth", -1) + F.col(n) + 1).cast("int").alias("depth"), way.alias("path")]


def _placed_leaves(leaves: DataFrame, done: DataFrame, paths: bool) -> DataFrame:
    found = leaves.join(_above(done, "parent", paths), "parent", "left")
    return found.select(
        "id", F.col("given").alias("parent"), (F.col("size") - 1).alias("n_below"), *_place(paths, "over", "n_over", "top_over"), F.lit(False).alias("on_ring"), F.coalesce("up_to_ring", F.lit(False)).alias("to_ring")
    )


def _placed_chains(chains: DataFrame, ends: DataFrame, done: DataFrame, paths: bool) -> DataFrame:
    below = done.select("id", F.col("n_below").alias("end_below"), F.col("on_ring").alias("ringed"), F.col("root").alias("end_root"))
    found = ends.join(below, "id").drop("id").join(_above(done, "far", paths), "far", "left").drop("far")
    rows = chains.drop("far").join(found, "head")
    root, depth, path = _place(paths, "seg", "n", "top")
    ringed = F.col("ringed")
    return rows.select(
        "id", F.col("given").alias("parent"), F.when(ringed, F.col("end_below")).otherwise(F.col("end_below") + F.col("whole") - F.col("w")).alias("n_below"),
        F.when(ringed, F.col("end_root")).otherwise(root).alias("root"), F.when(ringed, 0).otherwise(depth).alias("depth"),
        (F.when(ringed, F.array("id")).otherwise(path) if paths else path).alias("path"), ringed.alias("on_ring"), F.coalesce("up_to_ring", F.lit(False)).alias("to_ring"),
    )


def hierarchy(nodes: DataFrame, paths: bool = True, slow_share: float = SLOW_SHARE) -> DataFrame:
    """Path, depth, root and number of descendants of each node of (id, parent).

    A parent that is null or no id ends the way up: the node is a root of depth 0. Nodes on a ring
    have depth 0, the ring's smallest id as root and their own id as path; nodes that hang on a
    ring (to_ring) count depth and path from it and have its smallest id as root. A node can be
    its own parent, which is a ring of one. Several rows of one id count as the one with the
    smallest parent, rows with a null id not at all; n_below counts the nodes below (on a ring,
    all others of its component). An empty table gives an empty result. ``paths`` = False leaves
    the paths null, which are as long as the trees are deep. Nothing is gathered in one task: the
    number of rounds grows with the logarithm of the nodes, be the trees deep or wide.
    """
    layers, rings, used = [], [], []
    state, total, leaves = _counted(_start(nodes, paths))
    while total:
        used.append(state)
        if not leaves:
            rings.append(state)
            break
        layers.append((state.where("kids = 0"), None))
        if leaves >= slow_share * total:
            state, total, leaves = _counted(_peeled(state))
            continue
        whole = materialize(_peeled(state))
        used.append(whole)
        state, chains, ends, round_ = _without_chains(whole, paths)
        layers.append((chains, ends))
        if round_ is not None:
            rings.append(round_)
        total, leaves = state.agg(F.count("*"), F.count_if(F.col("kids") == 0)).first()
    done = materialize(_on_rings(reduce(DataFrame.unionByName, rings), paths)) if rings else nodes.sparkSession.createDataFrame([], _PLACED)
    for rows, ends in reversed(layers):
        placed = _placed_leaves(rows, done, paths) if ends is None else _placed_chains(rows, ends, done, paths)
        done = done.unionByName(materialize(placed.select(done.columns)))
    free(*used)
    return done


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of each node and what stands above it, itself not included.

    Nothing is shuffled or gathered: every node writes one row per ancestor of its path.
    """
    above = F.transform(
        F.slice("path", 1, F.size("path") - 1), lambda a, i: F.struct(a.alias("ancestor"), F.col("id").alias("descendant"), (F.size("path") - 1 - i).alias("distance"))
    )
    return tree.where("size(path) > 1").select(F.inline(above))


def addition_parents(additions: DataFrame) -> DataFrame:
    """(id, parent) of each ott_id of additions, by the record first submitted (then smallest add_key).

    The parent is ``parent`` or, if null, the ott_id of the record with that tag in the same
    document (the first by seq, then add_key, if a tag stands twice). Repeated deliveries change
    nothing. Records without ott_id are no nodes.
    """
    own = F.struct("submitted_at", "add_key", "parent", F.when(F.col("parent").isNull(), F.struct("addition_id", "parent_tag")).alias("link"))
    first = additions.where("ott_id is not null").groupBy("ott_id").agg(F.min(own).alias("r"))
    first = first.select(F.col("ott_id").alias("id"), "r.parent", "r.link.addition_id", F.col("r.link.parent_tag").alias("tag"))
    tags = additions.where("tag is not null").groupBy("addition_id", "tag").agg(F.min(F.struct("seq", "add_key", "ott_id")).alias("t"))
    tags = tags.select("addition_id", "tag", F.col("t.ott_id").alias("by_tag"))
    by_id = first.where("parent is not null or tag is null").select("id", "parent")
    by_tag = first.where("parent is null and tag is not null").join(tags, ["addition_id", "tag"], "left").select("id", F.col("by_tag").alias("parent"))
    return by_id.unionByName(by_tag)


def walk_cases(tree: DataFrame, more_than: int = 8) -> DataFrame:
    """(ott_id, end_ott_id, steps) of nodes that end in a ring and of nodes deeper than ``more_than``."""
    return tree.where(F.col("to_ring") | (F.col("depth") > more_than)).select(
        F.col("id").alias("ott_id"), F.col("root").alias("end_ott_id"), F.col("depth").cast("long").alias("steps")
    )
