"""Changes between consecutive full snapshots, by ordinals, compressed bitmaps and aligned vectors.

Keys get persistent ordinals (first snapshot seen, then key: a later snapshot only appends to the
registry). Ordinals are cut into chunks; for every chunk and snapshot one block holds a compressed
bitmap of the keys present and, aligned with its set bits, the vectors of keys and of each value.
Two blocks of consecutive snapshots are compared by AND-NOT of the compressed bitmaps and by the
vectors of their common bits. Registry and blocks are tables: kept, they let a new snapshot be
compared without reading the old ones again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arbolith.runtime import materialize, with_ordinals

#: Ordinals in a chunk: the most rows that a group of one snapshot has.
CHUNK = 1 << 14

CHANGES = "snap_no long, key long, change_kind string, fields array<string>"


class Bitmap:
    """A set of places below CHUNK, held as the smallest of: sorted places, runs, words of bits.

    Sets are combined as they are held; only words against another form are written out as words.
    """

    def __init__(self, blob: bytes | None) -> None:
        self.kind = blob[:1] if blob else b"p"
        self.data = np.frombuffer(blob[1:] if blob else b"", dtype="<u8" if self.kind == b"w" else "<u2")
        if self.kind == b"r":
            self.starts, self.ends = self.data[::2].astype(np.int64), self.data[1::2].astype(np.int64) + 1
        elif self.kind == b"p":
            self.starts = self.data.astype(np.int64)
            self.ends = self.starts + 1

    @staticmethod
    def pack(places: np.ndarray) -> bytes:
        """The blob of sorted distinct places."""
        gaps = np.flatnonzero(np.diff(places) != 1) + 1
        runs = np.stack([places[np.r_[0, gaps]], places[np.r_[gaps, len(places)] - 1]], axis=1) if len(places) else np.empty((0, 2))
        forms = [(2 * len(places), b"p"), (4 * len(runs), b"r"), (CHUNK // 8, b"w")]
        kind = min(forms)[1]
        if kind == b"p":
            return kind + places.astype("<u2").tobytes()
        if kind == b"r":
            return kind + runs.astype("<u2").tobytes()
        bits = np.zeros(CHUNK, dtype=np.uint8)
        bits[places] = 1
        return kind + np.packbits(bits, bitorder="little").tobytes()

    def words(self) -> np.ndarray:
        if self.kind == b"w":
            return self.data
        bits = np.zeros(CHUNK + 1, dtype=np.int8)
        bits[self.starts] += 1
        bits[self.ends] -= 1
        return np.packbits(np.cumsum(bits[:-1]).astype(np.uint8), bitorder="little").view("<u8")

    def holds(self, places: np.ndarray) -> np.ndarray:
        if self.kind == b"w":
            return (self.data[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
        at = np.searchsorted(self.starts, places, side="right") - 1
        return (at >= 0) & (places < self.ends[at] if len(self.ends) else False)

    def meet(self, other: Bitmap, inside: bool) -> np.ndarray:
        """Sorted places of this set that are (AND) or aren't (AND-NOT) in the other."""
        if self.kind == b"p":
            return self.starts[self.holds(self.starts) & (other.holds(self.starts) == inside)]
        if self.kind == b"w" or other.kind == b"w":
            theirs = other.words()
            kept = self.words() & (theirs if inside else ~theirs)
            return np.flatnonzero(np.unpackbits(kept.view(np.uint8), bitorder="little"))
        # Runs against runs: between two edges of either nothing changes.
        edges = np.unique(np.concatenate([self.starts, self.ends, other.starts, other.ends]))
        lo, hi = edges[:-1], edges[1:]
        kept = self.holds(lo) & (other.holds(lo) == inside)
        lo, hi = lo[kept], hi[kept]
        size = hi - lo
        return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(lo) else lo

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many places of the set are below each of its places: where the vectors have it."""
        if self.kind == b"w":
            before = np.r_[0, np.cumsum(np.bitwise_count(self.data).astype(np.int64))]
            below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            return before[places >> 6] + np.bitwise_count(self.data[places >> 6] & below)
        before = np.r_[0, np.cumsum(self.ends - self.starts)]
        at = np.searchsorted(self.starts, places, side="right") - 1
        return before[at] + places - self.starts[at]


def register_keys(rows: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(key, ordinal) for rows of (snap_no, key): those of ``registry`` as they are, new keys behind them by first snapshot, then key."""
    first = rows.groupBy("key").agg(F.min("snap_no").alias("first_snap"))
    if registry is None:
        return with_ordinals(first, ["first_snap", "key"], "ordinal").select("key", "ordinal")
    start = (registry.agg(F.max("ordinal").alias("m")).first()["m"] or -1) + 1 if registry.limit(1).count() else 0
    new = with_ordinals(first.join(registry, "key", "left_anti"), ["first_snap", "key"], "ordinal")
    return registry.select("key", "ordinal").unionByName(new.select("key", (F.col("ordinal") + start).alias("ordinal")))


def latest_rows(df: DataFrame, key: str, snap: str, loaded: str, values: dict[str, Column]) -> DataFrame:
    """(snap_no, key, v0, v1, ...): one row per snapshot and key, the one loaded last (ties: the largest values).

    Rows without key or snapshot number are dropped.
    """
    picked = df.select(
        F.col(snap).cast("long").alias("snap_no"),
        F.col(key).cast("long").alias("key"),
        F.struct(F.col(loaded).alias("at"), *[c.alias(f"v{k}") for k, c in enumerate(values.values())]).alias("row"),
    ).where("snap_no is not null and key is not null")
    last = picked.groupBy("snap_no", "key").agg(F.max("row").alias("row"))
    return last.select("snap_no", "key", *[f"row.v{k}" for k in range(len(values))])


def snapshot_blocks(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(chunk, snap_no, bitmap, keys, v0, v1, ...) of each chunk and snapshot: a group holds CHUNK rows at most."""
    vectors = [c for c in rows.columns if c not in ("snap_no", "key")]
    placed = rows.join(registry, "key").withColumn("chunk", F.floor(F.col("ordinal") / CHUNK))
    row = F.struct((F.col("ordinal") % CHUNK).cast("int").alias("place"), "key", *vectors)
    grouped = placed.groupBy("chunk", "snap_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    @F.pandas_udf("binary")
    def packed(places: pd.Series) -> pd.Series:
        return places.map(Bitmap.pack)

    return grouped.select("chunk", "snap_no", packed(F.col("rows.place")).alias("bitmap"), F.col("rows.key").alias("keys"), *[F.col(f"rows.{v}").alias(v) for v in vectors])


def _differs(a: pa.Array, b: pa.Array) -> np.ndarray:
    unlike = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def block_changes(new: DataFrame, old: DataFrame, names: list[str]) -> DataFrame:
    """CHANGES between blocks that have the same chunk and snap_no; blocks that one side lacks are all added or all removed.

    ``names`` are those of the vectors v0, v1, ...; ``fields`` tells which of them changed.
    """

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        sides = []
        for t in (a, b):
            row = {c: t.column(c)[0] for c in t.column_names} if t.num_rows else {}
            sides.append((Bitmap(row["bitmap"].as_py() if row else None), row))
        (now, row), (was, last) = sides
        snap = (row or last)["snap_no"].as_py()
        kinds, keys, fields = [], [], []
        for kind, own, other, source in (("added", now, was, row), ("removed", was, now, last)):
            gone = own.meet(other, False)
            if len(gone):
                keys.append(source["keys"].values.take(pa.array(own.rank(gone))).to_numpy())
                kinds += [kind] * len(gone)
                fields += [None] * len(gone)
        common = now.meet(was, True)
        if len(common):
            i, j = pa.array(now.rank(common)), pa.array(was.rank(common))
            unlike = np.stack([_differs(row[f"v{k}"].values.take(i), last[f"v{k}"].values.take(j)) for k in range(len(names))]) if names else np.zeros((0, len(common)), bool)
            hit = np.flatnonzero(unlike.any(axis=0))
            if len(hit):
                keys.append(row["keys"].values.to_numpy()[now.rank(common[hit])])
                kinds += ["changed"] * len(hit)
                fields += [[n for n, u in zip(names, unlike[:, h], strict=True) if u] for h in hit]
        found = np.concatenate(keys) if keys else np.empty(0, np.int64)
        return pa.table(
            {"snap_no": pa.array(np.full(len(found), snap), pa.int64()), "key": pa.array(found, pa.int64()), "change_kind": pa.array(kinds, pa.string()), "fields": pa.array(fields, pa.list_(pa.string()))}
        )

    old = old.select(*[F.col(c).alias(c) for c in old.columns])  # both may come from one table
    return new.groupBy("chunk", "snap_no").cogroup(old.groupBy("chunk", "snap_no")).applyInArrow(compare, CHANGES)


def snapshot_changes(df: DataFrame, key: str, snap: str, loaded: str, values: dict[str, Column]) -> DataFrame:
    """CHANGES (snap_no, key, change_kind, fields) of every key that differs from the snapshot delivered before.

    ``values``: name and expression of each value compared, exactly, null being a value of its own;
    ``fields`` names those that changed. Snapshot numbers may have gaps; the first snapshot yields
    nothing; an empty table yields nothing; rows without key or snapshot number are no records.
    Other columns are ignored.
    """
    rows = materialize(latest_rows(df, key, snap, loaded, values))
    blocks = materialize(snapshot_blocks(rows, register_keys(rows)))
    # As many rows as there are snapshots: one small partition.
    numbers = blocks.select("snap_no").distinct().withColumn("next_no", F.lead("snap_no").over(Window.orderBy("snap_no")))
    following = F.broadcast(numbers.where("next_no is not null"))
    new = blocks.join(following.select(F.col("next_no").alias("snap_no")), "snap_no", "left_semi").select(blocks.columns)
    old = blocks.join(following, "snap_no").withColumn("snap_no", F.col("next_no")).select(blocks.columns)
    return block_changes(new, old, list(values))


def next_changes(df: DataFrame, registry: DataFrame, last_blocks: DataFrame, key: str, snap: str, loaded: str, values: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(registry, blocks, changes) when one more snapshot ``df`` comes; the older ones aren't read again.

    ``registry`` and ``last_blocks`` are those of the snapshot before, as they were kept. An empty
    ``df`` is no snapshot and is refused.
    """
    rows = materialize(latest_rows(df, key, snap, loaded, values))
    known = materialize(register_keys(rows, registry))
    blocks = materialize(snapshot_blocks(rows, known))
    number = rows.agg(F.max("snap_no").alias("now")).first()["now"]
    if number is None:
        raise ValueError("the snapshot has no rows")
    old = last_blocks.withColumn("snap_no", F.lit(number).cast("long")).select(blocks.columns)
    return known, blocks, block_changes(blocks, old, list(values))
