"""References to records that do not exist.

Keys are range-partitioned and stored as sorted vectors, one block for each range. References go
in batches to the block of their range, where a binary search finds them or not. A range that
draws many references (one hot target may draw a third of all) gets several batches, each with
its own copy of the block, so that no task takes more than ``BATCH`` references.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbolith.runtime import materialize

#: Keys in a block, references in a batch: both bound what one task holds.
BLOCK_KEYS = 1 << 17
BATCH = 1 << 17

#: since of a key that was always there, gone of a key that was never retired.
ALWAYS, NEVER = -(1 << 63), (1 << 63) - 1

_BLOCK = "lo long, keys binary"
_KEY = np.dtype([("key", "<i8"), ("check", "<i8"), ("since", "<i8"), ("gone", "<i8")])


def key_blocks(keys: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """Sorted blocks of (key, check, since, gone), one row per key and check, none of them null; no key is in two blocks."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.empty(0, dtype=_KEY)

        def block(rows: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"lo": [int(rows["key"][0])], "keys": [rows.tobytes()]})

        for pdf in batches:
            rows = np.empty(len(pdf), dtype=_KEY)
            for name in _KEY.names:
                rows[name] = pdf[name].to_numpy()
            rest = np.concatenate([rest, rows])
            while len(rest) > block_keys:
                # Rows of one key (hash twins) stay together: the cut is where the key changes.
                cut = int(np.searchsorted(rest["key"], rest["key"][block_keys]))
                if not cut:
                    cut = int(np.searchsorted(rest["key"], rest["key"][0], side="right"))
                    if cut == len(rest):
                        break
                yield block(rest[:cut])
                rest = rest[cut:]
        if len(rest):
            yield block(rest)

    ordered = keys.repartitionByRange("key").sortWithinPartitions("key", "check")
    return ordered.select(*_KEY.names).mapInPandas(pack, _BLOCK)


def _search(rows: np.ndarray, key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Position of each (key, check) in the sorted rows, or -1."""
    at = np.searchsorted(rows["key"], key)
    found = np.full(len(key), -1, dtype=np.int64)
    open_ = np.arange(len(key))
    while len(open_):  # one turn but where different keys share a hash
        open_ = open_[at[open_] < len(rows)]
        open_ = open_[rows["key"][at[open_]] == key[open_]]
        hit = rows["check"][at[open_]] == check[open_]
        found[open_[hit]] = at[open_[hit]]
        open_ = open_[~hit]
        at[open_] += 1
    return found


def _judge(rows: np.ndarray, key: np.ndarray, check: np.ndarray, at: np.ndarray) -> np.ndarray:
    place = _search(rows, key, check)
    known = place >= 0
    since = np.full(len(key), NEVER)
    gone = np.full(len(key), NEVER)
    defined = np.zeros(len(key), dtype=bool)
    retired = np.zeros(len(key), dtype=bool)
    if known.any():
        since[known], gone[known] = rows["since"][place[known]], rows["gone"][place[known]]
        defined[known], retired[known] = since[known] != NEVER, gone[known] != NEVER
    reason = np.full(len(key), "missing", dtype=object)
    reason[retired] = np.where(gone[retired] <= at[retired], "deleted", None)
    reason[defined] = "late"
    reason[defined & (since <= at)] = None
    return reason


def find_orphans(refs: DataFrame, keys: DataFrame, block_keys: int = BLOCK_KEYS, batch: int = BATCH) -> DataFrame:
    """The rows of ``refs`` whose target isn't found, with their ``reason``.

    ``refs`` has ``key`` and ``check`` (the target), ``at`` (a moment as a number) and any other
    columns; ``keys`` has ``key``, ``check``, ``since`` (ALWAYS, a moment, or null if never
    defined) and ``gone`` (null: never retired, ALWAYS: long ago). A target is found if a row has
    it with since <= at. Otherwise the reason is ``late`` if it is defined later, ``deleted`` if
    it was retired by then (no case if retired after), else ``missing``. Repeated keys count once
    with their earliest moments; references with a null target aren't references; an empty key
    table makes all references missing.
    """
    merged = keys.where("key is not null").groupBy("key", "check").agg(F.min("since").alias("since"), F.min("gone").alias("gone"))
    merged = merged.select("key", "check", *[F.coalesce(c, F.lit(NEVER)).alias(c) for c in ("since", "gone")])
    blocks = materialize(key_blocks(merged, block_keys))
    starts = np.array(sorted(r["lo"] for r in blocks.select("lo").collect()), dtype=np.int64)  # a number for each block

    @F.pandas_udf(T.IntegerType())
    def block_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts, key.to_numpy(), side="right") - 1, 0).astype(np.int32))

    present = refs.where("key is not null")
    placed = materialize(present.withColumn("__block", block_of("key")))
    salts = placed.groupBy("__block").agg(F.ceil(F.count("*") / batch).cast("int").alias("__n"))
    salts = refs.sparkSession.createDataFrame(
        [(r["__block"], r["__n"]) for r in salts.collect()] or [(0, 1)], "__block int, __n int"
    )  # a row for each block
    left = placed.join(F.broadcast(salts), "__block").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), "__n").cast("int")).drop("__n")
    numbered = blocks.withColumn("__block", block_of("lo")).join(F.broadcast(salts), "__block")
    right = numbered.select("__block", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__salt"), "keys")
    kept = [f for f in refs.schema.fields if f.name not in ("key", "check", "at")]
    out = T.StructType([*kept, T.StructField("reason", T.StringType())])
    names = [f.name for f in kept]

    def probe(found: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(block["keys"].iloc[0], dtype=_KEY) if len(block) else np.empty(0, _KEY)
        reason = _judge(rows, found["key"].to_numpy(), found["check"].to_numpy(), found["at"].to_numpy())
        miss = np.array([x is not None for x in reason], dtype=bool)
        return found.loc[miss, names].assign(reason=reason[miss])

    return left.groupBy("__block", "__salt").cogroup(right.groupBy("__block", "__salt")).applyInPandas(probe, out)


def _moment(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def addition_orphans(additions: DataFrame, forwards: DataFrame, taxa: DataFrame, canonical: DataFrame, deprecated: DataFrame) -> DataFrame:
    """(table_name, ref_field, row_key, period_ym, reason) of additions and forwards.

    A record counts once by add_key, a forward once by alias_id, repeats being alike. A reference
    without time is judged as before all times, with a null period. A null document is a document.
    """
    records = additions.select(
        "add_key", "addition_id", "seq", "parent", "parent_tag", F.date_format("submitted_at", "yyyy-MM").alias("period_ym"),
        F.coalesce(_moment("submitted_at"), F.lit(ALWAYS)).alias("at"),
    ).where("parent is not null or parent_tag is not null").distinct()
    records = materialize(records)
    ids = records.where("parent is not null").select(
        F.lit("additions").alias("table_name"), F.lit("parent").alias("ref_field"), F.col("add_key").alias("row_key"), "period_ym",
        F.col("parent").alias("key"), F.lit(0).cast("long").alias("check"), "at",
    )
    forwarded = forwards.select(
        F.lit("forwards").alias("table_name"), F.lit("ott_id").alias("ref_field"), F.col("alias_id").alias("row_key"),
        F.date_format("made_at", "yyyy-MM").alias("period_ym"), F.col("ott_id").alias("key"), F.lit(0).cast("long").alias("check"),
        F.coalesce(_moment("made_at"), F.lit(ALWAYS)).alias("at"),
    ).distinct()
    always, unknown = F.lit(ALWAYS).alias("since"), F.lit(None).cast("long")
    keys = (
        taxa.select(F.col("ott_id").alias("key"), always, unknown.alias("gone"))
        .unionByName(canonical.select(F.col("ott_id").alias("key"), always, unknown.alias("gone")))
        .unionByName(forwards.select(F.col("alias_id").alias("key"), always, unknown.alias("gone")))
        .unionByName(additions.select(F.col("ott_id").alias("key"), F.coalesce(_moment("submitted_at"), F.lit(NEVER - 1)).alias("since"), unknown.alias("gone")))
        .unionByName(deprecated.select(F.col("ott_id").alias("key"), unknown.alias("since"), F.coalesce(_moment("retired_at"), F.lit(ALWAYS)).alias("gone")))
        .withColumn("check", F.lit(0).cast("long"))
    )
    # A tag is known by two hashes of document and tag; it is found from the place after its record on.
    hashes = lambda tag: (F.xxhash64("addition_id", tag).alias("key"), F.xxhash64(tag, F.lit("tag"), "addition_id").bitwiseOR(F.lit(1)).alias("check"))
    tags = records.where("parent is null").select(
        F.lit("additions").alias("table_name"), F.lit("parent_tag").alias("ref_field"), F.col("add_key").alias("row_key"), "period_ym",
        *hashes("parent_tag"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("at"),
    )
    defined = additions.where("tag is not null").select(
        *hashes("tag"), (F.coalesce(F.col("seq").cast("long"), F.lit(0)) + 1).alias("since"), unknown.alias("gone")
    )
    # One search for both kinds: an id has the check 0, which no tag has.
    return find_orphans(ids.unionByName(forwarded).unionByName(tags), keys.unionByName(defined.select(keys.columns)))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphan references by table, field, period and reason."""
    return orphans.groupBy("table_name", "ref_field", "period_ym", "reason").agg(F.count("*").alias("n_refs"))
