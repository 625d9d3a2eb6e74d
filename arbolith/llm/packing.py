"""Texts of varying length in containers of fixed capacity, by best-two-fit.

Texts longer than a container are cut into full pieces and a rest. Pieces are spread over shards
of bounded size by a hash, and each shard is packed on its own: a container is filled with the
largest piece that fits, again and again; then its smallest piece gives way to two unpacked ones
that together fill the gap more tightly. The last, half-empty containers of a shard are few
against the thousands that a shard has.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbolith.runtime import materialize

#: Tokens a container holds, and tokens of all pieces in a shard (some thousand containers).
CAPACITY, SHARD_TOKENS = 2048, 8_000_000
#: Copies of one text that a task writes out at a time.
COPIES = 1 << 16


@lru_cache(maxsize=4)
def encoding(path: str):
    """The byte-level tokenizer whose ranks stand in the file at ``path``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(id, n_tokens) of each text, whole; an empty text has none, a null text is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(tokenizer).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    given = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return given.mapInPandas(run, "id long, n_tokens long")


class _Stock:
    """Unpacked pieces by size; finds the largest size that is at most a given one."""

    def __init__(self, sizes: np.ndarray) -> None:
        order = np.argsort(sizes, kind="stable")
        self.pieces: dict[int, list[int]] = {}
        for i in order[::-1]:
            self.pieces.setdefault(int(sizes[i]), []).append(int(i))
        self.sizes = sorted(self.pieces)

    def largest(self, most: int) -> int:
        k = bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int) -> int:
        found = self.pieces[size].pop()
        if not self.pieces[size]:
            del self.pieces[size]
            del self.sizes[bisect_right(self.sizes, size) - 1]
        return found

    def give(self, size: int, piece: int) -> None:
        if size not in self.pieces:
            self.pieces[size] = []
            self.sizes.insert(bisect_right(self.sizes, size), size)
        self.pieces[size].append(piece)

    def best_two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """The two sizes with the largest sum that is at most ``room`` and above ``more_than``."""
        best, found = more_than, None
        lo, hi = 0, bisect_right(self.sizes, room) - 1
        while lo <= hi:
            total = self.sizes[lo] + self.sizes[hi]
            if total > room:
                hi -= 1
                continue
            if total > best and (lo != hi or len(self.pieces[self.sizes[lo]]) > 1):
                best, found = total, (self.sizes[hi], self.sizes[lo])
                if best == room:
                    break
            lo += 1
        return found


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece; sizes from 1 to ``capacity``."""
    place = np.full(len(sizes), -1, dtype=np.int64)
    stock, number = _Stock(sizes), 0
    while stock.sizes:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while gap and (size := stock.largest(gap)):
            inside.append((size, stock.take(size)))
            gap -= size
        if gap:
            small, piece = inside[-1]
            two = stock.best_two(gap + small, small)
            if two:
                inside[-1:] = [(s, stock.take(s)) for s in two]
                stock.give(small, piece)
        for _, piece in inside:
            place[piece] = number
        number += 1
    return place


def containers(counts: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, copy_no, piece_no, start_token, n_tokens, shard, container_no) of every piece of (id, n_tokens).

    A container is (shard, container_no). Texts of more than ``capacity`` tokens are cut into full
    pieces and a rest, others never; texts without tokens need no container and have no row. A
    repeated id is packed as often as it comes, numbered by ``copy_no``. The result is the same
    however the rows are partitioned.
    """
    given = materialize(counts.where("n_tokens > 0").groupBy("id", "n_tokens").agg(F.count("*").alias("copies")))
    total = given.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // shard_tokens))
    steps = lambda until, by: F.sequence(F.lit(0).cast("long"), until - 1, F.lit(by).cast("long"))
    # Copies in two steps with a shuffle between, as one id may stand for a third of all rows.
    many = given.withColumn("from_copy", F.explode(steps(F.col("copies"), COPIES))).repartition("id", "from_copy")
    copies = many.withColumn("copy_no", F.explode(F.sequence("from_copy", F.least(F.col("from_copy") + COPIES, F.col("copies")) - 1)))
    pieces = copies.select("id", "copy_no", "n_tokens", F.posexplode(steps(F.col("n_tokens"), capacity)).alias("piece_no", "start_token")).select(
        "id", "copy_no", "piece_no", "start_token", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("start_token")).alias("n_tokens")
    )
    # Hashed by copy and piece: neither copies of a text nor pieces of a long one gather in a shard.
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "copy_no", "piece_no"), F.lit(shards)).cast("int"))
    kinds = "id long, copy_no long, piece_no int, start_token long, n_tokens long, shard int, container_no long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "copy_no", "piece_no"], ignore_index=True)
        return pdf.assign(container_no=pack(pdf["n_tokens"].to_numpy(), capacity))

    return spread.groupBy("shard").applyInPandas(run, kinds)


def checks(counts: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(check_name, n): texts that got a place, then what breaks a rule, 0 each if all is right.

    ``lost_tokens``: texts whose pieces don't sum up to them; ``split_short``: texts cut without
    need; ``parts_out_of_place``: pieces that don't follow the one before; ``overfull``: containers
    beyond the capacity; ``fill_below_98_percent``: 1 if containers are less full, but for one a
    shard at most that stays open.
    """
    counts = materialize(counts.where("n_tokens > 0"))
    placed = materialize(containers(counts, capacity, shard_tokens))
    want = counts.groupBy("id").agg(F.sum("n_tokens").alias("want"), F.count("*").alias("texts"), F.max("n_tokens").alias("longest"))
    got = placed.groupBy("id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.count_if(F.col("start_token") != F.col("piece_no") * capacity).alias("astray"))
    same = want.join(got, want["id"].eqNullSafe(got["id"]), "full_outer")
    texts = same.agg(
        F.coalesce(F.sum(F.when(F.col("got").isNotNull(), F.col("texts"))), F.lit(0)).alias("texts"), F.count_if(~F.col("want").eqNullSafe(F.col("got"))).alias("lost_tokens"),
        F.count_if((F.col("longest") <= capacity) & (F.col("pieces") > F.col("texts"))).alias("split_short"), F.coalesce(F.sum("astray"), F.lit(0)).alias("parts_out_of_place"),
    )
    filled = placed.groupBy("shard", "container_no").agg(F.sum("n_tokens").alias("held"))
    boxes = filled.agg(
        F.count_if(F.col("held") > capacity).alias("overfull"),
        F.coalesce((F.sum("held") < 0.98 * capacity * (F.count("*") - F.countDistinct("shard"))).cast("long"), F.lit(0).cast("long")).alias("fill_below_98_percent"),
    )
    one = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).cast("long").alias("n")) for c in df.columns])))
    return one(texts).unionByName(one(boxes))
