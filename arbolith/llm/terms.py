"""Frequency of every distinct term or run of terms, by suffix arrays with common-prefix intervals.

Each block of records gets a suffix array over its terms; its intervals of a common prefix give
the occurrences of all runs, of single terms and of longer ones, and the number of records follows
by taking off the neighbours of one record within an interval. A record lies in one block, so
both counts of the blocks add up; a term that most records hold is one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.functions import text
from arbolith.runtime import materialize

#: Terms after which a block of records is closed; a record is never parted.
BLOCK_TERMS = 1 << 19
#: Stands between the terms of a run.
JOIN = "\x1f"

_COUNTS = "field_name string, n int, term string, occurrences long, records long"


def suffix_array(tokens: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes in order, and how many tokens each shares with the one before.

    ``left`` tells how many tokens of its record start at each place; a suffix ends with its
    record. By doubling prefixes: log2 of the longest record sorts, whose ranks also give the
    common prefixes by steps of powers of two. Equal suffixes stand in the order of their places.
    """
    size = len(tokens)
    levels = [tokens.astype(np.int64)]
    step, most = 1, int(left.max()) if size else 0
    kinds = len(np.unique(tokens))
    while step < most:
        rank = levels[-1]
        second = np.zeros(size, dtype=np.int64)
        longer = np.flatnonzero(left > step)
        second[longer] = rank[longer + step] + 1
        found, rank = np.unique(rank * (size + 1) + second, return_inverse=True)
        levels.append(rank)
        step *= 2
        if len(found) == kinds:  # a doubling that tells no more apart: nor will the next
            break
        kinds = len(found)
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(size, dtype=np.int64)
    if size > 1:
        a, b, same = order[:-1], order[1:], common[1:]
        for k in range(len(levels) - 1, -1, -1):
            while True:  # once, but at the highest level, where doubling ended early
                open_ = np.flatnonzero((left[a] - same >= 1 << k) & (left[b] - same >= 1 << k))
                hit = open_[levels[k][a[open_] + same[open_]] == levels[k][b[open_] + same[open_]]]
                same[hit] += 1 << k
                if k < len(levels) - 1 or not len(hit):
                    break
    return order, common


def intervals(tokens: np.ndarray, record: np.ndarray, longest: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, first position, occurrences, records) of each distinct run of n tokens, for n up to ``longest`` (None: any).

    ``record`` tells the record of each token and doesn't fall; runs don't cross records. A run is
    an interval of suffixes with a common prefix of n tokens at least: as wide as it occurs, less
    the neighbours of one record within it as many records have it.
    """
    ends = np.r_[np.flatnonzero(np.diff(record)) + 1, len(record)] if len(record) else np.empty(0, np.int64)
    left = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(record))
    order, common = suffix_array(tokens, left)
    left, owner = left[order], record[order]
    for n in range(1, (int(left.max()) if len(left) else 0) + 1):
        if longest is not None and n > longest:
            break
        whole = left >= n
        order, common, left, owner = order[whole], _least_between(common, whole), left[whole], owner[whole]
        opens = common < n
        opens[0] = True
        interval = np.cumsum(opens) - 1
        occurrences = np.bincount(interval)
        by_record = np.lexsort((owner, interval))
        a, b = interval[by_record], owner[by_record]
        twice = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        yield n, order[opens], occurrences, occurrences - np.bincount(a[1:][twice], minlength=len(occurrences))


def _least_between(common: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The common prefix of each kept suffix with the kept one before: the least of those in between."""
    at = np.flatnonzero(kept)
    starts = np.r_[0, at[:-1] + 1] if len(at) else at
    return np.minimum.reduceat(common[: at[-1] + 1], starts) if len(at) else common[:0]


def _counted(pdf: pd.DataFrame, longest: int | None) -> Iterator[pd.DataFrame]:
    for field, part in pdf.groupby("field_name", sort=True):
        lists = [x for x in part["terms"] if x is not None and len(x)]
        if not lists:
            continue
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        codes, words = pd.factorize(np.concatenate(lists))
        record = np.repeat(np.arange(len(lists)), size)
        for n, first, occurrences, records in intervals(codes, record, longest):
            terms = words[codes[first]] if n == 1 else [JOIN.join(words[codes[p : p + n]]) for p in first]
            yield pd.DataFrame({"field_name": field, "n": np.int32(n), "term": terms, "occurrences": occurrences, "records": records})


def _count_blocks(longest: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += int(pdf["terms"].map(len).sum())
            if size >= BLOCK_TERMS:
                yield from _counted(pd.concat(held, ignore_index=True), longest)
                held, size = [], 0
        if held:
            yield from _counted(pd.concat(held, ignore_index=True), longest)

    return run


def term_counts(records: DataFrame, fields: dict[str, Column], longest: int | None = 1) -> DataFrame:
    """(field_name, n, term, occurrences, records) of all runs of up to ``longest`` terms, of any length if None.

    ``records`` has a row per record, ``fields`` gives each field's array of terms. Null arrays and
    null or empty terms don't count. Runs of several terms are joined by JOIN. No rows, no counts.
    """
    rows = F.array(*[F.struct(F.lit(n).alias("field_name"), c.alias("terms")) for n, c in fields.items()])
    lists = records.select(F.inline(rows)).where("size(terms) > 0")
    counted = lists.mapInPandas(_count_blocks(longest), _COUNTS)
    return counted.groupBy("field_name", "n", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def split_terms(values: Column) -> Column:
    """The terms of an array of texts: each cut at commas and normalised, empty ones dropped."""
    parts = F.flatten(F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.split(x, ",")))
    return F.filter(F.transform(parts, text.term), lambda x: x != "")


def addition_records(additions: DataFrame) -> DataFrame:
    """(add_key, rank, flags), each add_key once: the delivery loaded last (ties: the larger values)."""
    chosen = F.max(F.struct("loaded_at", "rank", "flags")).alias("r")
    return additions.groupBy("add_key").agg(chosen).select("add_key", "r.rank", "r.flags")


def addition_terms(records: DataFrame, longest: int | None = 1) -> DataFrame:
    """Counts of the terms of ``rank`` and ``flags``; a rank is one term."""
    rank = F.filter(F.array(text.term(F.col("rank"))), lambda x: x.isNotNull() & (x != ""))
    return term_counts(records, {"rank": rank, "flags": split_terms(F.col("flags"))}, longest)


def marked_terms(additions: DataFrame, rare: int = 3, common: float = 0.2) -> DataFrame:
    """(field_name, term, mark): ``rare`` in at most 3 records, ``common`` in more than a fifth of all.

    All records count, those without terms included. A term that is both is rare.
    """
    records = materialize(addition_records(additions))
    total = records.count()
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common")
    return addition_terms(records).select("field_name", "term", mark.alias("mark")).where("mark is not null")
