"""Delimited taxonomy dumps as DataFrames. Lines that can't be read are kept apart, never fatal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arbolith import schema
from arbolith.runtime import exists, with_ordinals
from arbolith.store import LoadOptions, Store

BAR, TAB = r"\t\|\t?", r"\t"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line")).where(F.trim("line") != "")


def _at(parts: Column, k: int) -> Column:
    return F.try_element_at(parts, F.lit(k + 1))


def taxonomy_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, parts) of a taxonomy file: separated by tab-bar-tab, or by tabs where there is no bar; no header."""
    parts = F.split("line", BAR, -1)
    parts = F.when(F.size(parts) == 1, F.split("line", TAB, -1)).otherwise(parts)
    rows = _lines(spark, path).withColumn("parts", F.transform(parts, lambda x: F.trim(x)))
    return rows.where(F.coalesce(_at(F.col("parts"), 0), F.lit("")) != "uid")


def _good(parts: Column) -> Column:
    # A blank parent is a root; a parent that is no number makes the line bad.
    numbers = _at(parts, 0).try_cast("long").isNotNull() & ((F.coalesce(_at(parts, 1), F.lit("")) == "") | _at(parts, 1).try_cast("long").isNotNull())
    return F.coalesce((F.size(parts) >= 2) & numbers, F.lit(False))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """uid, parent, name, rank, sourceinfo, uniqname, flags. Missing columns at the end are empty, so that old
    dumps of four columns are read too. Lines of one column or with bad ids are left to ``bad_taxonomy_lines``."""
    p = F.col("parts")
    text = lambda k: F.coalesce(_at(p, k), F.lit(""))
    return taxonomy_lines(spark, path).where(_good(p)).select(
        _at(p, 0).try_cast("long").alias("ott_id"),
        _at(p, 1).try_cast("long").alias("parent_ott_id"),
        _at(p, 2).alias("name"),
        text(3).alias("rank"),
        text(4).alias("input_sources"),
        text(5).alias("uniqname"),
        F.filter(F.split(text(6), ","), lambda x: x != "").alias("flags"),
    )


def bad_taxonomy_lines(spark: SparkSession, path: str) -> DataFrame:
    return taxonomy_lines(spark, path).where(~_good(F.col("parts"))).select("line")


def _synonym_lines(spark: SparkSession, path: str) -> DataFrame:
    tokens = F.filter(F.split("line", r"[\t|]+", -1), lambda x: F.trim(x) != "")
    rows = _lines(spark, path).withColumn("parts", F.transform(tokens, lambda x: F.trim(x)))
    header = F.array_contains("parts", "uid")
    return rows.where(~header)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """Name and id, separated by any run of tabs and bars; what follows is not used."""
    p = F.col("parts")
    rows = _synonym_lines(spark, path).select(_at(p, 1).try_cast("long").alias("ott_id"), _at(p, 0).alias("name"), F.lit(None).cast("string").alias("source"))
    return rows.where("ott_id is not null and name is not null")


def bad_synonym_lines(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("parts")
    return _synonym_lines(spark, path).where(_at(p, 1).try_cast("long").isNull()).select("line")


def read_forwards(spark: SparkSession, path: str) -> DataFrame:
    """id and replacement, separated by a tab; headers and lines with bad numbers are skipped."""
    p = F.split("line", TAB, -1)
    rows = _lines(spark, path).select(F.trim(_at(p, 0)).try_cast("long").alias("alias_id"), F.trim(_at(p, 1)).try_cast("long").alias("ott_id"))
    return rows.where("alias_id is not null and ott_id is not null")


def read_deprecated(spark: SparkSession, path: str) -> DataFrame:
    """id, name, source info, reason; the header and lines with bad ids are skipped."""
    p = F.split("line", TAB, -1)
    rows = _lines(spark, path).select(
        F.trim(_at(p, 0)).try_cast("long").alias("ott_id"), F.trim(_at(p, 1)).alias("name"), F.trim(_at(p, 2)).alias("source_info"), F.trim(_at(p, 3)).alias("reason")
    )
    return rows.where("ott_id is not null")


def read_version(spark: SparkSession, path: str) -> str | None:
    """The first line of a version file."""
    row = spark.read.option("wholetext", True).text(path).select(F.split("value", r"\r?\n")[0].alias("v")).first()
    return row["v"].strip() if row and row["v"] else None


def load_dumps(spark: SparkSession, folder: str, options: LoadOptions | None = None) -> Store:
    """A store of a folder with taxonomy.tsv, synonyms.tsv (unless left out) and, if there and asked for, forwards.tsv, deprecated.tsv and version.txt."""
    options = options or LoadOptions()

    there = lambda name: exists(spark, f"{folder}/{name}")
    for name in ("taxonomy.tsv", "synonyms.tsv")[: 1 + options.synonyms]:
        if not there(name):
            raise FileNotFoundError(f"{folder}/{name}")
    aliases = read_forwards(spark, f"{folder}/forwards.tsv") if options.aliases and there("forwards.tsv") else spark.createDataFrame([], schema.ALIASES_RAW)
    retired = read_deprecated(spark, f"{folder}/deprecated.tsv") if options.deprecated and there("deprecated.tsv") else spark.createDataFrame([], schema.DEPRECATED_RAW)
    version = read_version(spark, f"{folder}/version.txt") if there("version.txt") else None
    metadata = spark.createDataFrame([(version, None, None)] if version else [], schema.METADATA)
    synonyms = read_synonyms(spark, f"{folder}/synonyms.tsv") if options.synonyms else spark.createDataFrame([], schema.SYNONYMS_RAW)
    return Store(read_taxonomy(spark, f"{folder}/taxonomy.tsv"), synonyms, aliases, retired, metadata, options=options)


def store_path(spark: SparkSession, folder: str, name: str | None = None) -> str:
    """Where a folder's store goes: ``name``, or one made of the version."""
    return name if name else f"ott_v{read_version(spark, f'{folder}/version.txt')}.db"


def read_addition_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(position, file_name, body) of JSON documents, by the length of their names, then the names, then the bodies' hashes.

    Positions are worked out over the names only, by a range partitioning; bodies are read where they are.
    """
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select("path", name.alias("file_name"), F.length(name).alias("size")).distinct()
    order = with_ordinals(listed, ["size", "file_name", "path"], "position").select("position", "path", "file_name")
    return files.join(order, "path").select("position", "file_name", "body")


_TOKEN = r"'(?:[^']|'')*'|[(),;]|:[^(),;]*|[^\s(),:;']+"


def newick_nodes(trees: DataFrame, key: str = "tree_id", text: str = "tree") -> DataFrame:
    """(key, position, parent_position, label, length) of every node of Newick texts, one row each, from 0 in the order of their labels' places.

    Quotes are taken off and doubled ones made single, underscores of plain labels become blanks;
    comments in brackets are left out; a missing label is empty and a missing length null. The top
    has no parent. A text whose parentheses don't match, or a null one, has no nodes.
    """
    kinds = StructType([trees.schema[key], *StructType.fromDDL("position int, parent_position int, label string, length double").fields])

    def nodes(tree: str | None) -> list[tuple]:
        # A label closes its node; children stand before their parent and wait for it, level by level.
        labels, lengths, up, waiting, at = [], [], {}, [[]], None

        def close() -> None:
            nonlocal at
            if at is None:
                labels.append("")
                lengths.append(None)
                at = len(labels) - 1
            for child in kids:
                up[child] = at
            waiting[-1].append(at)
            at = None
            kids.clear()

        kids: list[int] = []
        for token in re.findall(_TOKEN, re.sub(r"\[[^\]]*\]", "", tree or "")):
            if token == "(":
                waiting.append([])
            elif token in ",);":
                close()
                if token == ")":
                    if len(waiting) < 2:
                        return []
                    kids[:] = waiting.pop()
                elif token == ";":
                    break
            elif token[0] == ":":
                if at is None:
                    labels.append("")
                    lengths.append(None)
                    at = len(labels) - 1
                try:
                    lengths[at] = float(token[1:])
                except ValueError:
                    lengths[at] = None
            elif at is not None:  # two labels side by side
                return []
            else:
                labels.append(token[1:-1].replace("''", "'") if token[0] == "'" else token.replace("_", " "))
                lengths.append(None)
                at = len(labels) - 1
        if len(waiting) != 1 or len(waiting[0]) != 1 or at is not None or kids:
            return []
        return [(k, up.get(k), labels[k], lengths[k]) for k in range(len(labels))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, tree in zip(pdf[key], pdf[text], strict=True):
                made = pd.DataFrame(nodes(tree), columns=["position", "parent_position", "label", "length"]).astype({"parent_position": "Int32"})
                made.insert(0, key, k)
                yield made

    return trees.select(key, text).mapInPandas(run, kinds)


def newick_tips(trees: DataFrame, text: str = "tree") -> DataFrame:
    """Adds ``tips``: the labels of the tips of a Newick text, quotes taken off."""
    bare = F.regexp_replace(text, r"\[[^\]]*\]", "")
    found = F.regexp_extract_all(bare, F.lit(r"(?<=[(,])\s*('(?:[^']|'')*'|[^\s(),:;']+)"), F.lit(1))
    return trees.withColumn("tips", F.transform(found, lambda x: F.when(x.startswith("'"), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit("''"), F.lit("'"))).otherwise(x)))
