"""Nested addition documents as related flat tables.

One projection of nested ``transform`` calls gives every entry its ancestors' keys and positions,
``flatten`` joins the arrays, and one ``inline`` for each target table emits its rows from that
projection, which is written once. Nothing is shuffled but the choice of the row loaded last for
a repeated key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.runtime import materialize

_REPEATS = "spark.sql.variant.allowDuplicateKeys"
#: Follows a body when it is parsed, so that anything behind its first value is seen.
_END = "\\u0002end\\u0002"


def _strict(text: Column) -> Column:
    """The text as a variant if it is one JSON value by RFC 8259 and nothing else, or null."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    whole = F.try_variant_get(wrapped, "$[1]", "string") == F.lit("\u0002end\u0002")
    single = F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    return F.when(whole & single, F.try_variant_get(wrapped, "$[0]", "variant"))


def _entries(value: Column) -> Column:
    """A variant as an array of its entries; a single value counts as a list of one; none if absent."""
    listed = F.coalesce(value.try_cast("array<variant>"), F.array(value))
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<variant>")).otherwise(listed)


def _object(value: Column, *members: str) -> Column:
    """A variant as a struct of these members (variants themselves) if it is an object, else null."""
    return value.try_cast(f"struct<{','.join(f'{m}: variant' for m in members)}>")


def _text(value: Column) -> Column:
    """A scalar as text, a string as it is; null for null, objects and lists."""
    return F.when(_object(value).isNull() & value.try_cast("array<variant>").isNull(), value.try_cast("string"))


def parse_documents(df: DataFrame, key: str = "doc_key", body: str = "body", loaded: str = "loaded_at") -> DataFrame:
    """(doc_key, readable, id, study_id, taxa, sources, flags): each key once, the row loaded last (ties: the larger body).

    The three lists hold the rows of the flat tables: every entry with its document's taxon_pos
    and its own child_pos, both from 0 and counting all entries, null ones too. A document sent as
    a string within ``addition_document`` is read like one in a file. A null body or one that isn't
    strict JSON has readable = false, as has one whose inner document isn't. Rows with a null key
    count as one document. The documents are parsed here, once; the session's settings stay.
    """
    conf = df.sparkSession.conf
    before = conf.get(_REPEATS, None)
    conf.set(_REPEATS, "true")  # a repeated member is valid JSON
    try:
        return materialize(_projected(df, key, body, loaded))
    finally:
        conf.unset(_REPEATS) if before is None else conf.set(_REPEATS, before)


def _projected(df: DataFrame, key: str, body: str, loaded: str) -> DataFrame:
    last = df.groupBy(F.col(key).alias("doc_key")).agg(F.max(F.struct(F.col(loaded).alias("at"), F.col(body).alias("body"))).alias("row"))
    outer = last.select("doc_key", _strict(F.col("row.body")).alias("outer"))
    sent = _object(F.col("outer"), "addition_document")["addition_document"]
    opened = outer.withColumn("sent", sent).select(
        "doc_key",
        F.when(F.col("sent").isNull() | F.is_variant_null("sent"), F.col("outer"))
        .when(F.schema_of_variant("sent") == "STRING", _strict(F.col("sent").try_cast("string")))
        .otherwise(F.col("sent"))
        .alias("doc"),
    )
    parts = opened.select("doc_key", F.col("doc").isNotNull().alias("readable"), _object(F.col("doc"), "id", "study_id", "taxa").alias("d"))
    listed = F.transform(_entries(F.col("d.taxa")), lambda x, i: F.struct(i.cast("long").alias("taxon_pos"), _object(x, *_MEMBERS).alias("entry")))
    kept = parts.select("doc_key", "readable", _text(F.col("d.id")).alias("id"), _text(F.col("d.study_id")).alias("study_id"), F.filter(listed, lambda x: x["entry"].isNotNull()).alias("entries"))
    return kept.select("doc_key", "readable", "id", "study_id", _taxa().alias("taxa"), _sources().alias("sources"), _flags().alias("flags"))


#: Members of a taxon: those of one value, and its two lists.
_FIELDS = ("name", "rank", "parent", "parent_tag", "tag")
_MEMBERS = ("ott_id", *_FIELDS, "sources", "flags")


def _digits(value: Column) -> Column:
    text = F.regexp_replace(_text(value), r"\s+", "")
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text).otherwise(F.lit(""))


def _taxa() -> Column:
    """One entry per taxon with its scalar fields as text."""
    return F.transform(
        "entries",
        lambda t: F.struct(
            t["taxon_pos"].alias("taxon_pos"),
            _digits(t["entry"]["ott_id"]).alias("ott_id"),
            *[_text(t["entry"][f]).alias(f) for f in _FIELDS],
        ),
    )


def _sources() -> Column:
    """One entry per source with a text: the ``source`` of an object or an entry that is a string."""

    def one(t: Column, s: Column, o: Column, j: Column) -> Column:
        own = F.when(o.isNotNull(), _text(o["source"])).otherwise(_text(s))
        return F.struct(t["taxon_pos"].alias("taxon_pos"), j.cast("long").alias("child_pos"), own.alias("source"), _text(o["source_type"]).alias("source_type"))

    nested = F.transform("entries", lambda t: F.transform(_entries(t["entry"]["sources"]), lambda s, j: one(t, s, _object(s, "source", "source_type"), j)))
    return F.filter(F.flatten(nested), lambda x: x["source"].isNotNull() & (x["source"] != ""))


def _flags() -> Column:
    """One entry per flag that isn't null."""
    nested = F.transform(
        "entries",
        lambda t: F.transform(
            _entries(t["entry"]["flags"]),
            lambda f, j: F.struct(t["taxon_pos"].alias("taxon_pos"), j.cast("long").alias("child_pos"), _text(f).alias("flag")),
        ),
    )
    return F.filter(F.flatten(nested), lambda x: x["flag"].isNotNull())


def flat_taxa(parsed: DataFrame) -> DataFrame:
    """(doc_key, taxon_pos, ott_id, name, rank, parent, parent_tag, tag), one row per taxon."""
    return parsed.select("doc_key", F.inline("taxa"))


def flat_sources(parsed: DataFrame) -> DataFrame:
    """(doc_key, taxon_pos, child_pos, source, source_type), one row per source with a text."""
    return parsed.select("doc_key", F.inline("sources"))


def flat_flags(parsed: DataFrame) -> DataFrame:
    """(doc_key, taxon_pos, child_pos, flag), one row per flag that isn't null."""
    return parsed.select("doc_key", F.inline("flags"))


def flat_rows(parsed: DataFrame) -> DataFrame:
    """(doc_key, taxon_pos, child_table, child_pos, child_value) of all flat tables and unreadable bodies."""
    row = lambda df, table, pos, child, value: df.select(
        "doc_key", pos.alias("taxon_pos"), F.lit(table).alias("child_table"), child.alias("child_pos"), value.alias("child_value")
    )
    pos, child, none = F.col("taxon_pos"), F.col("child_pos"), F.lit(-1).cast("long")
    return (
        row(flat_taxa(parsed), "taxon", pos, none, F.col("ott_id"))
        .unionByName(row(flat_sources(parsed), "source", pos, child, F.col("source")))
        .unionByName(row(flat_flags(parsed), "flag", pos, child, F.col("flag")))
        .unionByName(row(parsed.where("not readable"), "unreadable", none, none, F.lit("")))
    )
