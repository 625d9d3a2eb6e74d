"""Derived columns of taxa and scalar rules on names, as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from arbolith import schema


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def dubious(flags: Column) -> Column:
    """A suppressing flag is there and no override, whatever their order; no flags, not dubious."""
    given = F.coalesce(flags, F.array().cast("array<string>"))
    return F.arrays_overlap(given, _strings(schema.SUPPRESSING)) & ~F.array_contains(given, schema.OVERRIDE)


def is_specific(rank: Column) -> Column:
    return F.coalesce(F.lower(rank).isin(*schema.SPECIFIC_RANKS), F.lit(False))


def rank_class(rank: Column) -> Column:
    return F.when(is_specific(rank), "specific").when(F.lower(rank) == "genus", "genus").otherwise("higher")


def is_higher(rank: Column) -> Column:
    """As autocompletion tells it: by the shorter list of ranks, case as it is; null counts as higher."""
    return ~F.coalesce(rank.isin(*schema.NOT_HIGHER_RANKS), F.lit(False))


def unique_name(uniqname: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(uniqname, F.lit("")), name)


def tax_sources(sources: Column) -> Column:
    """The list of sources; an empty string is a list of one empty string, null an empty list."""
    return F.when(sources.isNull(), F.array().cast("array<string>")).otherwise(F.split(sources, ",", -1))


def source_ids(sources: Column) -> Column:
    """The sources that are ids: with a colon, not at the end, and no web address."""
    return F.filter(tax_sources(sources), lambda s: s.contains(":") & ~s.endswith(":") & ~s.startswith("http"))


def known_flags(flags: Column) -> Column:
    """Names of the constants of the flags that are known, in the order of the fixed list."""
    given = F.coalesce(flags, F.array().cast("array<string>"))
    parts = [F.when(F.array_contains(given, label), F.lit(constant)) for label, constant in schema.FLAG_CONSTANTS.items()]
    return F.array_compact(F.array(*parts))


def newick_name(name: Column) -> Column:
    """A label for trees: quoted if it holds signs of the format, else with underscores for blanks."""
    marks = r"[()\[\]{}:;,'\"]"
    return F.when(name.rlike(marks), F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(F.translate(name, " ", "_"))


def label(fmt: str, name: Column, ott_id: Column) -> Column:
    """A node's label in one of the four formats."""
    plain = F.coalesce(name, F.lit(""))
    if fmt == "name":
        return newick_name(plain)
    if fmt == "id":
        return ott_id.cast("string")
    if fmt == "name_and_id":
        return newick_name(F.concat(plain, F.lit("_ott"), ott_id.cast("string")))
    if fmt == "original_name":
        return plain
    raise ValueError(f"unknown label format: {fmt}")


def list_name(name: Column) -> Column:
    """Signs that lists and trees can't hold become underscores, each one by itself."""
    bad = " \t.,():;'"
    return F.translate(name, bad, "_" * len(bad))


def version_parts(source: Column) -> tuple[Column, Column]:
    """(name, version) of a source such as abc2.9draft12; without a version the name is the source."""
    pattern = r"^([^0-9.]+)\.?(([0-9]+(\.[0-9]+)?).*)$"
    fits = source.rlike(pattern)
    return F.when(fits, F.regexp_extract(source, pattern, 1)).otherwise(source), F.when(fits, F.regexp_extract(source, pattern, 3))


def version_weburl(weburl: Column, name: Column, version: Column, old: str | None, prefix: str | None) -> Column:
    """``prefix`` + name + version in place of the page ``old``, if both are given; else the page as it is."""
    if old is None or prefix is None:
        return weburl
    return F.when((weburl == old) & version.isNotNull(), F.concat(F.lit(prefix), name, version)).otherwise(weburl)


def comma_list(text: Column) -> Column:
    return F.split(text, r"\s*,\s*", -1)


def max_edits(length: Column) -> Column:
    """Edits allowed for a name of that length."""
    steps = ((9, 1), (14, 2), (19, 3))
    return reduce(lambda acc, s: acc.when(length < s[0], s[1]), steps[1:], F.when(length < steps[0][0], steps[0][1])).otherwise(4)


def fuzzy_accepts(distance: Column, query: Column, target: Column) -> Column:
    """Whether a target at that distance is similar enough; a query of one letter matches nothing."""
    edits = max_edits(F.length(query))
    return (F.length(query) > 1) & (distance * F.length(query) < (edits + 1) * F.least(F.length(query), F.length(target)))


def fuzzy_score(query: Column, target: Column) -> Column:
    """(shorter length - distance) / shorter length, the query in lower case against the name as written."""
    shorter = F.least(F.length(query), F.length(target)).cast("double")
    return (shorter - F.levenshtein(query, target)) / shorter


def distance_factor(distance: Column, compat: bool = False) -> Column:
    """Weight of a match outside the inferred clade. Without ``compat`` it never raises a score."""
    if compat:
        return F.when(distance == 1, F.lit(float("inf"))).otherwise(1 / F.ln(F.greatest(distance, F.lit(2)).cast("double")))
    return 1 / F.ln(F.greatest(distance, F.lit(3)).cast("double"))
