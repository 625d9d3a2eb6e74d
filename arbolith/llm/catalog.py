"""Queries on text: names as typed, terms, containers, leaks, look-alikes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbolith.llm import leaks, names, packing, sight, terms


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of a public tokenizer's ranks; another path can be given to the operators."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.resolve_names(*[_table(spark, sf, t) for t in ("tnrs_requests", "canonical_names", "synonyms")])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return terms.marked_terms(_table(spark, sf, "additions"))


def p5_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all runs of terms, whatever their length."""
    return terms.addition_terms(terms.addition_records(_table(spark, sf, "additions")), None)


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    counts = packing.token_counts(_table(spark, sf, "documents"), "doc_id", "text", tokenizer_path())
    return packing.containers(counts).withColumnRenamed("id", "doc_id")


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """(check_name, n): texts placed, and how many tokens, pieces and containers break a rule."""
    documents = _table(spark, sf, "documents")
    return packing.checks(packing.token_counts(documents, "doc_id", "text", tokenizer_path()))


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leak_spans(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_spans(spark, sf).select("doc_id", "item_id").distinct()


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.without_leaks(_table(spark, sf, "documents"), p8_spans(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sight.identical_pairs(_table(spark, sf, "documents"), "doc_id", "text")


def p9_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each text's class of texts that look the same, and its number of links."""
    return sight.identical_classes(_table(spark, sf, "documents"), "doc_id", "text")


def p9_texts(spark: SparkSession, sf: str) -> DataFrame:
    done = sight.repaired(_table(spark, sf, "documents"), "doc_id", "text", True)
    return done.select(F.col("id").alias("doc_id"), F.col("form").alias("text"))


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_runs, p7_containers, p7_checks, p8_found, p8_spans, p8_cleaned, p9_found, p9_classes, p9_texts)}

_P5 = r"""
with rec as (select add_key, rank, flags from additions qualify row_number() over (partition by add_key order by loaded_at desc) = 1),
raw as (
  select add_key, 'rank' as field_name, rank as part from rec
  union all select add_key, 'flags', unnest(string_split(f, ',')) from (select add_key, unnest(flags) as f from rec) where f is not null),
terms as (
  select add_key, field_name,
    regexp_replace(regexp_replace(lower(part), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}_-]+', '_', 'g'), '^_+|_+$', '', 'g') as term
  from raw where part is not null),
counts as (select field_name, term, count(*) as occurrences, count(distinct add_key) as records from terms where term <> '' group by all)
"""

ORACLE = {
    "p5_found": _P5
    + """select field_name, term, case when records <= 3 then 'rare' else 'common' end as mark
from counts where records <= 3 or records > 0.2 * (select count(*) from rec)""",
    "p7_checks": """select 'texts' as check_name, count(*) as n from documents where text <> ''
union all select unnest(['lost_tokens', 'split_short', 'overfull', 'parts_out_of_place', 'fill_below_98_percent']), 0""",
    "p5_runs": _P5
    + r""", norm as (
  select add_key, 'flags' as field_name, flatten(list_transform(list_filter(flags, lambda f: f is not null), lambda f: string_split(f, ','))) as parts from rec
  union all select add_key, 'rank', [rank] from rec where rank is not null),
clean as (
  select add_key, field_name, list_filter(list_transform(parts, lambda p: regexp_replace(regexp_replace(lower(p), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}_-]+', '_', 'g'), '^_+|_+$', '', 'g')), lambda t: t <> '') as l
  from norm),
sized as (select add_key, field_name, l, unnest(range(1, len(l) + 1)) as n from clean),
spots as (select add_key, field_name, l, n, unnest(range(1, len(l) - n + 2)) as k from sized)
select field_name, cast(n as int) as n, array_to_string(l[k:k + n - 1], chr(31)) as term, count(*) as occurrences, count(distinct add_key) as records from spots group by all""",
}
