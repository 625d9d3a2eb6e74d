"""Visually identical texts in one form.

Each text gets one width, one kind of blank, composed accents and no unseen characters. Then the
dominant script of every word with letters of several scripts is found, and its look-alikes are
replaced if the result is a word of the corpus: one that stands there in one script, or that
several words of unlike coding read as. The vocabulary is never gathered: the readings of the
mixed words (few) are looked up in the words of all uniform texts by a semi-join. Texts are
compared as they are after this repair; only words wholly of look-alikes, which have one script
and so nothing to repair, are spelled in Latin for it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbolith.llm import lookalikes
from arbolith.runtime import materialize

#: Buckets of words; bounds what is broadcast to some megabytes, whatever the corpus.
BUCKETS = 1 << 20

_FORM = "id long, raw binary, form string, key binary, words array<string>"


def _mixed_words(foreign: set[str]) -> list[str]:
    return sorted(w for w in foreign if (r := lookalikes.readings(w))[0] and r[1])


def _key(form: str, foreign: set[str] | None = None) -> bytes | None:
    return xxhash.xxh3_128_digest(lookalikes.keyed(form, foreign).encode("utf-8", "surrogatepass")) if form.strip() else None


def _forms(keep_all: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for number, text in zip(pdf["id"], pdf["text"], strict=True):
                raw = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                form = lookalikes.uniform(text)
                foreign = lookalikes.foreign_words(form)
                words = _mixed_words(foreign)
                kept = form if words or keep_all or form != text else None
                out.append((number, raw, kept, None if words else _key(form, foreign), words or None))
            yield pd.DataFrame(out, columns=["id", "raw", "form", "key", "words"])

    return run


def uniform_forms(df: DataFrame, key: str, text: str, keep_all: bool) -> DataFrame:
    """(id, raw, form, key, words) of each text: its hash, its form without look-alike repair, the
    key it is compared by (null while words are to be repaired, or for a text of blanks) and its
    mixed-script words. Unless ``keep_all`` the form is kept only where it differs from the text or
    words are to be repaired."""
    given = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return materialize(given.mapInPandas(_forms(keep_all), _FORM))


def _words(text: Column) -> Column:
    return F.explode(F.split(text, r"[^\p{L}\p{M}]+")).alias("seen")


def word_repairs(df: DataFrame, text: str, forms: DataFrame) -> DataFrame:
    """(word, repaired) of the mixed-script words that read as a word of the corpus.

    The vocabulary is that of the uniform forms: of a text as it is where that is its form (in a
    text with unseen characters parts of words would count), else of the form that was kept. A
    reading that several mixed words share is a word of the corpus too, behind those that stand
    there unmixed. The readings are distinct before the join; the corpus side is cut down to the
    readings before it is made distinct, so what is shuffled is small unless most words are mixed.
    """
    ways = F.pandas_udf(lambda words: words.map(lambda w: list(lookalikes.readings(w)[1])), "array<string>")
    words = forms.where("words is not null").select(F.explode("words").alias("word")).distinct()
    read = materialize(words.select("word", F.posexplode(ways("word")).alias("place", "repaired")))
    wanted = read.groupBy(F.col("repaired").alias("seen")).agg(F.count("*").alias("codings"))
    corpus = df.where(~F.col(text).rlike(f"[{lookalikes.INVISIBLE}]")).select(_words(F.col(text)))
    corpus = corpus.unionByName(forms.where("form is not null").select(_words(F.col("form"))))
    # Before words are moved: those in no bucket of a reading go. At most BUCKETS numbers are broadcast.
    bucket = F.pmod(F.xxhash64("seen"), F.lit(BUCKETS)).cast("int")
    buckets = wanted.select(bucket.alias("bucket")).distinct()
    corpus = corpus.withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket", "left_semi").select("seen").distinct()
    known = wanted.join(corpus.withColumn("stands", F.lit(True)), "seen", "left").where("stands or codings > 1")
    hits = read.join(known, read["repaired"] == known["seen"])
    return hits.groupBy("word").agg(F.min_by("repaired", F.struct(F.col("stands").isNull(), "place")).alias("repaired"))


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for number, raw, form, pairs in zip(pdf["id"], pdf["raw"], pdf["form"], pdf["pairs"], strict=True):
            if pairs is not None and len(pairs):
                table = {p["word"]: p["repaired"] for p in pairs}
                form = unicodedata.normalize("NFC", lookalikes.WORD_WITH_FOREIGN.sub(lambda m: table.get(m[0], m[0]), form))  # noqa: B023
            out.append((number, raw, form, _key(form)))
        yield pd.DataFrame(out, columns=["id", "raw", "form", "key"])


def repaired(df: DataFrame, key: str, text: str, keep_all: bool) -> DataFrame:
    """(id, raw, form, key): every text with its repaired form and the key it is compared by.

    A mixed-script word stays as it is if no text of the corpus holds it in one script and no other
    mixed word reads like it. The key is that of the repaired form, words wholly of look-alikes
    being spelled in Latin. Null texts are left out; empty ones and those of blanks have a null key. Without
    ``keep_all`` the form is null where the text is its form.
    """
    forms = uniform_forms(df, key, text, keep_all)
    repairs = word_repairs(df, text, forms)
    broken = forms.where("words is not null")
    found = broken.select("id", "raw", F.explode("words").alias("word")).join(repairs, "word")
    pairs = found.groupBy("id", "raw").agg(F.collect_list(F.struct("word", "repaired")).alias("pairs"))
    mended = broken.select("id", "raw", "form").join(pairs, ["id", "raw"], "left").mapInPandas(_apply, "id long, raw binary, form string, key binary")
    return forms.where("words is null").select("id", "raw", "form", "key").unionByName(mended)


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return materialize(repaired(df, key, text, False).select("id", "raw", "key").distinct())


def identical_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, class_id, n_links): the smallest id of the texts that look like each text, and how many of them differ from it in characters.

    One row per id and text; a blank text is a class of its own. Nothing grows with the square of a
    class: links follow from the counts of equal keys and equal texts.
    """
    keys = _keyed(df, key, text)
    looks = keys.where("key is not null").groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("n_alike"))
    copies = keys.where("key is not null").groupBy("key", "raw").agg(F.count("*").alias("n_copies"))
    classes = copies.join(looks, "key").select("key", "raw", "class_id", (F.col("n_alike") - F.col("n_copies")).alias("links"))
    out = keys.join(classes, ["key", "raw"], "left")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def identical_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first, of texts that differ in characters but look the same.

    Texts are first put into classes of equal characters; pairs are made of classes with one key
    and only then of their members, so a large group of plain copies costs nothing. A repeated id
    counts once with each text; null and blank texts have no pairs.
    """
    keys = _keyed(df, key, text).where("key is not null")
    varied = keys.groupBy("key").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("key")
    members = materialize(keys.join(varied, "key", "left_semi"))
    classes = members.select("key", "raw").distinct()
    twins = classes.select("key", F.col("raw").alias("raw_a")).join(classes.select("key", F.col("raw").alias("raw_b")), "key").where("raw_a < raw_b")
    left = members.select("key", F.col("raw").alias("raw_a"), F.col("id").alias("id_a"))
    right = members.select("key", F.col("raw").alias("raw_b"), F.col("id").alias("id_b"))
    both = twins.join(left, ["key", "raw_a"]).join(right, ["key", "raw_b"]).where("id_a <> id_b")
    return both.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()
