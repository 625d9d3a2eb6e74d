"""A folder of addition documents as a stream: each new document is applied once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbolith import runtime
from arbolith.operators import additions, resolve
from arbolith.runtime import materialize


def document_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(doc_key, body, loaded_at) of files as they come; the key is a hash of the file's name."""
    files = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).format("text").load(folder)
    return files.select(F.xxhash64(F.input_file_name()).alias("doc_key"), F.col("value").alias("body"), F.current_timestamp().alias("loaded_at"))


def apply_stream(stream: DataFrame, known: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the new taxa of each batch to the parquet folder ``target``, partitioned by batch_no.

    ``known`` (ott_id) is what was there before; what other batches wrote is known too. A batch
    that is run again after a failure replaces its own partition, so it adds nothing twice. Of the
    ids known only those that a batch names are looked at, by a column scan without a shuffle of
    the target where the batch is small.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialize(additions.document_taxa(batch))
        named = rows.select("ott_id").unionByName(rows.select(F.col("parent").alias("ott_id"))).where("ott_id is not null").distinct()
        there = known.select("ott_id").join(named, "ott_id", "left_semi")
        if runtime.exists(spark, target):
            before = spark.read.parquet(target).where(F.col("batch_no") != number).select("ott_id")
            there = there.unionByName(before.join(named, "ott_id", "left_semi"))
        checked = additions.judged(rows, materialize(there.distinct()))
        additions.new_taxa(checked).write.mode("overwrite").parquet(f"{target}/batch_no={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def match_stream(names: DataFrame, store) -> DataFrame:
    """Exact and synonym matches of a stream of (query_id, qname) against a store: a stream-static join without state."""
    queries = names.where("qname is not null").select("query_id", F.lower("qname").alias("q"))
    index = resolve.index_of(store)
    return queries.join(index, queries["q"] == index["key_lc"]).select("query_id", "q", "kind", "name", "ott_id", "rank")


def request_counts(requests: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling counts of requests per key with a watermark."""
    return requests.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
