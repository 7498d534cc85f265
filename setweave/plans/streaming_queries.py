"""Queries that run streams over the tables to completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.plans.expansion_queries import SEEDS, TWO
from setweave.plans.text_queries import load
from setweave.runtime import scratch_path
from setweave.streaming import expansion as S


def _stream(spark, sf: str, name: str) -> DataFrame:
    table = load(spark, sf, name)
    return spark.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/{name}.parquet*")


def stream_expand(spark, sf):
    """Expansion over the pages as a stream; the same sums as over all of them at once."""
    store, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    pages = _stream(spark, sf, "warc").select(F.col("record_id").alias("doc_id"), F.col("body").alias("text"))
    S.expand_stream(pages, SEEDS, store, checkpoint, TWO, availableNow=True).awaitTermination()
    return S.running_weights(spark, store).withColumn("wlw", F.round("wlw", 6))


#: Batches that the streams below come in.
BATCHES = 4


def _in_batches(spark, table: DataFrame, id_col: str, name: str) -> DataFrame:
    """A table as a stream of batches, by ranges of its ids."""
    folder, most = scratch_path(spark, name), table.agg(F.max(id_col)).first()[0] or 0
    for k in range(BATCHES):  # a file each, one after the other, so they are read in this order
        part = table.where(F.floor(F.col(id_col) * BATCHES / F.lit(most + 1)) == k)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(folder)


def stream_once(spark, sf):
    """Ids of pages that come twice, two batches apart: the second time they are dropped."""
    out, checkpoint = scratch_path(spark, "once"), scratch_path(spark, "once-checkpoint")
    rows = load(spark, sf, "warc").where("fetched_at IS NOT NULL").select("record_id", "fetched_at")
    twice = rows.select("record_id", "fetched_at", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    table = twice.select(F.col("record_id").alias("doc_id"), "fetched_at", (F.col("again") * 2 + F.col("record_id") % 2).alias("batch"))
    S.once(_in_batches(spark, table, "batch", "twice").select("doc_id", "fetched_at"), late="36500 days").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("doc_id")


def stream_extraction_counts(spark, sf):
    """Contents per wrapper and day of the stream of extractions in batches: windows that the watermark has passed, without
    the contents that came after that."""
    out, checkpoint = scratch_path(spark, "counts"), scratch_path(spark, "counts-checkpoint")
    table = load(spark, sf, "extractions").select("ext_id", "wrapper_id", "tf", F.col("seen_at").cast("timestamp").alias("seen_at"))
    rows = S.extraction_counts(_in_batches(spark, table, "ext_id", "extractions"), late="2 hours")
    rows.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (stream_expand, stream_once, stream_extraction_counts)}

from setweave.plans.expansion_queries import _FACTS  # noqa: E402

# a batch's contents are late by the watermark that the batch before it closed windows with
SQL = {
    "stream_expand": f"WITH {_FACTS} SELECT name AS entity, CAST(sum(tf) AS DOUBLE) AS etf, CAST(count(DISTINCT doc_id) AS DOUBLE) AS edf, CAST(count(*) AS DOUBLE) AS ewf, round(sum(ln(ctx_len) / ln(doc_len)), 6) AS wlw FROM facts GROUP BY name",
    "stream_once": "SELECT record_id AS doc_id FROM warc WHERE fetched_at IS NOT NULL",
    "stream_extraction_counts": f"""WITH b AS (SELECT *, ext_id * {BATCHES} // (SELECT max(ext_id) + 1 FROM extractions) AS k, time_bucket(INTERVAL 1 DAY, seen_at) AS w FROM extractions WHERE seen_at IS NOT NULL),
marks AS (SELECT i AS k, (SELECT date_trunc('millisecond', max(seen_at)) - INTERVAL 2 HOUR FROM b WHERE b.k < i - 1) AS mark FROM range(0, {BATCHES + 2}) AS r(i)),
kept AS (SELECT b.* FROM b JOIN marks USING (k) WHERE mark IS NULL OR w + INTERVAL 1 DAY > mark)
SELECT w AS window_start, wrapper_id, count(*) AS n, sum(tf) AS tf FROM kept WHERE w + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE k = {BATCHES + 1}) GROUP BY ALL""",
}
