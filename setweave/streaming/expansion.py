"""Set expansion over pages that keep arriving.

Patterns are induced page by page, so each micro-batch is expanded on its own, and the mergeable weights (frequencies,
pattern length) are kept as running sums per entity. Batches write their sums under their number: a batch that runs again
after a failure overwrites itself, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from setweave.operators import expansion as X
from setweave.operators import patterns as P


def batch_weights(pages: DataFrame, seeds: Sequence[X.Seed], settings: P.Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``entity, etf, edf, ewf, wlw`` of one batch; all of them add up over batches of different pages."""
    facts = X.facts_of(P.induce(pages, seeds, settings, id_col, text_col), id_col)
    per = facts.groupBy("entity", "doc", "wrapper").agg(F.sum("tf").alias("tf"), F.max(F.log("ctx_len") / F.log("doc_len")).alias("w"))
    return per.groupBy("entity").agg(F.sum("tf").cast("double").alias("etf"), F.count_distinct("doc").cast("double").alias("edf"), F.count(F.lit(1)).cast("double").alias("ewf"), F.sum("w").alias("wlw"))


def once(pages: DataFrame, id_col: str = "doc_id", at: str = "fetched_at", late: str = "1 day") -> DataFrame:
    """A stream of pages without those that come again under the same id while the watermark is within ``late`` of the
    first one; what is later than the watermark is dropped. The state is an id for each page of that time."""
    return pages.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([id_col])


def expand_stream(pages: DataFrame, seeds: Sequence[X.Seed], store: str, checkpoint: str, settings: P.Settings = P.Settings(bracket=2), id_col: str = "doc_id", text_col: str = "text", at: str | None = None, late: str = "1 day", **trigger) -> StreamingQuery:
    """Start expanding a stream of pages; ``store`` gets a partition of sums per batch. Give a trigger, such as
    ``availableNow=True``. With ``at``, the column of a page's time, pages that come twice count once (``once``)."""
    pages = pages if at is None else once(pages, id_col, at, late)

    def one(batch: DataFrame, number: int) -> None:
        batch_weights(batch, seeds, settings, id_col, text_col).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def running_weights(spark: SparkSession, store: str) -> DataFrame:
    """The sums over all batches so far."""
    return spark.read.parquet(store).groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("etf", "edf", "ewf", "wlw")])


def extraction_counts(contents: DataFrame, at: str = "seen_at", late: str = "2 hours", window: str = "1 day") -> DataFrame:
    """``window_start, wrapper_id, n, tf`` of a stream of extracted contents: counts per wrapper and window of event time.

    A window is final once the watermark, the greatest time seen less ``late``, has passed its end; then it comes out in
    append mode, and contents of it that come later are dropped.
    """
    contents = contents.withColumn(at, F.col(at).cast("timestamp"))
    return contents.withWatermark(at, late).groupBy(F.window(at, window), "wrapper_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")).select(F.col("window.start").alias("window_start"), "wrapper_id", "n", "tf")
