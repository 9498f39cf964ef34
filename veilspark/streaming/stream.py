"""Structured Streaming forms (extensions; the reference has no streaming).

* Stateless redaction of a document stream: the same JVM expression as the
  batch path, so stream and batch results are identical.
* Windowed rollup of a measurement stream with a watermark. Exact
  percentiles would keep every value in state, so the stream uses
  ``percentile_approx`` (bounded state) and says so in its column name.

Both run with ``trigger(availableNow=True)`` and write parquet with a
checkpoint under the shared checkpoint folder, so a restarted job resumes
exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redact import redact_rules
from ..sources.jsonl import scratch_path


def _source(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    table = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{table}*")


def redact_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream ``documents`` through rule redaction into parquet; return the output table."""
    out, ckpt = scratch_path(spark, "stream-redact"), scratch_path(spark, "stream-redact-ckpt")
    red = redact_rules(_source(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    q = (red.select("doc_id", "lang", "redacted", "matches").writeStream.format("parquet")
            .option("path", out).option("checkpointLocation", ckpt).outputMode("append")
            .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def windowed_rollup_stream(spark: SparkSession, sf_dir: str, window: str = "1 day",
                           watermark: str = "1 hour", files_per_batch: int | None = None) -> DataFrame:
    """Per (day window, event type): count, mean value and approximate median.

    Rows that come after the watermark has passed the end of their window are
    dropped. ``files_per_batch`` bounds a micro-batch (all files, if not given).
    """
    out, ckpt = scratch_path(spark, "stream-rollup"), scratch_path(spark, "stream-rollup-ckpt")
    # event time must be a zoned TIMESTAMP; the zone-less wall clock is read as UTC
    # whatever the session time zone is
    as_utc = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    ev = _source(spark, sf_dir, "events", files_per_batch).withColumn("ts", as_utc).withWatermark("ts", watermark)
    agg = (ev.groupBy(F.window("ts", window).alias("w"), "event_type")
             .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"),
                  F.percentile_approx("value", 0.5, 10000).alias("approx_p50_value")))

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # an epoch that runs again replaces its own folder only
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    # update mode: a micro-batch brings the windows it changed, and the watermark drops the state of closed ones
    q = (agg.writeStream.outputMode("update").option("checkpointLocation", ckpt)
            .foreachBatch(write_batch).trigger(availableNow=True).start())
    q.awaitTermination()
    newest = spark.read.parquet(out).groupBy("w", "event_type").agg(
        F.max_by(F.struct("n", "mean_value", "approx_p50_value"), "epoch").alias("x"))
    return newest.select("w", "event_type", "x.*")
