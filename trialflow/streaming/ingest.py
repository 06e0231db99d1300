"""Incremental ingest of records and live peaks of resource samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trialflow.operators.rules import Rule, split

BATCH = "ingest_batch"


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    """The stored table, None before its first batch; any other failure of the read is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_new(
    table: str, key: str, rules: Sequence[Rule] = (), violations: str | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: append sound rows whose key is not stored yet.

    Each batch owns one partition folder and overwrites it, so a batch that is retried
    after a failure leaves the same rows: exactly once by id. Copies in the batch and in
    the stored table are dropped here, however far apart they arrive.
    """

    def add(rows: DataFrame, path: str, keys: list[str], number: int) -> None:
        rows = rows.dropDuplicates(keys)
        known = _stored(rows.sparkSession, path, rows.withColumn(BATCH, F.lit(0).cast("bigint")).schema)
        if known is not None:
            old = known.where(F.col(BATCH) != number).select(*[F.col(k).alias(f"old_{k}") for k in keys])
            rows = rows.join(old, [F.col(k).eqNullSafe(F.col(f"old_{k}")) for k in keys], "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    def write(batch: DataFrame, number: int) -> None:
        good, bad = split(batch, rules, [key]) if rules else (batch, None)
        add(good, table, [key], number)
        if bad is not None and violations is not None:
            add(bad, violations, [key, "rule"], number)

    return write


def ingest_stream(
    source: DataFrame,
    table: str,
    checkpoint: str,
    key: str = "trial_id",
    event_time: str = "started",
    watermark: str = "1 day",
    rules: Sequence[Rule] = (),
    violations: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the exactly-once-by-id ingest of a record stream into a Parquet table.

    The stored table knows the ids, so the stream holds no state: the watermark only shows
    in its progress, and no record is too late.
    """
    timed = source.withColumn(event_time, F.col(event_time).cast("timestamp"))
    writer = (
        timed.withWatermark(event_time, watermark).writeStream.foreachBatch(append_new(table, key, rules, violations))
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def ingest_batch(rows: DataFrame, key: str = "trial_id", rules: Sequence[Rule] = ()) -> DataFrame:
    """The batch form: sound rows, one per id; equal ids must be equal rows."""
    good = split(rows, rules, [key])[0] if rules else rows
    return good.dropDuplicates([key])


def window_peaks(
    samples: DataFrame, by: str = "trial_id", event_time: str = "ts",
    watermark: str | None = None, width: str = "1 hour",
) -> DataFrame:
    """Peaks per trial and event-time window; works on a stream and on a table.

    Only with a ``watermark`` does a stream free its state, and drop what is later.
    """
    timed = samples.withColumn(event_time, F.col(event_time).cast("timestamp"))
    if samples.isStreaming and watermark is not None:
        timed = timed.withWatermark(event_time, watermark)
    grouped = timed.groupBy(by, F.window(event_time, width).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"),
        F.max("host_rss_mib").alias("peak_host_rss_mib"),
        F.max("gpu_memory_mib").alias("peak_gpu_memory_mib"),
    )
    return grouped.select(
        by, F.col("w.start").alias("window_start"), "samples", "peak_host_rss_mib", "peak_gpu_memory_mib"
    )


def trial_sessions(
    samples: DataFrame, by: str = "trial_id", event_time: str = "ts",
    watermark: str = "10 minutes", gap: str = "30 minutes",
) -> DataFrame:
    """Activity sessions of each trial; a closed session means that the trial ended."""
    timed = samples.withColumn(event_time, F.col(event_time).cast("timestamp"))
    if samples.isStreaming:
        timed = timed.withWatermark(event_time, watermark)
    grouped = timed.groupBy(by, F.session_window(event_time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("host_rss_mib").alias("peak_host_rss_mib"))
    return grouped.select(
        by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
        "samples", "peak_host_rss_mib",
    )


def _merge_windows(table: str, width: str, by: str = "trial_id") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: the new state of every window that the batch has samples of."""

    def write(batch: DataFrame, number: int) -> None:
        fresh = window_peaks(batch, by, width=width)
        known = _stored(batch.sparkSession, table, fresh.withColumn(BATCH, F.lit(0).cast("bigint")).schema)
        if known is not None:
            old = latest_peaks(known.where(F.col(BATCH) != number), by).alias("old")
            same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in (by, "window_start")]
            fresh = fresh.alias("new").join(old, same, "left").select(
                f"new.{by}", "new.window_start", (F.col("new.samples") + F.coalesce("old.samples", F.lit(0))).alias("samples"),
                *[F.greatest(f"new.{c}", f"old.{c}").alias(c) for c in ("peak_host_rss_mib", "peak_gpu_memory_mib")])
        fresh.write.mode("overwrite").parquet(f"{table}/{BATCH}={number}")

    return write


def stream_peaks(
    samples: DataFrame, table: str, checkpoint: str, watermark: str = "10 minutes",
    width: str = "1 hour", available_now: bool = True,
) -> StreamingQuery:
    """Keep updated window peaks in ``table``; read them with :func:`latest_peaks`.

    Each batch is merged into the stored windows, so the stream holds no state: the
    watermark only shows in its progress, and no sample is too late.
    """
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    writer = timed.writeStream.foreachBatch(_merge_windows(table, width)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()


def latest_peaks(updates: DataFrame, by: str = "trial_id") -> DataFrame:
    """Last state of every window; counts and peaks only grow, so the maximum is last."""
    return updates.groupBy(by, "window_start").agg(
        F.max("samples").alias("samples"), F.max("peak_host_rss_mib").alias("peak_host_rss_mib"),
        F.max("peak_gpu_memory_mib").alias("peak_gpu_memory_mib"),
    )
