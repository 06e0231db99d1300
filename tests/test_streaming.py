"""Streams run to completion on files; a second start adds only what is new."""

from pyspark.sql import functions as F

from trialflow.operators.rules import needs
from trialflow.streaming import ingest

SCHEMA = "trial_id string, started timestamp, v double"


def put(spark, path, rows):
    df = spark.createDataFrame(rows, "trial_id string, t long, v double")
    df.select("trial_id", F.timestamp_seconds(F.col("t") + 1_000_000).alias("started"), "v").coalesce(1).write.mode("append").parquet(path)


def run(spark, base):
    source = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
    query = ingest.ingest_stream(
        source, f"{base}/rows", f"{base}/checkpoint", watermark="1 hour", rules=[needs("negative", F.col("v") >= 0)],
        violations=f"{base}/bad")
    query.awaitTermination()
    return sorted((r["trial_id"], r["v"]) for r in spark.read.parquet(f"{base}/rows").collect())


def test_ingest_is_exactly_once_by_id(spark, tmp_path):
    base = str(tmp_path)
    put(spark, f"{base}/in", [("a", 0, 1.0), ("a", 0, 1.0), ("b", 60, -1.0)])
    assert run(spark, base) == [("a", 1.0)]
    put(spark, f"{base}/in", [("c", 200_000, 3.0)])
    assert run(spark, base) == [("a", 1.0), ("c", 3.0)]
    # far behind the watermark of its first copy, so only the stored table knows it
    put(spark, f"{base}/in", [("a", 400_000, 1.0), ("d", 400_000, 4.0)])
    assert run(spark, base) == [("a", 1.0), ("c", 3.0), ("d", 4.0)]
    assert [r["trial_id"] for r in spark.read.parquet(f"{base}/bad").collect()] == ["b"]
    assert run(spark, base) == [("a", 1.0), ("c", 3.0), ("d", 4.0)]


def test_a_retried_batch_leaves_the_same_rows(spark, tmp_path):
    write = ingest.append_new(f"{tmp_path}/rows", "k")
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 2


def test_stream_peaks_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([("t", 10, 1.0, 2.0), ("t", 20, 3.0, None), ("t", 7200, 2.0, 1.0)], "trial_id string, s long, host_rss_mib double, gpu_memory_mib double")
    rows = rows.select("trial_id", F.timestamp_seconds("s").alias("ts"), "host_rss_mib", "gpu_memory_mib")
    rows.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.stream_peaks(source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    live = ingest.latest_peaks(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, ingest.window_peaks(rows).collect()))
    sessions = ingest.trial_sessions(rows).collect()
    assert sorted(r["samples"] for r in sessions) == [1, 2]


def test_a_very_late_record_is_kept(spark, tmp_path):
    base = str(tmp_path)
    for rows in ([("a", 0, 1.0)], [("b", 9_000_000, 2.0)], [("c", 9_100_000, 3.0), ("z", 5, -1.0)], [("late", 10, 4.0), ("a", 0, 1.0), ("z", 5, -1.0)]):
        put(spark, f"{base}/in", rows)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = ingest.ingest_stream(
        source, f"{base}/rows", f"{base}/checkpoint", watermark="1 hour", rules=[needs("negative", F.col("v") >= 0)], violations=f"{base}/bad")
    query.awaitTermination()
    stored = spark.read.parquet(f"{base}/rows")
    assert sorted(r["trial_id"] for r in stored.collect()) == ["a", "b", "c", "late"]
    assert stored.select(ingest.BATCH).distinct().count() == 4
    assert [r["trial_id"] for r in spark.read.parquet(f"{base}/bad").collect()] == ["z"]


def test_very_late_samples_reach_their_windows(spark, tmp_path):
    schema = "trial_id string, ts timestamp, host_rss_mib double, gpu_memory_mib double"
    for rows in ([("t", 10, 1.0, 2.0)], [("t", 9_000_000, 3.0, None)], [("t", 9_100_000, 2.0, 1.0)], [("t", 20, 9.0, None), ("u", 30, 5.0, 6.0), (None, 40, 1.0, 1.0)], [(None, 50, 2.0, None)]):
        df = spark.createDataFrame(rows, "trial_id string, s long, host_rss_mib double, gpu_memory_mib double")
        df.select("trial_id", F.timestamp_seconds("s").alias("ts"), "host_rss_mib", "gpu_memory_mib").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ingest.stream_peaks(source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    live = ingest.latest_peaks(spark.read.parquet(f"{tmp_path}/out"))
    want = ingest.window_peaks(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(str, live.collect())) == sorted(map(str, want.collect()))
    assert live.where("trial_id = 't'").agg(F.sum("samples")).first()[0] == 4
