"""Resource samples and latency samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.functions.scaled import HOT_ROWS, grouped_quantiles
from trialflow.schemas import SAMPLES


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Per-trial sample files (CSV with header); the file stem is the trial id."""
    rows = (
        spark.read.schema(SAMPLES).option("header", True).option("enforceSchema", False).csv(path)
    )
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("trial_id"), *rows.columns)


def write_samples(samples: DataFrame, folder: str) -> None:
    """One CSV file with a header per trial, below ``trial=…`` folders."""
    rows = samples.withColumnRenamed("trial_id", "trial").repartition("trial")
    rows.write.option("header", True).partitionBy("trial").csv(folder)


def read_sample_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Sample files below ``trial=…`` folders; a header that differs from the fields is an error."""
    rows = spark.read.schema(SAMPLES).option("header", True).option("enforceSchema", False)
    rows = rows.option("basePath", folder).csv(f"{folder}/trial=*")
    fields = [f.name for f in SAMPLES.fields]
    name = F.regexp_extract("_metadata.file_path", "/trial=([^/]*)/", 1)
    # escaped once as a folder's name and once as a path
    for _ in range(2):
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return rows.select(name.alias("trial_id"), *fields)


def parse_samples(lines: DataFrame) -> DataFrame:
    """``trial_id, line`` with raw CSV text to typed sample columns."""
    return lines.select("trial_id", F.from_csv("line", SAMPLES.simpleString()[7:-1].replace(":", " ")).alias("s")).select(
        "trial_id", "s.*"
    )


def trial_peaks(samples: DataFrame) -> DataFrame:
    """Peaks, completeness flags and sample counts; combined map-side."""
    return samples.groupBy("trial_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.max("host_rss_mib").alias("peak_host_rss_mib"),
        F.max("gpu_memory_mib").alias("peak_gpu_memory_mib"),
        F.max("elapsed_s").alias("last_elapsed_s"),
        F.bool_and(F.col("host_rss_mib").isNotNull()).alias("host_complete"),
        F.bool_or(F.col("gpu_memory_mib").isNotNull()).alias("gpu_process_observed"),
        F.bool_and(F.col("gpu_utilization_pct").isNotNull()).alias("gpu_complete"),
    )


def latency_summary(
    samples: DataFrame, by: Sequence[str], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Minimum, p50, p90, p95 and maximum in microseconds of nanosecond samples."""
    us = samples.select(*by, (F.col("ns") / F.lit(1e3)).alias("us"))
    extra = {"n": F.count(F.lit(1)), "min_us": F.min("us"), "max_us": F.max("us")}
    out = grouped_quantiles(
        us, by, ["us"], (0.5, 0.9, 0.95), hot_rows,
        extra=[c.alias(name) for name, c in extra.items()], names=list(extra),
    )
    return out.select(
        *by, "n", "min_us", F.col("us_p0").alias("median_us"), F.col("us_p1").alias("p90_us"),
        F.col("us_p2").alias("p95_us"), "max_us",
    )
