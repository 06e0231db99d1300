"""Text corpora as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialflow.functions.scaled import numbered


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, pos, line``: positions (from 0) in file order, also for split files.

    A split is read by one task in order, so the block start and the running id order
    the lines; counts per block give the offsets. No file is held in one task.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"),
    ).withColumn("_id", F.monotonically_increasing_id())
    out = numbered(raw, ["file"], ("_id",), [F.col("_block")], "_n", null_keys=False)
    return out.select("file", (F.col("_n") - 1).alias("pos"), "line")


def tokens(lines: DataFrame) -> DataFrame:
    """Whitespace tokens of each line: ``file, pos, part, bits``."""
    words = F.filter(F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "), lambda t: t != "")
    return lines.select("file", "pos", F.posexplode(words).alias("part", "bits"))


def bitstrings(lines: DataFrame, block: int = 65_536) -> DataFrame:
    """``file, pos, bits``: all tokens of a file numbered from 0 in file order."""
    out = numbered(
        tokens(lines).withColumnRenamed("pos", "_line"), ["file"], ("_line", "part"),
        [F.floor(F.col("_line") / block)], "_n",
    )
    return out.select("file", (F.col("_n") - 1).alias("pos"), "bits")


def read_bitstrings(spark: SparkSession, path: str) -> DataFrame:
    return bitstrings(read_lines(spark, path))
