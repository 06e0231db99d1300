"""Result tables as files: typed CSV, JSON cells, write-only-if-changed."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialflow.operators.rules import ContractError
from trialflow.schemas import CSV_FIELDS, FAMILY_FIELDS


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; a missing required column fails before any job runs."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ContractError(f"{path} lacks required columns: {missing}")
    texts = T.StructType([T.StructField(name, T.StringType()) for name in header])
    raw = spark.read.schema(texts).option("header", True).option("enforceSchema", False).option(
        "mode", "FAILFAST").option("escape", '"').csv(path)
    return raw.select(*[
        F.col(f.name).try_cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.AtomicType) else F.from_json(f.name, f.dataType).alias(f.name)
        for f in schema.fields
    ])


def timing_csv_rows(rows: DataFrame, family: bool = True) -> DataFrame:
    """The flat timing columns as text: ``true/false``, reasons joined by ``;``."""
    names = list(CSV_FIELDS)
    if family:
        at = names.index("problem_instance")
        names[at:at] = FAMILY_FIELDS
    special = {
        "included": F.when(F.col("included"), "true").otherwise("false"),
        "exclusion_reasons": F.concat_ws(";", "exclusion_reasons"),
    }
    have = set(rows.columns)
    return rows.select(*[
        F.coalesce(
            special.get(n, F.col(n).cast("string") if n in have else F.lit("")), F.lit("")
        ).alias(n)
        for n in names
    ])


def json_cells(df: DataFrame) -> DataFrame:
    """List, struct and map columns as JSON text, the others unchanged."""
    complex_types = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, complex_types) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header. A compressed file is one task when read, so such files stay small."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("compression", compression)
    if compression != "none":
        writer = writer.option("maxRecordsPerFile", 1_000_000)
    writer.csv(path)


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Multiset equality by one combined count over both sides."""
    if sorted(left.columns) != sorted(right.columns):
        return False
    columns = left.columns
    both = json_cells(left).withColumn("_s", F.lit(1)).unionByName(
        json_cells(right.select(*columns)).withColumn("_s", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_s").alias("_d")).where("_d <> 0").limit(1).count() == 0


def write_table(df: DataFrame, path: str, only_if_changed: bool = True) -> bool:
    """Write a new snapshot under ``path`` unless the current one has the same rows.

    Snapshots are immutable folders; ``path/current`` names the latest. Returns whether
    a snapshot was written.
    """
    spark = df.sparkSession
    current = current_snapshot(spark, path)
    if only_if_changed and current is not None:
        stored = spark.read.parquet(current)
        if same_rows(df, stored):
            return False
    snapshot = f"{path.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(snapshot)
    spark.createDataFrame([(snapshot,)], "snapshot string").write.mode("overwrite").json(
        f"{path.rstrip('/')}/current")
    return True


def current_snapshot(spark: SparkSession, path: str) -> str | None:
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema("snapshot string").json(f"{path.rstrip('/')}/current").take(1)
    except AnalysisException:
        return None
    return rows[0]["snapshot"] if rows else None


def typed_text(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Text columns cast to the stated types; what does not parse becomes NULL."""
    return df.select(*[
        F.col(c).try_cast(columns[c]).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def range_rules(fractions: Sequence[str] = (), positives: Sequence[str] = (),
                nonnegatives: Sequence[str] = (), digests: Sequence[str] = ()) -> list:
    """Rules for reloaded text: fractions in [0, 1], signs, digest lists."""
    from trialflow.functions.identity import is_digest
    from trialflow.functions.stats import finite
    from trialflow.operators.rules import needs

    c = F.col
    return [
        *[needs(f"{n}_not_a_fraction", finite(c(n)) & c(n).between(0, 1)) for n in fractions],
        *[needs(f"{n}_not_positive", finite(c(n)) & (c(n) > 0)) for n in positives],
        *[needs(f"{n}_negative", finite(c(n)) & (c(n) >= 0)) for n in nonnegatives],
        *[
            needs(
                f"{n}_not_distinct_digests",
                F.forall(c(n), is_digest) & (F.size(F.array_distinct(c(n))) == F.size(c(n))),
            )
            for n in digests
        ],
    ]
