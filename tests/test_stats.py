"""Quantiles, running windows and neighbours against plain Spark on skewed data."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialflow.functions import scaled, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot", round(rng.uniform(-2, 40), 2), i) for i in range(3000)]
    rows += [("same", 1.5, 10_000 + i) for i in range(500)]
    rows += [(None, rng.uniform(0, 1), 20_000 + i) for i in range(40)]
    rows += [(f"g{i % 25}", rng.expovariate(1.0), 30_000 + i) for i in range(200)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, v double, id long").repartition(7)


def as_map(df):
    return {r["k"]: tuple(round(x, 10) for x in r[1:]) for r in df.collect()}


def test_golden_summary(spark):
    df = spark.createDataFrame([("a", 9.0), ("a", 1.0), ("a", 2.0), ("b", 4.0)], "k string, v double")
    for hot in (None, 2, 1_000_000):
        rows = {r["k"]: r for r in scaled.summary(df, ["k"], ["v"], hot_rows=hot).collect()}
        assert (rows["a"]["v_q1"], rows["a"]["v_median"], rows["a"]["v_q3"], rows["a"]["v_iqr"]) == (1.5, 2, 5.5, 4)
        assert rows["b"]["v_min"] == rows["b"]["v_q1"] == rows["b"]["v_max"] == 4.0
        assert (rows["a"]["n"], rows["b"]["n"]) == (3, 1)


def test_hot_groups_give_the_same_quantiles(skewed):
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    plain = as_map(scaled.grouped_quantiles(skewed, ["k"], ["v"], probs, hot_rows=None))
    mixed = as_map(scaled.grouped_quantiles(skewed, ["k"], ["v"], probs, hot_rows=100))
    ranked = as_map(scaled.select_by_rank(skewed, ["k"], ["v"], probs))
    assert plain == mixed == ranked
    assert len(plain) == 28 and None in plain


def test_quantiles_do_not_depend_on_partitioning(skewed):
    base = as_map(scaled.grouped_quantiles(skewed, ["k"], ["v"], (0.5,), hot_rows=100))
    for n in (1, 50):
        again = scaled.grouped_quantiles(skewed.repartition(n), ["k"], ["v"], (0.5,), hot_rows=100)
        assert as_map(again) == base


def test_all_null_hot_group_is_kept(spark):
    df = spark.range(50).select(F.lit("n").alias("k"), F.lit(None).cast("double").alias("v"))
    rows = scaled.summary(df, ["k"], ["v"], hot_rows=10).collect()
    assert len(rows) == 1 and rows[0]["n"] == 50 and rows[0]["v_median"] is None


@pytest.mark.parametrize("fn", ["sum", "max", "min"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_equals_one_window(skewed, fn, inclusive):
    upper = Window.currentRow if inclusive else -1
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, upper)
    expected = skewed.withColumn("x", getattr(F, fn)("v").over(w))
    if fn == "sum":
        expected = expected.withColumn("x", F.coalesce("x", F.lit(0.0)))
    out = scaled.running(skewed, ["k"], ("id",), [F.floor(F.col("id") / 64)], fn, {"x": F.col("v")}, inclusive)

    def rows(df):
        return sorted((r["id"], None if r["x"] is None else round(r["x"], 6)) for r in df.collect())

    assert rows(out) == rows(expected)


def test_previous_and_numbered_equal_one_window(skewed):
    w = Window.partitionBy("k").orderBy("id")
    expected = skewed.select("id", F.lag("v").over(w).alias("p"), F.row_number().over(w).alias("n"))
    bucket = [F.floor(F.col("id") / 64)]
    prev = scaled.previous(skewed, ["k"], ("id",), bucket, ("v",)).select("id", "prev_v")
    number = scaled.numbered(skewed, ["k"], ("id",), bucket, "n").select("id", "n")
    assert sorted((r["id"], r["p"] or 0) for r in expected.collect()) == sorted(
        (r["id"], r["prev_v"] or 0) for r in prev.collect())
    assert sorted((r["id"], r["n"]) for r in expected.collect()) == sorted(
        (r["id"], r["n"]) for r in number.collect())


def test_bucket_is_monotone(spark):
    rng = random.Random(3)
    values = sorted(rng.choice([-1, 1]) * rng.expovariate(0.01) for _ in range(500))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    buckets = [r["b"] for r in df.select("i", scaled.value_bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert buckets == sorted(buckets)


def test_relative_errors_and_ratio(spark):
    row = spark.range(1).select(
        stats.relative_error(F.lit(1.0), F.lit(0.0), "symmetric").alias("s"),
        stats.relative_error(F.lit(0.0), F.lit(0.0), "symmetric").alias("z"),
        stats.relative_error(F.lit(2.0), F.lit(4.0), "reference").alias("r"),
        stats.relative_error(F.lit(2.0), F.lit(4.0), "floored").alias("f"),
        stats.ratio(F.lit(1.0), F.lit(0.0)).alias("n"),
        stats.normalized_regret(F.lit(3.0), F.lit(2.0)).alias("g"),
    ).first()
    assert (row["s"], row["z"], row["r"], row["f"], row["n"], row["g"]) == (1.0, 0.0, 0.5, 0.5, None, 0.5)
    with pytest.raises(ValueError):
        stats.relative_error(F.lit(1.0), F.lit(1.0), "other")


def test_strict_booleans_and_finiteness(spark):
    df = spark.createDataFrame(
        [(1, True, 1.0), (2, False, math.nan), (3, None, math.inf), (4, None, None)], "i int, b boolean, v double")
    rows = df.select("i", stats.is_true(F.col("b")).alias("t"), stats.is_false(F.col("b")).alias("f"),
                     stats.finite(F.col("v")).alias("x")).orderBy("i").collect()
    assert [(r["t"], r["f"], r["x"]) for r in rows] == [
        (True, False, True), (False, True, False), (False, False, False), (False, False, False)]
