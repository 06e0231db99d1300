"""Building blocks that hold when one group owns a large part of the rows.

A plain window or ``percentile`` puts a whole group into one task. The functions
here cut every group into *buckets*: a bucket is any non-strictly monotone
coarsening of the sort order (a day of a timestamp, a log step of a number, a
prefix of a string). Work inside a bucket is one shuffle on ``keys + bucket``;
only one small row per bucket travels on ``keys`` alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: groups above this many rows leave the single-task path
HOT_ROWS = 1_000_000


def value_bucket(value: Column, steps: int = 4096) -> Column:
    """Monotone bucket of a number, ``steps`` per factor e of ``1 + |value|``.

    Infinities have the outermost buckets and NaN, which sorts above them, one of its own.
    """
    last = (1 << 62)
    number = value.cast("double")
    finite = (F.signum(value) * F.floor(F.log1p(F.abs(value)) * F.lit(float(steps)))).cast("bigint")
    return (F.when(F.isnan(number), F.lit(last + 1)).when(number == float("inf"), F.lit(last))
            .when(number == float("-inf"), F.lit(-last)).otherwise(finite))


def prefix_bucket(value: Column, length: int) -> Column:
    """Monotone bucket of a string: its prefix."""
    return F.substring(value, 1, length)


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys owning more than ``hot_rows`` rows: at most ``rows / hot_rows`` of them."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > hot_rows)
        .select(*keys)
    )


def _key_match(left: DataFrame, right: DataFrame, keys: Sequence[str], null_keys: bool) -> Column:
    condition = None
    for key in keys:
        other = right[f"_k_{key}"]
        term = left[key].eqNullSafe(other) if null_keys else left[key] == other
        condition = term if condition is None else condition & term
    return condition


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    return df.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *others)


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    null_keys: bool = True,
) -> DataFrame:
    """Equi-join that keeps the left copy of the keys.

    Null-safe by default. ``null_keys=False`` states that the keys are never NULL;
    the join can then reuse the partitioning of a window or aggregate before it.
    """
    renamed = _renamed(right, keys)
    joined = left.join(renamed, _key_match(left, renamed, keys, null_keys), how)
    return joined.drop(*[f"_k_{k}" for k in keys])


def _percentiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Sequence[float],
    extra: Sequence[Column],
    names: Sequence[str],
) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    grouped = df.groupBy(*keys).agg(
        *extra, *[F.percentile(F.col(v), wanted).alias(f"_p_{v}") for v in values]
    )
    return grouped.select(
        *keys, *names,
        *[F.col(f"_p_{v}")[i].alias(f"{v}_p{i}") for v in values for i in range(len(probs))],
    )


def select_by_rank(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Sequence[float],
    steps: int = 4096,
    null_keys: bool = True,
) -> DataFrame:
    """Exact linear percentiles without a single-task group.

    Pass 1 counts rows per ``(keys, column, bucket)`` (combined map-side) and finds the
    buckets that hold the wanted ranks; pass 2 keeps only rows of those buckets,
    collapses equal values and picks the order statistics. All columns share the passes.
    """
    keys, values = list(keys), list(values)
    entries = F.array(*[
        F.struct(F.lit(i).alias("m"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)
    ])
    rows = (
        df.select(*keys, F.explode(entries).alias("_e")).where(F.col("_e.v").isNotNull())
        .select(*keys, F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v"),
                value_bucket(F.col("_e.v"), steps).alias("_b"))
    )
    by = [*keys, "_m"]
    histogram = rows.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*by)
    placed = histogram.select(
        *by, "_b", "_n",
        (F.sum("_n").over(by_key.orderBy("_b")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_key).alias("_total"),
    )
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), ((F.col("_total") - 1) * F.lit(float(p))).alias("pos"))
        for i, p in enumerate(probs)
    ])
    targets = (
        placed.withColumn("_w", F.explode(wanted))
        .withColumn("_r", F.explode(F.array_distinct(F.array(
            F.floor("_w.pos").cast("bigint"), F.ceil("_w.pos").cast("bigint")))))
        .where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_n")))
        .select(*by, "_b", F.col("_w.i").alias("_i"), F.col("_w.pos").alias("_pos"), "_r",
                (F.col("_r") - F.col("_before")).alias("_inside"))
    )
    cell = [*by, "_b"]
    kept = keyed_join(rows, targets.select(*cell).distinct(), cell, "left_semi", null_keys)
    distinct = kept.groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*cell).orderBy("_v"))
    ladder = distinct.select(*cell, "_v", (upto - F.col("_c")).alias("_from"), upto.alias("_to"))
    picked = keyed_join(targets, ladder, cell, "inner", null_keys).where(
        (F.col("_inside") >= F.col("_from")) & (F.col("_inside") < F.col("_to"))
    )
    per_prob = picked.groupBy(*by, "_i").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.max("_pos").alias("_pos"),
    ).withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        # the form of ``percentile``, so both paths give the same bits
        (F.ceil("_pos") - F.col("_pos")) * F.col("_lo") + (F.col("_pos") - F.floor("_pos")) * F.col("_hi")))
    return per_prob.groupBy(*keys).agg(*[
        F.max(F.when((F.col("_m") == m) & (F.col("_i") == i), F.col("_q"))).alias(f"{v}_p{i}")
        for m, v in enumerate(values) for i in range(len(probs))
    ])


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    probs: Sequence[float],
    hot_rows: int | None = HOT_ROWS,
    null_keys: bool = True,
    extra: Sequence[Column] = (),
    names: Sequence[str] = (),
) -> DataFrame:
    """Exact linear percentiles per group: columns ``<value>_p<i>``.

    ``extra`` are further aggregates (with their output ``names``) of the same groups.
    Groups up to ``hot_rows`` use ``percentile``; larger ones use
    :func:`select_by_rank`. The list of large groups is bounded by
    ``rows / hot_rows`` and broadcast; when it is empty, adaptive execution drops
    that branch. ``hot_rows=None`` states that a contract bounds every group.
    """
    keys, values = list(keys), list(values)
    if hot_rows is None:
        return _percentiles(df, keys, values, probs, extra, names)
    hot = F.broadcast(hot_groups(df, keys, hot_rows))
    small = _percentiles(
        keyed_join(df, hot, keys, "left_anti", null_keys), keys, values, probs, extra, names
    )
    large_rows = keyed_join(df, hot, keys, "left_semi", null_keys)
    large = large_rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *extra).drop("_rows")
    ranked = select_by_rank(large_rows, keys, values, probs, null_keys=null_keys)
    return small.unionByName(keyed_join(large, ranked, keys, "left", null_keys))


def summary(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    extra: Sequence[Column] = (),
    names: Sequence[str] = (),
    hot_rows: int | None = HOT_ROWS,
    null_keys: bool = True,
) -> DataFrame:
    """Count, minimum, q1, median, q3, IQR, maximum per group and value column."""
    keys, values = list(keys), list(values)
    basics = [F.count(F.lit(1)).alias("n")]
    for v in values:
        basics += [F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max")]
    labels = ["n", *[f"{v}_{e}" for v in values for e in ("min", "max")], *names]
    out = grouped_quantiles(
        df, keys, values, (0.25, 0.5, 0.75), hot_rows, null_keys, [*basics, *extra], labels
    )
    columns: list = [*keys, "n"]
    for v in values:
        q1, q2, q3 = (F.col(f"{v}_p{i}") for i in range(3))
        columns += [
            F.col(f"{v}_min"), q1.alias(f"{v}_q1"), q2.alias(f"{v}_median"),
            q3.alias(f"{v}_q3"), (q3 - q1).alias(f"{v}_iqr"), F.col(f"{v}_max"),
        ]
    return out.select(*columns, *names)


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
}
_FOLD = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    fn: str | dict[str, str],
    values: dict[str, Column],
    inclusive: bool = True,
    null_keys: bool = True,
) -> DataFrame:
    """Running sum/max/min along ``order`` per ``keys``, bucket by bucket.

    ``values`` maps output names to inputs; ``fn`` is one function for all of them or one
    by output name. Exclusive sums start at 0, exclusive maxima and minima at NULL.
    """
    keys = list(keys)
    fns = fn if isinstance(fn, dict) else dict.fromkeys(values, fn)
    buckets = [f"_b{i}" for i in range(len(bucket))]
    inputs = {name: f"_x{i}" for i, name in enumerate(values)}
    fold = {inputs[name]: _FOLD[fns[name]] for name in values}
    staged = df.select(
        "*", *[e.alias(b) for b, e in zip(buckets, bucket)],
        *[v.alias(inputs[n]) for n, v in values.items()],
    )
    totals = staged.groupBy(*keys, *buckets).agg(*[fold[x](x).alias(x) for x in inputs.values()])
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, *buckets, *[fold[x](x).over(before).alias(f"_off{x}") for x in inputs.values()]
    )
    upper = Window.currentRow if inclusive else -1
    inside = (
        Window.partitionBy(*keys, *buckets).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, upper)
    )
    local = staged.select("*", *[fold[x](x).over(inside).alias(f"_in{x}") for x in inputs.values()])
    joined = keyed_join(local, offsets, [*keys, *buckets], "inner", null_keys)
    return joined.select(
        *df.columns,
        *[_COMBINE[fns[name]](F.col(f"_in{x}"), F.col(f"_off{x}")).alias(name) for name, x in inputs.items()],
    )


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    name: str,
    null_keys: bool = True,
) -> DataFrame:
    """``row_number`` (from 1) per ``keys``, bucket by bucket."""
    one = {name: F.lit(1).cast("bigint")}
    return running(df, keys, order, bucket, "sum", one, null_keys=null_keys)


def numbered_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """:func:`numbered` for many groups: those up to ``hot_rows`` by one plain window, one shuffle.

    Large groups are found by counting 64-bit hashes of the keys; a small group that shares
    its hash with others may go the way of the large ones, which gives the same numbers.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    hot = F.broadcast(hot_groups(hashed, ["_hash"], hot_rows))
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    small = hashed.join(hot, "_hash", "left_anti").drop("_hash").withColumn(name, position)
    large = hashed.join(hot, "_hash", "left_semi").drop("_hash")
    return small.unionByName(numbered(large, keys, order, bucket, name))


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    columns: Sequence[str],
    null_keys: bool = True,
) -> DataFrame:
    """Add ``prev_<c>`` of the preceding row per ``keys``, across bucket borders."""
    keys = list(keys)
    buckets = [f"_b{i}" for i in range(len(bucket))]
    staged = df
    for label, expression in zip(buckets, bucket):
        staged = staged.withColumn(label, expression)
    staged = staged.withColumn("_s", F.struct(*columns))
    edges = staged.groupBy(*keys, *buckets).agg(
        F.max_by("_s", F.struct(*order)).alias("_last")
    )
    across = edges.select(
        *keys, *buckets,
        F.lag("_last").over(Window.partitionBy(*keys).orderBy(*buckets)).alias("_edge"),
    )
    local = staged.withColumn(
        "_lag", F.lag("_s").over(Window.partitionBy(*keys, *buckets).orderBy(*order))
    )
    joined = keyed_join(local, across, [*keys, *buckets], "inner", null_keys).withColumn(
        "_p", F.coalesce("_lag", "_edge")
    )
    return joined.select(*df.columns, *[F.col(f"_p.{c}").alias(f"prev_{c}") for c in columns])
