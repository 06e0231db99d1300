"""Small derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.functions.stats import close, finite
from trialflow.operators.rules import needs, split

DENSITIES = (
    "alpha_single_edge_density", "alpha_double_edge_density",
    "beta_single_edge_density", "beta_double_edge_density",
)


def in_unit_interval(value: Column) -> Column:
    return finite(value) & value.between(0.0, 1.0)


def log_matches(logged: Column, raw: Column) -> Column:
    """The stored ``log1p`` agrees with its raw value to 1e-12."""
    return close(logged, F.log1p(raw.cast("double")), 1e-12, 1e-12)


def selector_features(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pre-execution features of valid rows, and the violations of the others."""
    c = F.col
    rules = [
        needs("n_configurations_not_positive", c("n_configurations") > 0),
        needs("work_negative", c("estimated_work") >= 0),
        needs("log_n_configurations_mismatch",
              log_matches(c("log1p_n_configurations"), c("n_configurations"))),
        needs("log_work_mismatch", log_matches(c("log1p_work"), c("estimated_work"))),
        *[needs(f"{name}_out_of_range", in_unit_interval(c(name))) for name in DENSITIES],
    ]
    good, bad = split(rows, rules, ["trial_id"])
    return good.select(
        "*",
        F.log1p(c("determinant_cache_bytes").cast("double")).alias("log1p_determinant_cache_bytes"),
        F.log1p(c("gpu_guard_bytes").cast("double")).alias("log1p_gpu_guard_bytes"),
    ), bad


def repair_density(text: Column) -> tuple[Column, Column]:
    """``(array<double>, repaired)``: one missing closing bracket is added, never more."""
    body = F.rtrim(F.ltrim(text))
    repaired = ~body.endswith("]")
    closed = F.when(repaired, F.concat(body, F.lit("]"))).otherwise(body)
    inner = F.regexp_extract(closed, r"^\[([^\[\]]*)\]$", 1)
    parts = F.transform(F.split(inner, ","), lambda x: F.trim(x).try_cast("double"))
    values = F.when(
        (F.trim(inner) != "") & ~F.exists(parts, lambda x: x.isNull() | F.isnan(x)), parts
    )
    return values, repaired


def initialization_time(helper: Column, initial: Column) -> Column:
    """Sum of both parts; NULL when either is missing."""
    return helper + initial


def family_or_prefix(family: Column, instance: Column, prefixes: dict[str, str]) -> Column:
    """Stated family, else the family of the first matching instance prefix, else NULL."""
    guess = None
    for prefix, name in prefixes.items():
        test = instance.startswith(prefix)
        guess = F.when(test, name) if guess is None else guess.when(test, name)
    return F.coalesce(F.nullif(F.trim(family), F.lit("")), guess)


def basis_status(basis: Column) -> Column:
    return F.when(
        F.coalesce(F.trim(basis), F.lit("")) != "", "reported"
    ).otherwise("upstream_not_reported")


def label(df: DataFrame, dimension: DataFrame, on: str) -> DataFrame:
    """Attach display labels; the size of the dimension decides how Spark joins."""
    return df.join(dimension, on, "left")


def cost(span_s: Column, rate_per_hour: Column | float) -> Column:
    rate = rate_per_hour if isinstance(rate_per_hour, Column) else F.lit(rate_per_hour)
    return span_s * rate / 3600.0


def overlay(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Each base column replaced by its override column where that is set."""
    replaced = {base: F.coalesce(F.col(over), F.col(base)) for base, over in overrides.items()}
    return df.select(*[
        replaced[c].alias(c) if c in replaced else F.col(c)
        for c in df.columns if c not in set(overrides.values())
    ])


def rank_split(ranks: Column, *communicators: Column) -> Column:
    """Ranks left per communicator product; NULL when the product does not divide them."""
    product = communicators[0].cast("bigint")
    for size in communicators[1:]:
        product = product * size
    return F.when(ranks % product == 0, F.call_function("div", ranks, product))
