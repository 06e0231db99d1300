"""Full-factorial parameter screens: paired effects, rankings, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.functions.scaled import HOT_ROWS, grouped_quantiles
from trialflow.operators.timing import rank_candidates
from trialflow.session import materialized

FACTORS = {"backend": ("cpu", "gpu"), "bit_length": (20, 48), "shuffle": (False, True)}


def _winner(left: Column, right: Column) -> Column:
    return F.when(left < right, "left").when(right < left, "right").otherwise("tie")


def paired_effects(
    measurements: DataFrame,
    factors: dict[str, tuple] = FACTORS,
    metrics: Sequence[str] = ("wall_time_s", "solver_time_s"),
    workload: Sequence[str] = ("family_id", "problem_instance", "n_configurations"),
) -> DataFrame:
    """Pairs that differ in exactly one two-level factor, the others fixed.

    Each measurement feeds one cell per factor; the pair is a conditional aggregation
    over the cell, so all factors share one shuffle and nothing is self-joined.
    """
    names = list(factors)
    cells = []
    for name in names:
        low, high = factors[name]
        fixed = F.concat_ws(",", *[
            F.concat(F.lit(f"{other}="), F.col(other).cast("string"))
            for other in sorted(names) if other != name
        ])
        side = F.when(F.col(name) == F.lit(low), "l").when(F.col(name) == F.lit(high), "r")
        cells.append(F.struct(
            F.lit(name).alias("factor"), F.lit(str(low).lower()).alias("left_level"),
            F.lit(str(high).lower()).alias("right_level"), fixed.alias("fixed_factors"),
            side.alias("side"),
        ))
    long = measurements.select(*workload, "candidate_name", *metrics, F.explode(F.array(*cells)).alias("c"))
    long = long.where("c.side IS NOT NULL").select(*workload, "candidate_name", *metrics, "c.*")
    keys = [*workload, "factor", "left_level", "right_level", "fixed_factors"]
    value = {s: F.struct(*metrics, "candidate_name") for s in "lr"}
    grouped = long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("side") == s, value[s])).alias(s) for s in "lr"
    ]).where("l IS NOT NULL AND r IS NOT NULL")
    out = [*keys, F.col("l.candidate_name").alias("left_candidate"),
           F.col("r.candidate_name").alias("right_candidate")]
    for m in metrics:
        stem = m.removesuffix("_time_s")
        l, r = F.col(f"l.{m}"), F.col(f"r.{m}")
        out += [F.when(r != 0, l / r).alias(f"{stem}_ratio"), _winner(l, r).alias(f"{stem}_winner")]
    return grouped.select(*out)


def _scoped(rows: DataFrame, scopes: dict[str, Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """Rows repeated once per scope, with the columns outside the scope set to NULL."""
    types = dict(rows.dtypes)
    entries = F.array(*[
        F.struct(F.lit(scope).alias("scope"), *[
            (F.col(c) if c in keep else F.lit(None).cast(types[c])).alias(c) for c in columns
        ])
        for scope, keep in scopes.items()
    ])
    others = [c for c in rows.columns if c not in columns]
    return rows.select(F.explode(entries).alias("_s"), *others).select("_s.*", *others)


def screen_summary(ranked: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Timing summaries and win counts by candidate, family x candidate, size x candidate."""
    rows = _scoped(
        ranked, {"all": (), "family": ("family_id",), "size": ("n_configurations",)},
        ("family_id", "n_configurations"),
    )
    keys = ["scope", "family_id", "n_configurations", "candidate_name"]
    extra = {
        "n": F.count(F.lit(1)), "wall_min": F.min("wall_time_s"), "wall_max": F.max("wall_time_s"),
        "wall_wins": F.count_if("wall_winner"), "solver_wins": F.count_if("solver_winner"),
    }
    return grouped_quantiles(
        rows, keys, ["wall_time_s", "solver_time_s"], (0.25, 0.5, 0.75), hot_rows,
        extra=[c.alias(name) for name, c in extra.items()], names=list(extra),
    ).select(
        *keys, "n", "wall_min", F.col("wall_time_s_p0").alias("wall_q1"),
        F.col("wall_time_s_p1").alias("wall_median"), F.col("wall_time_s_p2").alias("wall_q3"),
        "wall_max", F.col("solver_time_s_p1").alias("solver_median"), "wall_wins", "solver_wins",
    )


def factor_summary(effects: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Ratio quantiles and left/right/tie counts per factor, overall and by family."""
    rows = _scoped(effects, {"all": (), "family": ("family_id",)}, ("family_id",))
    keys = ["scope", "family_id", "factor", "left_level", "right_level"]
    extra = {"n": F.count(F.lit(1))}
    for m in ("wall", "solver"):
        for side in ("left", "right", "tie"):
            extra[f"{m}_{side}"] = F.count_if(F.col(f"{m}_winner") == side)
    out = grouped_quantiles(
        rows, keys, ["wall_ratio", "solver_ratio"], (0.25, 0.5, 0.75), hot_rows,
        extra=[c.alias(name) for name, c in extra.items()], names=list(extra),
    )
    return out.withColumnsRenamed({
        f"{m}_ratio_p{i}": f"{m}_ratio_{q}" for m in ("wall", "solver")
        for i, q in enumerate(("q1", "median", "q3"))
    })


def long_form(parts: dict[str, DataFrame]) -> DataFrame:
    """Sparse union of several result tables with a ``row_type`` discriminator."""
    out = None
    for kind, rows in parts.items():
        tagged = rows.withColumn("row_type", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def screen(measurements: DataFrame, factors: dict[str, tuple] = FACTORS) -> dict[str, DataFrame]:
    """Every table of a screen from one measured row per (workload, candidate).

    The measurements are written once; ranks and effects are read by several tables.
    """
    kept = materialized(measurements)
    ranked = rank_candidates(kept, ("wall_time_s", "solver_time_s"), ("family_id", "problem_instance"))
    effects = paired_effects(kept, factors)
    return {
        "measurement": ranked,
        "paired_effect": effects,
        "timing_summary": screen_summary(ranked),
        "factor_summary": factor_summary(effects),
    }
