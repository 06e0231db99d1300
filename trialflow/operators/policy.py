"""Selection policies: balanced data, folds, threshold fits, predictions, metrics.

Folds are *complement folds*: a fold lists its held-out members, everything else is
training data. Nothing here multiplies the instances by the number of folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.functions.memory import feasible
from trialflow.functions.scaled import HOT_ROWS, grouped_quantiles, previous, running, value_bucket
from trialflow.functions.stats import close, geomean, normalized_regret, runtime_ratio
from trialflow.operators.rules import needs, reasons, rule
from trialflow.operators.screen import _scoped
from trialflow.operators.timing import REPETITIONS
from trialflow.session import materialized

INSTANCE = ("family_id", "problem_instance")

# fixed values: feature lists of the runtime model
SIZE_FEATURES = ("log1p_n_configurations", "backend_gpu")
FULL_FEATURES = SIZE_FEATURES + (
    "log1p_method0_work_proxy", "log1p_determinant_cache_bytes", "log1p_gpu_guard_bytes",
    "alpha_single_edge_density", "alpha_double_edge_density", "beta_single_edge_density",
    "beta_double_edge_density", "cpu_threads",
)
#: known before a run starts; nothing else may feed a model
ALLOWED_FEATURES = frozenset(FULL_FEATURES)

CPU, GPU = "cpu-16", "gpu-1"
FIXED_CPU, FIXED_GPU, THRESHOLD = "fixed_cpu", "fixed_gpu", "static_size_threshold"
SIZE_TREE, FULL_TREE, BEST = "size_only_tree", "full_tree", "measured_feasible_best"
POLICIES = (FIXED_CPU, FIXED_GPU, THRESHOLD, SIZE_TREE, FULL_TREE, BEST)
LEARNED = (THRESHOLD, SIZE_TREE, FULL_TREE)


def argmin(value: Column, name: Column) -> Column:
    """Name with the least value; ties go to the lexicographically least name."""
    return F.min_by(name, F.struct(value, name))


# -- balanced data -------------------------------------------------------------


def balanced_dataset(
    rows: DataFrame,
    candidates: dict[str, str],
    constants: Sequence[str] = (),
    caps: Sequence[str] = ("host_cap_bytes", "gpu_cap_bytes"),
    repetitions: Sequence[int] = REPETITIONS,
    digest: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """One median row per (instance, candidate), plus contract violations.

    A candidate counts with exactly one record per repetition; an instance counts with
    every registered candidate, one input hash and one value of each ``constants``
    column. Caps are the minimum over the instance. All aggregates combine map-side,
    so no group is ever collected: the median comes from one cell per repetition.
    ``digest=False`` leaves the input hash out, for rows whose hash is made of the
    instance's own key and so cannot differ; without it and ids, no text is compared.
    """
    reps = list(repetitions)
    hashes = ["input_sha256"] if digest else []
    same = [*hashes, *constants]
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for r in reps:
        hit = F.col("repetition") == r
        aggregates += [
            F.count_if(hit).alias(f"_c{r}"),
            F.max(F.when(hit, F.col("wall_time_s"))).alias(f"_w{r}"),
            F.max(F.when(hit, F.col("trial_id"))).alias(f"_id{r}"),
        ]
    aggregates += [F.min(c).alias(c) for c in caps]
    for c in same:
        aggregates += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}")]
    groups = rows.groupBy(*INSTANCE, "candidate_name", "backend").agg(*aggregates)

    registered = F.create_map(*[F.lit(x) for pair in candidates.items() for x in pair])
    exact = F.col("_n") == len(reps)
    for r in reps:
        exact = exact & (F.col(f"_c{r}") == 1)
    steady = F.lit(True)
    for c in same:
        steady = steady & F.col(f"_lo_{c}").eqNullSafe(F.col(f"_hi_{c}"))
    known = F.coalesce(registered[F.col("candidate_name")] == F.col("backend"), F.lit(False))
    times = F.array(*[F.col(f"_w{r}") for r in reps])
    staged = groups.select(
        *INSTANCE, "candidate_name", "backend", *caps,
        *[F.col(f"_lo_{c}").alias(c) for c in same],
        F.sort_array(times)[len(reps) // 2].alias("median_wall_time_s"),
        F.array(*[F.col(f"_id{r}") for r in reps]).alias("source_record_ids"),
        reasons([
            needs("candidate_not_registered", known),
            needs("repetitions_incomplete_or_repeated", exact),
            needs("inconsistent_within_candidate", steady),
            needs("wall_time_not_positive", F.array_min(times) > 0),
        ]).alias("_bad"),
    )
    # one row per registered candidate from here on: the window partition is bounded
    by = Window.partitionBy(*INSTANCE)
    agreed = F.lit(True)
    for c in same:
        agreed = agreed & F.min(c).over(by).eqNullSafe(F.max(c).over(by))
    judged = staged.select(
        *[c for c in staged.columns if c not in caps],
        *[F.min(c).over(by).alias(c) for c in caps],
        F.sum(F.size("_bad")).over(by).alias("_broken"),
        F.count(F.lit(1)).over(by).alias("_candidates"),
        agreed.alias("_agreed"),
    )
    whole = (
        (F.col("_broken") == 0) & (F.col("_candidates") == len(candidates)) & F.col("_agreed")
    )
    good = judged.where(whole).select(
        *INSTANCE, *hashes, "candidate_name", "backend", *constants,
        "median_wall_time_s",
        F.log1p("median_wall_time_s").alias("target_log1p_median_wall_time_s"),
        *caps, "source_record_ids",
    )
    findings = F.concat(
        "_bad",
        reasons([
            rule("candidates_incomplete", F.col("_candidates") != len(candidates)),
            rule("inconsistent_within_instance", ~F.col("_agreed")),
        ]),
    )
    bad = judged.select(*INSTANCE, "candidate_name", F.explode(findings).alias("rule"))
    return good, bad


def pairs(balanced: DataFrame, carry: Sequence[str] = ("n_configurations",), sides: Sequence[str] = ()) -> DataFrame:
    """One row per instance: both medians, feasibility of both, oracle columns.

    ``carry`` are columns of the instance, ``sides`` columns wanted of both candidates.
    """
    c = F.col
    fits = feasible(
        c("backend"), c("host_guard_bytes"), c("gpu_host_guard_bytes"), c("gpu_guard_bytes"),
        c("host_cap_bytes"), c("gpu_cap_bytes"),
    )

    def side(name: str, column: Column) -> Column:
        return F.max(F.when(c("candidate_name") == name, column))

    wide = balanced.groupBy(*INSTANCE).agg(
        *[F.max(x).alias(x) for x in carry],
        side(CPU, c("median_wall_time_s")).alias("cpu_time"),
        side(GPU, c("median_wall_time_s")).alias("gpu_time"),
        side(CPU, fits).alias("cpu_feasible"), side(GPU, fits).alias("gpu_feasible"),
        *[side(name, c(x)).alias(f"{p}_{x}") for x in sides for p, name in (("cpu", CPU), ("gpu", GPU))],
    )
    best = F.least(
        F.when(c("cpu_feasible"), c("cpu_time")), F.when(c("gpu_feasible"), c("gpu_time"))
    )
    return wide.withColumn("best_time", best).withColumn(
        "best_names",
        F.array_compact(F.array(
            F.when(c("cpu_feasible") & close(c("cpu_time"), c("best_time"), 1e-15), F.lit(CPU)),
            F.when(c("gpu_feasible") & close(c("gpu_time"), c("best_time"), 1e-15), F.lit(GPU)),
        )),
    )


# -- folds ---------------------------------------------------------------------


def folds_largest(instances: DataFrame, size: str) -> tuple[DataFrame, DataFrame]:
    """Roles for the hold-out of the unique largest instance, and a tie violation."""
    top = instances.agg(F.max(size)).scalar()
    is_top = F.col(size) == top
    roles = instances.select(
        F.lit("largest").alias("fold_id"), *INSTANCE,
        F.when(is_top, "test").otherwise("train").alias("role"),
    )
    ties = instances.where(is_top).agg(F.count(F.lit(1)).alias("holders")).where("holders <> 1")
    return roles, ties.withColumn("rule", F.lit("largest_size_not_unique"))


def folds_loio(instances: DataFrame) -> DataFrame:
    """Leave-one-instance-out: each instance is the held-out member of its own fold."""
    return instances.select(
        F.concat_ws("::", *INSTANCE).alias("fold_id"), *INSTANCE, F.lit("test").alias("role")
    )


def folds_lofo(instances: DataFrame) -> DataFrame:
    """Leave-one-family-out: the held-out members of each family's fold."""
    return instances.select(F.col("family_id").alias("fold_id"), *INSTANCE, F.lit("test").alias("role"))


def fold_sizes(held_out: DataFrame, instances: DataFrame) -> DataFrame:
    """Test and train counts per complement fold, and whether both are non-empty."""
    total = instances.agg(F.count(F.lit(1))).scalar()
    return held_out.groupBy("fold_id").agg(F.count(F.lit(1)).alias("test_instances")).withColumn(
        "train_instances", total - F.col("test_instances")
    ).withColumn("usable", (F.col("train_instances") > 0) & (F.col("test_instances") > 0))


# -- static size threshold -----------------------------------------------------

#: objectives closer than this (in mean log units) count as tied
TIE_DIGITS = 12


def size_curve(pairs_: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of ``ln(selected / best)`` per size, for CPU and for GPU; best ignores caps."""
    best = F.least("cpu_time", "gpu_time")
    return pairs_.groupBy(*by, "n_configurations").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.ln(F.col("cpu_time") / best)).alias("log_cpu"),
        F.sum(F.ln(F.col("gpu_time") / best)).alias("log_gpu"),
    )


def family_curves(pairs_: DataFrame) -> DataFrame:
    """Training curve of every leave-one-family-out fold: all sizes minus the own family.

    Built from per-(family, size) sums: ``families x sizes`` small rows, whatever the
    number of instances. That product is the report itself.
    """
    own = size_curve(pairs_, ["family_id"])
    families = own.agg(F.collect_set("family_id")).scalar()
    total = own.groupBy("n_configurations").agg(
        F.sum("n").alias("n"), F.sum("log_cpu").alias("log_cpu"), F.sum("log_gpu").alias("log_gpu")
    )
    grid = total.withColumn("family_id", F.explode(families))
    held = own.select(
        "family_id", "n_configurations", F.col("n").alias("_n"), F.col("log_cpu").alias("_c"),
        F.col("log_gpu").alias("_g"),
    )
    left = grid.join(held, ["family_id", "n_configurations"], "left")
    return left.select(
        F.col("family_id").alias("fold_id"), "n_configurations",
        (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"),
        (F.col("log_cpu") - F.coalesce("_c", F.lit(0.0))).alias("log_cpu"),
        (F.col("log_gpu") - F.coalesce("_g", F.lit(0.0))).alias("log_gpu"),
    ).where("n > 0")


def _neighbours(curve: DataFrame, by: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Running sums of ``values`` plus the adjacent sizes ``prev_size`` and ``next_size``.

    Bucketed by size, so neither many folds nor very many distinct sizes meet in a task.
    """
    size, negated = F.col("n_configurations"), -F.col("n_configurations")
    summed = running(curve, by, ("n_configurations",), [value_bucket(size)], "sum", values, null_keys=False)
    lower = previous(summed, by, ("n_configurations",), [value_bucket(size)], ("n_configurations",), False)
    lower = lower.withColumnRenamed("prev_n_configurations", "prev_size").withColumn("_neg", negated)
    upper = previous(lower, by, ("_neg",), [value_bucket(F.col("_neg"))], ("n_configurations",), False)
    return upper.withColumnRenamed("prev_n_configurations", "next_size").drop("_neg")


def threshold_candidates(curve: DataFrame, by: Sequence[str] = ("fold_id",)) -> DataFrame:
    """Every cut with its objective, in registered order.

    Order 0 is ``always_gpu``, then geometric midpoints of adjacent sizes ascending,
    then ``always_cpu``. The curve is small and read by several steps: written once.
    """
    curve = materialized(curve)
    totals = curve.groupBy(*by).agg(F.sum("log_gpu").alias("_all_gpu"), F.sum("n").alias("_n"))
    cuts = _neighbours(curve, by, {
        "cut_order": F.lit(1).cast("bigint"), "_gain": F.col("log_cpu") - F.col("log_gpu"),
    }).join(totals, list(by))
    first = F.struct(
        F.lit(0).cast("bigint").alias("cut_order"), F.lit("always_gpu").alias("kind"),
        F.lit(None).cast("double").alias("threshold"), F.col("_all_gpu").alias("total"),
    )
    this = F.struct(
        F.col("cut_order").alias("cut_order"),
        F.when(F.col("next_size").isNull(), "always_cpu").otherwise("geometric_midpoint").alias("kind"),
        F.sqrt(F.col("n_configurations").cast("double") * F.col("next_size")).alias("threshold"),
        (F.col("_all_gpu") + F.col("_gain")).alias("total"),
    )
    both = F.when(F.col("cut_order") == 1, F.array(first, this)).otherwise(F.array(this))
    return cuts.select(*by, "_n", F.explode(both).alias("c")).select(
        *by, "c.cut_order", "c.kind", "c.threshold",
        (F.col("c.total") / F.col("_n")).alias("mean_log"),
        F.exp(F.col("c.total") / F.col("_n")).alias("objective"),
    )


def fit_thresholds(curve: DataFrame, by: Sequence[str] = ("fold_id",)) -> DataFrame:
    """Best cut per fold; ties keep the first registered cut."""
    chosen = F.min_by(
        F.struct("cut_order", "kind", "threshold", "objective"),
        F.struct(F.round("mean_log", TIE_DIGITS), "cut_order"),
    )
    return threshold_candidates(curve, by).groupBy(*by).agg(chosen.alias("m")).select(*by, "m.*")


def loio_thresholds(pairs_: DataFrame) -> DataFrame:
    """Best cut of every leave-one-instance-out fold in closed form.

    Removing one instance shifts the whole curve below its size by its GPU term and
    from its size on by its CPU term. So each fold needs two minima of the one global
    curve, and all instances meet them in a join on the size: linear in instances.
    """
    best = F.least("cpu_time", "gpu_time")
    curve = materialized(size_curve(pairs_.withColumn("_all", F.lit(1)), ["_all"]))
    all_gpu = curve.agg(F.sum("log_gpu")).scalar()
    all_n = curve.agg(F.sum("n")).scalar()
    cuts = materialized(_neighbours(curve, ["_all"], {
        "k": F.lit(1).cast("bigint"), "_gain": F.col("log_cpu") - F.col("log_gpu"),
    }).withColumn("_g0", all_gpu).withColumn("_n", all_n).withColumn("_neg", -F.col("n_configurations")))
    total = F.col("_g0") + F.col("_gain")
    key = F.struct(F.round(total / F.col("_n"), TIE_DIGITS).alias("m"), F.col("k").alias("k"),
                   total.alias("g"), F.col("n_configurations").alias("size"),
                   F.col("next_size").alias("next"))
    zero = F.struct(F.round(F.col("_g0") / F.col("_n"), TIE_DIGITS).alias("m"),
                    F.lit(0).cast("bigint").alias("k"), F.col("_g0").alias("g"),
                    F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("next"))
    size, back = ("n_configurations",), ("_neg",)
    below = running(cuts, ["_all"], size, [value_bucket(F.col("n_configurations"))], "min",
                    {"_below": key}, inclusive=False, null_keys=False)
    per_size = running(below, ["_all"], back, [value_bucket(F.col("_neg"))], "min", {"_above": key},
                       null_keys=False).withColumn("_below", F.least(zero, F.col("_below")))
    chosen = pairs_.select(
        *INSTANCE, "n_configurations",
        F.ln(F.col("cpu_time") / best).alias("_c"), F.ln(F.col("gpu_time") / best).alias("_d"),
    ).join(per_size, "n_configurations")
    left = (F.col("_below.g") - F.col("_d")) / (F.col("_n") - 1)
    right = (F.col("_above.g") - F.col("_c")) / (F.col("_n") - 1)
    take_below = F.round(left, TIE_DIGITS) <= F.round(right, TIE_DIGITS)
    cut = F.when(take_below, F.col("_below")).otherwise(F.col("_above"))
    alone = F.col("n") == 1
    picked = chosen.select(
        *INSTANCE, "n_configurations", "prev_size", "next_size", alone.alias("_alone"),
        cut.alias("cut"), F.when(take_below, left).otherwise(right).alias("mean_log"),
    )
    # a size that only the held-out instance has is no training size: its two cuts merge
    lower = F.when(
        F.col("_alone") & (F.col("cut.size") == F.col("n_configurations")), F.col("prev_size")
    ).otherwise(F.col("cut.size"))
    upper = F.when(
        F.col("_alone") & (F.col("cut.next") == F.col("n_configurations")), F.col("next_size")
    ).otherwise(F.col("cut.next"))
    kind = (
        F.when((F.col("cut.k") == 0) | lower.isNull(), "always_gpu")
        .when(upper.isNull(), "always_cpu").otherwise("geometric_midpoint")
    )
    return picked.select(
        F.concat_ws("::", *INSTANCE).alias("fold_id"), *INSTANCE, "n_configurations",
        kind.alias("kind"),
        F.when(kind == "geometric_midpoint", F.sqrt(lower.cast("double") * upper)).alias("threshold"),
        F.exp("mean_log").alias("objective"),
    )


def select_threshold(size: Column, kind: Column, threshold: Column) -> Column:
    """Candidate chosen by a fitted threshold: CPU at or below, GPU above."""
    return (
        F.when(kind == "always_gpu", GPU).when(kind == "always_cpu", CPU)
        .when(size <= threshold, CPU).when(size > threshold, GPU)
    )


# -- predictions and metrics ---------------------------------------------------


def predict_policies(pairs_: DataFrame, decisions: dict[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """One row per instance and policy; a narrow projection, no join, no shuffle.

    ``carry`` are further columns of ``pairs_`` to keep.

    ``decisions`` maps each policy to a Column over ``pairs_`` (joined fold models
    included) that names its candidate or is NULL.
    """
    c = F.col
    entries = F.array(*[
        F.struct(F.lit(p).alias("policy"), d.cast("string").alias("decision")) for p, d in decisions.items()
    ])
    rows = pairs_.withColumn("_p", F.explode(entries)).select(
        *pairs_.columns, "_p.policy", F.col("_p.decision").alias("decision_candidate_name")
    )
    decided = c("decision_candidate_name")
    time = F.when(decided == CPU, c("cpu_time")).when(decided == GPU, c("gpu_time"))
    fits = F.when(decided == CPU, c("cpu_feasible")).when(decided == GPU, c("gpu_feasible"))
    reason = (
        F.when(c("best_time").isNull(), "no_feasible_candidates")
        .when(decided.isNull(), "policy_returned_no_candidate")
        .when(time.isNull(), "candidate_not_in_matrix")
        .when(~F.coalesce(fits, F.lit(False)), "selected_candidate_memory_infeasible")
    )
    valid = reason.isNull()
    runtime = runtime_ratio(time, c("best_time"))
    return rows.select(
        *INSTANCE, "n_configurations", "policy", "decision_candidate_name",
        F.when(valid, decided).alias("selected_candidate_name"),
        c("best_time").alias("oracle_wall_time_s"),
        F.when(valid, time).alias("selected_wall_time_s"),
        F.when(valid, runtime).alias("normalized_runtime"),
        F.when(valid, normalized_regret(time, c("best_time"))).alias("normalized_regret"),
        F.when(valid, c("cpu_time") / time).alias("speedup_vs_fixed_cpu"),
        F.when(valid, c("gpu_time") / time).alias("speedup_vs_fixed_gpu"),
        (valid & F.array_contains("best_names", decided)).alias("selection_correct"),
        (valid & (runtime <= 1.05)).alias("within_5pct_oracle"),
        valid.alias("valid"), F.lit(False).alias("failure"), reason.alias("invalid_reason"), *carry,
    )


def best_name() -> Column:
    """The measured feasible best; ties go to the first name."""
    return F.array_min("best_names")


def baseline_decisions(kind: str = "kind", threshold: str = "threshold") -> dict[str, Column]:
    """Decisions of the policies that need no tree; the fold's threshold is joined."""
    return {
        FIXED_CPU: F.lit(CPU), FIXED_GPU: F.lit(GPU),
        THRESHOLD: select_threshold(F.col("n_configurations"), F.col(kind), F.col(threshold)),
        BEST: best_name(),
    }


#: what ``policy_metrics`` reads of a prediction
METRIC_COLUMNS = (
    "family_id", "policy", "valid", "failure", "selection_correct", "within_5pct_oracle",
    "normalized_runtime", "normalized_regret", "speedup_vs_fixed_cpu", "speedup_vs_fixed_gpu",
)


def policy_metrics(predictions: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Metrics per policy, pooled and per family.

    Rates divide by all rows; regret quantiles and geometric means use valid rows; a
    speedup is NULL unless every valid row has one.
    """
    rows = _scoped(predictions, {"pooled": (), "heldout_family": ("family_id",)}, ("family_id",))
    keys = ["scope", "family_id", "policy"]
    c = F.col
    n = F.count(F.lit(1))

    def all_or_none(column: str) -> Column:
        known = F.count(F.when(c("valid"), c(column)))
        return F.when((known == F.count_if(c("valid"))) & (known > 0),
                      geomean(F.when(c("valid"), c(column))))

    extra = {
        "instances_total": n,
        "valid_instances": F.count_if("valid"),
        "invalid_instances": n - F.count_if("valid"),
        "failure_count": F.count_if("failure"),
        "invalid_rate": (n - F.count_if("valid")) / n,
        "failure_rate": F.count_if("failure") / n,
        "selection_accuracy": F.count_if("selection_correct") / n,
        "within_5pct_rate": F.count_if("within_5pct_oracle") / n,
        "geomean_selected_over_best": geomean(F.when(c("valid"), c("normalized_runtime"))),
        "geomean_best_over_selected": geomean(F.when(c("valid"), 1 / c("normalized_runtime"))),
        "regret_max": F.max(F.when(c("valid"), c("normalized_regret"))),
        "geomean_speedup_cpu": all_or_none("speedup_vs_fixed_cpu"),
        "geomean_speedup_gpu": all_or_none("speedup_vs_fixed_gpu"),
    }
    out = grouped_quantiles(
        rows.withColumn("regret", F.when(c("valid"), c("normalized_regret"))), keys, ["regret"],
        (0.5, 0.9), hot_rows, extra=[v.alias(k) for k, v in extra.items()], names=list(extra),
    )
    return out.withColumnsRenamed({"regret_p0": "regret_median", "regret_p1": "regret_p90"})


def prediction_rules() -> list:
    """Derived columns of a stored prediction row agree with its times to 1e-12."""
    c = F.col
    ok = c("valid")
    runtime = c("selected_wall_time_s") / c("oracle_wall_time_s")
    return [
        rule("runtime_differs", ok & ~close(c("normalized_runtime"), runtime, 1e-12, 1e-12)),
        rule("regret_differs", ok & ~close(c("normalized_regret"), runtime - 1, 1e-12, 1e-12)),
        rule("within_5pct_differs", ok & (c("within_5pct_oracle") != (runtime <= 1.05))),
        rule("correct_but_slower", ok & c("selection_correct") & (runtime > 1 + 1e-12)),
        rule("invalid_without_reason", ~ok & c("invalid_reason").isNull()),
        rule("valid_with_reason", ok & c("invalid_reason").isNotNull()),
        rule("invalid_with_selection", ~ok & c("selected_candidate_name").isNotNull()),
    ]


def attach_folds(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """Fold columns joined on the held-out family."""
    return predictions.join(folds, "family_id", "left")
