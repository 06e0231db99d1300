"""Records to timing rows, eligibility, grouped summaries, oracles, ratios."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.functions.scaled import HOT_ROWS, numbered_groups, previous, summary
from trialflow.functions.stats import finite, is_false, is_true, ratio
from trialflow.operators.rules import Rule, needs, reasons, rule

WORKLOAD = ("family_id", "problem_instance", "input_sha256")
CANDIDATE = ("candidate_name", "backend", "cpu_threads")

#: record field -> flat row column; nested paths keep missing objects as NULL
FLAT_FIELDS = {
    "trial_id": "trial_id",
    "logical_trial_id": "logical_trial_id",
    "attempt_index": "attempt_index",
    "schema_version": "schema_version",
    "timestamp_utc": "timestamp_utc",
    "finished_timestamp_utc": "finished_timestamp_utc",
    "hostname": "hostname",
    "warmup_or_measured": "phase",
    "repetition": "repetition",
    "problem_instance": "problem_instance",
    "family_id": "family_id",
    "molecule": "molecule",
    "basis": "basis",
    "input_sha256": "input_sha256",
    "logical_identity.candidate.name": "candidate_name",
    "backend": "backend",
    "cpu_threads": "cpu_threads",
    "wall_time_s": "wall_time_s",
    "solver_time_s": "solver_time_s",
    "initialization_time_s": "initialization_time_s",
    "matvec_time_s": "matvec_time_s",
    "transfer_time_s": "transfer_time_s",
    "input_features.fcidump.n_orbitals": "n_orbitals",
    "input_features.alpha.count": "n_alpha_strings",
    "input_features.beta.count": "n_beta_strings",
    "input_features.n_configurations": "n_configurations",
    "input_features.method0_work_proxy": "estimated_work",
    "peak_host_rss_mb": "peak_host_rss_mb",
    "peak_gpu_memory_mb": "peak_gpu_memory_mb",
    "iterations": "iterations",
    "energy_or_eigenvalue": "energy",
    "reference_value": "reference_value",
    "status": "status",
    "correct": "correct",
    "timing_eligible": "timing_eligible",
    "process_success": "process_success",
    "scientific_success": "scientific_success",
    "project_git_dirty": "project_git_dirty",
    "protocol.purpose": "purpose",
    "protocol.correctness_validated": "correctness_validated",
    "validation_evidence.required": "validation_required",
    "validation_evidence.valid": "validation_valid",
    "input_integrity.unchanged_before_launch": "unchanged_before_launch",
    "input_integrity.unchanged_after_run": "unchanged_after_run",
    "input_integrity.rehash_error": "rehash_error",
    "resource_monitoring.host_complete": "host_complete",
    "resource_monitoring.samples": "samples",
    "resource_monitoring.gpu_complete": "gpu_complete",
    "resource_monitoring.gpu_process_observed": "gpu_process_observed",
}


def flatten_runs(records: DataFrame) -> DataFrame:
    """Nested records to flat timing rows; absent objects give NULL columns."""
    return records.select(
        *[F.col(path).alias(name) for path, name in FLAT_FIELDS.items()],
        F.col("resource_monitoring").isNotNull().alias("has_monitoring"),
        F.col("input_features").isNotNull().alias("has_features"),
        F.to_json("input_features").alias("input_features_json"),
    )


def exclusion_rules() -> list[Rule]:
    """Why a record does not count as a timing; names are part of the output format."""
    c = F.col
    gpu = c("backend") == "gpu"
    return [
        # fixed values: reason codes
        needs("schema_version_not_2_or_3", c("schema_version").isin(2, 3)),
        needs("warmup", ~(c("phase").eqNullSafe("warmup"))),
        needs("phase_not_measured", c("phase").isin("warmup", "measured")),
        needs("timing_ineligible", c("timing_eligible")),
        needs("backend_not_cpu_or_gpu", c("backend").isin("cpu", "gpu")),
        needs("status_not_success", c("status") == "success"),
        needs("process_not_successful", c("process_success")),
        needs("scientific_not_successful", c("scientific_success")),
        needs("correct_not_true", c("correct")),
        needs("project_not_clean", is_false(c("project_git_dirty"))),
        needs("correctness_not_validated", c("correctness_validated")),
        needs("validation_manifest_invalid",
              is_true(c("validation_required")) & is_true(c("validation_valid"))),
        needs("input_changed_before_launch", c("unchanged_before_launch")),
        needs("input_changed_after_run", c("unchanged_after_run")),
        rule("input_rehash_error", c("rehash_error").isNotNull()),
        needs("host_monitor_incomplete", c("host_complete")),
        rule("resource_samples_missing",
             c("has_monitoring") & ~F.coalesce(c("samples") > 0, F.lit(False))),
        rule("gpu_monitor_incomplete", is_true(gpu) & ~is_true(c("gpu_complete"))),
        rule("gpu_process_not_observed", is_true(gpu) & ~is_true(c("gpu_process_observed"))),
        needs("wall_time_invalid", finite(c("wall_time_s")) & (c("wall_time_s") > 0)),
        needs("solver_time_invalid", finite(c("solver_time_s")) & (c("solver_time_s") >= 0)),
        rule("candidate_name_missing", F.coalesce(c("candidate_name"), F.lit("")) == ""),
        needs("input_features_missing", c("has_features")),
    ]


def classify(rows: DataFrame) -> DataFrame:
    """Add ``exclusion_reasons`` and ``included``; one narrow pass."""
    return rows.withColumn("exclusion_reasons", reasons(exclusion_rules())).withColumn(
        "included", F.size("exclusion_reasons") == 0
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    """Records per reason; a record counts once for each of its reasons."""
    return (
        rows.select(F.explode(F.array_distinct("exclusion_reasons")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("records"))
    )


def record_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if("included").alias("included_records"),
        F.count_if(~F.col("included")).alias("excluded_records"),
    )


def family_summary(rows: DataFrame) -> DataFrame:
    """Counts per family with the number of distinct instances."""
    per_instance = rows.groupBy("family_id", "molecule", "basis", "problem_instance").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("included").alias("_i")
    )
    return per_instance.groupBy("family_id", "molecule", "basis").agg(
        F.sum("_n").alias("input_records"),
        F.sum("_i").alias("included_records"),
        F.count(F.lit(1)).alias("problem_instances"),
    )


def family_instances(rows: DataFrame) -> DataFrame:
    """The distinct instances of each family, as rows."""
    return rows.select("family_id", "problem_instance").distinct()


def timing_groups(
    included: DataFrame,
    keys: Sequence[str] = (*WORKLOAD, *CANDIDATE),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Seven-number summaries of wall and solver time per candidate group."""
    return summary(included, keys, ("wall_time_s", "solver_time_s"), hot_rows=hot_rows)


def timing_members(
    included: DataFrame, keys: Sequence[str] = (*WORKLOAD, *CANDIDATE)
) -> DataFrame:
    """Members of each group numbered in (timestamp, id) order, as rows."""
    order = ("timestamp_utc", "trial_id")
    minute = F.substring("timestamp_utc", 1, 16)
    out = numbered_groups(included.select(*keys, *order), keys, order, [minute], "position")
    return out.select(*keys, "position", "trial_id")


def best_per_workload(
    groups: DataFrame, metric: str, workload: Sequence[str] = WORKLOAD
) -> DataFrame:
    """Minimum of ``metric`` and every candidate that reaches it exactly, as rows."""
    # a partition holds the registered candidates of one workload
    best = F.min(metric).over(Window.partitionBy(*workload))
    return groups.select("*", best.alias("minimum")).withColumn(
        "is_best", F.col(metric) == F.col("minimum"))


def candidate_ratios(
    groups: DataFrame,
    candidates: Sequence[str],
    metrics: dict[str, str],
    workload: Sequence[str] = WORKLOAD,
) -> DataFrame:
    """Left/right ratios for the pairs of *registered* candidates of each workload.

    The pairs come from the plan, not from the data, so the output has at most
    ``k*(k-1)/2`` rows per workload. ``metrics`` maps output name to column.
    """
    names = sorted(candidates)
    cells = [
        F.max(F.when(F.col("candidate_name") == name, F.struct(*metrics.values()))).alias(f"_c{i}")
        for i, name in enumerate(names)
    ]
    wide = groups.groupBy(*workload).agg(*cells)
    pairs = F.array(*[
        F.struct(
            F.lit(names[i]).alias("left_candidate"), F.lit(names[j]).alias("right_candidate"),
            F.col(f"_c{i}").alias("l"), F.col(f"_c{j}").alias("r"),
        )
        for i, j in combinations(range(len(names)), 2)
    ])
    out = wide.select(*workload, F.explode(pairs).alias("p")).where(
        F.col("p.l").isNotNull() & F.col("p.r").isNotNull()
    )
    return out.select(
        *workload, "p.left_candidate", "p.right_candidate",
        *[ratio(F.col(f"p.l.{c}"), F.col(f"p.r.{c}")).alias(name) for name, c in metrics.items()],
    )


# -- views -----------------------------------------------------------------

REPETITIONS = (0, 1, 2)


def balanced_view(rows: DataFrame, repetitions: Sequence[int] = REPETITIONS) -> DataFrame:
    return rows.where(
        is_true(F.col("included")) & (F.col("phase") == "measured")
        & F.col("repetition").isin(*repetitions)
    )


def purpose_view(
    rows: DataFrame, keep: Sequence[str] = ("final",), drop: Sequence[str] = ("pilot",)
) -> tuple[DataFrame, DataFrame]:
    """Rows of the kept purposes, and a violation for any purpose not named."""
    known = F.coalesce(F.col("purpose").isin(*keep, *drop), F.lit(False))
    bad = rows.where(~known).select("trial_id", F.lit("unexpected_purpose").alias("rule"))
    return rows.where(F.col("purpose").isin(*keep)), bad


def eligible(rows: DataFrame, backend: str | None = None) -> DataFrame:
    """Successful, correct, timing-eligible, measured rows of one backend."""
    kept = rows.where(
        (F.col("status") == "success") & is_true(F.col("correct"))
        & is_true(F.col("timing_eligible")) & (F.col("phase") == "measured")
    )
    if backend is not None:
        kept = kept.where(F.col("backend") == backend)
    if backend == "cpu":
        kept = kept.where(F.col("cpu_threads") > 0)
    return kept


def parity_view(rows: DataFrame) -> DataFrame:
    """Successful, correct rows that carry energy, reference and relative error."""
    return rows.where((F.col("status") == "success") & is_true(F.col("correct"))).dropna(
        subset=["energy", "reference_value", "relative_error"]
    )


def named_views(rows: DataFrame, views: dict[str, Column]) -> DataFrame:
    """Long table ``(view, trial_id)``; a row may be in several views."""
    named = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in views.items()
    ]))
    return rows.select(F.explode(named).alias("view"), "trial_id")


# -- derived tables ----------------------------------------------------------


def funnel(rows: DataFrame) -> DataFrame:
    """Total, successful and correct, then also measured and eligible."""
    verified = (F.col("status") == "success") & is_true(F.col("correct"))
    counted = verified & (F.col("phase") == "measured") & is_true(F.col("timing_eligible"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(verified).alias("success_correct"),
        F.count_if(counted).alias("measured_eligible"),
    )


def thread_scaling(rows: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Per instance and thread count; only instances run at two or more counts."""
    keys = ["problem_instance", "family_id", "n_configurations", "cpu_threads"]
    groups = summary(rows, keys, ("wall_time_s", "solver_time_s"), hot_rows=hot_rows)
    # a partition holds the thread counts of one instance
    levels = F.size(F.collect_set("cpu_threads").over(Window.partitionBy("problem_instance")))
    return groups.withColumn("_levels", levels).where("_levels >= 2").drop("_levels")


def headroom(rows: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Peak device memory per instance against its guard and the smallest cap."""
    keys = ["problem_instance", "n_configurations"]
    extra = (
        F.max("guard_mib").alias("guard_mib"),
        (F.min("guard_mib") == F.max("guard_mib")).alias("guard_constant"),
        F.min("cap_mib").alias("minimum_cap_mib"),
    )
    names = ("guard_mib", "guard_constant", "minimum_cap_mib")
    return summary(rows, keys, ("peak_gpu_memory_mb",), extra, names, hot_rows)


def rank_candidates(
    rows: DataFrame, metrics: Sequence[str], workload: Sequence[str] = ("problem_instance",)
) -> DataFrame:
    """Competition rank, ratio to the best and winner flag per metric.

    One row per (workload, candidate): a group holds the registered candidates.
    """
    by = Window.partitionBy(*workload)
    columns = []
    for metric in metrics:
        stem = metric.removesuffix("_time_s")
        best = F.min(metric).over(by)
        columns += [
            F.rank().over(by.orderBy(metric)).cast("bigint").alias(f"{stem}_rank"),
            (F.col(metric) / best).alias(f"{stem}_over_best"),
            (F.col(metric) == best).alias(f"{stem}_winner"),
        ]
    return rows.select("*", *columns)


def winner_flips(
    winners: DataFrame, by: Sequence[str], size: str, instance: str, winner: str
) -> DataFrame:
    """Neighbouring sizes between which the winner changes; all flips."""
    # instances of one size are spread by the prefix of their name
    out = previous(
        winners, by, (size, instance), (F.col(size), F.substring(instance, 1, 8)),
        (size, winner, instance),
    )
    flipped = F.col(f"prev_{winner}").isNotNull() & (F.col(f"prev_{winner}") != F.col(winner))
    return out.where(flipped).select(
        *by,
        F.col(f"prev_{size}").alias("lower_size"), F.col(size).alias("upper_size"),
        F.col(f"prev_{instance}").alias("lower_instance"),
        F.col(instance).alias("upper_instance"),
        F.col(f"prev_{winner}").alias("lower_winner"), F.col(winner).alias("upper_winner"),
    )
