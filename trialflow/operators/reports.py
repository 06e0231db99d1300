"""The tables behind the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialflow.functions.stats import mib, pct, ratio
from trialflow.operators.policy import CPU, FULL_TREE, GPU, SIZE_TREE
from trialflow.operators.timing import WORKLOAD, eligible


def crossover(
    groups: DataFrame, cpu: str, gpu: str, workload: Sequence[str] = WORKLOAD
) -> DataFrame:
    """Medians, quartiles, best flag and CPU/GPU median ratio per workload and candidate."""
    metric = F.col("wall_time_s_median")
    # a partition holds the registered candidates of one workload
    by = Window.partitionBy(*workload)

    def of(name: str):
        return F.max(F.when(F.col("candidate_name") == name, metric)).over(by)

    placed = groups.select(
        "*", F.min(metric).over(by).alias("minimum"), of(cpu).alias("_cpu"), of(gpu).alias("_gpu"))
    return placed.withColumn("is_best", metric == F.col("minimum")).withColumn(
        "cpu_over_gpu", ratio(F.col("_cpu"), F.col("_gpu"))
    ).drop("_cpu", "_gpu")


def memory_guard(rows: DataFrame) -> DataFrame:
    """Measured device peaks of eligible GPU rows beside guard and cap, in MiB."""
    return eligible(rows, "gpu").select(
        "trial_id", "problem_instance", "n_configurations", "repetition",
        F.col("peak_gpu_memory_mb").alias("peak_gpu_memory_mib"),
        mib(F.col("guard_bytes")).alias("guard_mib"), mib(F.col("cap_bytes")).alias("cap_mib"),
        (F.col("guard_bytes") <= F.col("cap_bytes")).alias("admitted"),
    )


def generalization(metrics: DataFrame) -> DataFrame:
    """Held-out metrics per policy and scope, rates in percent."""
    return metrics.select(
        "scope", "family_id", "policy", "instances_total",
        pct(F.col("selection_accuracy")).alias("accuracy_pct"),
        pct(F.col("within_5pct_rate")).alias("within_5pct_pct"),
        F.col("geomean_selected_over_best").alias("selected_over_best"),
        pct(F.col("regret_median")).alias("median_regret_pct"),
        pct(F.col("regret_max")).alias("maximum_regret_pct"),
    )


def parity(rows: DataFrame) -> DataFrame:
    """Energy against its reference, one row per verified trial."""
    return rows.select(
        "trial_id", "family_id", "backend", "energy", "reference_value",
        (F.col("energy") - F.col("reference_value")).alias("energy_error"), "relative_error",
    )


def decision_matrix(predictions: DataFrame, policies: Sequence[str]) -> DataFrame:
    """One row per instance; decision and regret of each policy as columns."""
    return predictions.groupBy("family_id", "problem_instance", "n_configurations").pivot(
        "policy", list(policies)
    ).agg(
        F.max("selected_candidate_name").alias("selected"),
        F.max("normalized_regret").alias("regret"),
    )


def misses(predictions: DataFrame, learned: Sequence[str]) -> DataFrame:
    """Learned decisions that cost time, worst first."""
    return predictions.where(
        F.col("policy").isin(*learned) & (F.col("normalized_regret") > 0)
    ).orderBy(F.desc("normalized_regret"), "family_id", "problem_instance", "policy")


def ablation(summary_: DataFrame, learned: Sequence[str]) -> DataFrame:
    """The learned policies of a policy summary."""
    return summary_.where(F.col("policy").isin(*learned))


def prediction_export(predictions: DataFrame, provenance: Sequence[str] = ()) -> DataFrame:
    """Prediction rows as flat text-ready columns; lists are joined, absent selections empty.

    Needs the columns that a full prediction carries: the input hash, the record ids of
    both candidates, the names of the best ones and the predictions of the trees.
    """
    c = F.col
    joined = lambda column: F.array_join(F.array_sort(column), ";")
    chosen = F.when(c("selected_candidate_name") == CPU, c("cpu_source_record_ids")).when(
        c("selected_candidate_name") == GPU, c("gpu_source_record_ids"))
    none = F.array().cast("array<string>")
    best = F.concat(*[F.when(F.array_contains("best_names", name), c(f"{p}_source_record_ids")).otherwise(none) for p, name in (("cpu", CPU), ("gpu", GPU))])
    predicted = F.when(c("policy") == SIZE_TREE, c(f"{SIZE_TREE}_predictions")).when(c("policy") == FULL_TREE, c(f"{FULL_TREE}_predictions"))
    return predictions.select(
        c("family_id").alias("fold_id"), c("family_id").alias("heldout_family_id"), "policy", "family_id", *provenance,
        F.concat_ws("::", "family_id", "problem_instance").alias("instance_id"), "problem_instance", "input_sha256", "n_configurations",
        "decision_candidate_name", F.coalesce("selected_candidate_name", F.lit("")).alias("selected_candidate_name"),
        joined(F.coalesce(chosen, none)).alias("selected_source_record_ids"), joined("best_names").alias("oracle_candidate_names"),
        joined(best).alias("oracle_source_record_ids"), "oracle_wall_time_s", "selected_wall_time_s", "normalized_runtime", "normalized_regret",
        "speedup_vs_fixed_cpu", "speedup_vs_fixed_gpu", "selection_correct", "within_5pct_oracle", "valid", "failure", "invalid_reason",
        predicted[CPU].alias("predicted_cpu"), predicted[GPU].alias("predicted_gpu"),
    )


def policy_summary(metrics: DataFrame, order: Sequence[str]) -> DataFrame:
    """Policy summary export: pooled scope first, then families, policies in registered order."""
    names = {
        "family_id": "heldout_family_id", "instances_total": "requested_instances", "failure_count": "failure_instances",
        "within_5pct_rate": "within_5pct_oracle_rate", "geomean_selected_over_best": "selected_over_oracle", "geomean_best_over_selected": "oracle_over_selected",
        "geomean_speedup_cpu": "speedup_vs_fixed_cpu", "geomean_speedup_gpu": "speedup_vs_fixed_gpu",
    }
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("policy"))
    return metrics.orderBy(F.desc("scope"), "family_id", rank).withColumn("policy_order", rank.cast("bigint")).withColumnsRenamed(names)


def attest(
    plan: DataFrame, rows: DataFrame, keys: Sequence[str], views: dict, rules: list,
    dimensions: Sequence[str], inventory: Sequence[str], rate_per_hour: float,
    host: str = "hostname", start: str = "started", finish: str = "finished",
) -> dict[str, DataFrame]:
    """The tables of a completion attestation; the campaign is complete when
    ``completeness``, ``violations`` and ``overlaps`` are empty."""
    from trialflow.functions.derive import cost
    from trialflow.operators import audit
    from trialflow.operators.rules import check
    from trialflow.operators.timing import named_views
    from trialflow.plans.grid import completeness

    membership = named_views(rows, views)
    temporal = audit.temporal_summary(rows, [host], start, finish)
    return {
        "completeness": completeness(plan, rows, keys),
        "violations": check(rows, rules, ["trial_id"]),
        "overlaps": audit.overlaps(rows, [host], "trial_id", start, finish),
        "counts": audit.counts(rows, dimensions),
        "views": membership,
        "view_sizes": membership.groupBy("view").agg(F.count(F.lit(1)).alias("records")),
        "temporal": temporal,
        "cost": temporal.agg(F.sum("span_s").alias("span_s")).withColumn(
            "cost", cost(F.col("span_s"), rate_per_hour)),
        "evidence": audit.chain_hash(rows, inventory),
        "trace": audit.view_membership(rows.select("trial_id", *dimensions), membership),
    }


def attestation_findings(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of findings per gate table; all zero means complete."""
    out = None
    for name in ("completeness", "violations", "overlaps"):
        counted = tables[name].agg(F.count(F.lit(1)).alias("findings")).select(
            F.lit(name).alias("gate"), "findings")
        out = counted if out is None else out.unionByName(counted)
    return out
