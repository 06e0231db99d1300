"""Trial grids: expansion, reproducible order, completeness, resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.functions.identity import seeded_key
from trialflow.functions.scaled import keyed_join, running
from trialflow.operators.rules import Rule, needs, rule

ORDER_TAG = "order-v1"
PHASES = ("warmup", "measured")


def _counted(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(
        F.array().cast("array<bigint>")
    )


def expand_plan(workloads: DataFrame, candidates: DataFrame, protocol: DataFrame) -> DataFrame:
    """Every (phase, repetition, workload, candidate) of each campaign.

    ``workloads(campaign, workload, position, ...)``, ``candidates(campaign, candidate,
    ...)`` and ``protocol(campaign, warmups, repetitions, seed)`` meet on the campaign;
    repetitions are exploded from the counts.
    """
    def repetitions(index: int, phase: str, count: str) -> Column:
        def entry(r: Column) -> Column:
            return F.struct(
                F.lit(index).alias("phase_order"), F.lit(phase).alias("phase"), r.alias("repetition")
            )

        return F.transform(_counted(F.col(count)), entry)

    runs = F.concat(*[
        repetitions(index, phase, count)
        for index, (phase, count) in enumerate(zip(PHASES, ("warmups", "repetitions")))
    ])
    repeated = protocol.select("campaign", "seed", F.explode(runs).alias("r")).select(
        "campaign", "seed", "r.phase_order", "r.phase", "r.repetition"
    )
    shape = candidates.join(repeated, "campaign")
    return workloads.join(shape, "campaign")


def order_key() -> Column:
    return seeded_key(
        F.lit(ORDER_TAG), F.col("seed"), F.col("campaign"), F.col("workload"), F.col("phase"),
        F.col("repetition"), F.col("candidate"),
    )


def shuffled(plan: DataFrame) -> DataFrame:
    """Position of each candidate inside its (campaign, phase, repetition, workload) slot.

    A slot holds one row per registered candidate.
    """
    slot = Window.partitionBy("campaign", "phase", "repetition", "workload").orderBy(
        "order_key", "candidate"
    )
    return plan.withColumn("order_key", order_key()).withColumn(
        "slot_position", F.row_number().over(slot).cast("bigint")
    )


TRIAL_ORDER = ("campaign", "phase_order", "repetition", "position", "slot_position", "candidate")


def in_order(plan: DataFrame) -> DataFrame:
    return plan.orderBy(*TRIAL_ORDER)


def first_trials(plan: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` trials in execution order (top-k, no full sort)."""
    return in_order(plan).limit(limit)


def protocol_order(df: DataFrame, column: str, names: Sequence[str], *then: str) -> DataFrame:
    """Sort by the registered order of ``column`` values, unregistered last."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    ordered = df.withColumn(f"{column}_order", F.when(rank > 0, rank))
    return ordered.orderBy(F.col(f"{column}_order").asc_nulls_last(), *then)


def completeness(plan: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, unplanned or recorded more than once, with counts.

    One combined aggregation over both sides: no join, hot keys combine map-side.
    """
    both = plan.select(*keys, F.lit(1).alias("_p"), F.lit(0).alias("_a")).unionByName(
        actual.select(*keys, F.lit(0).alias("_p"), F.lit(1).alias("_a"))
    )
    counts = both.groupBy(*keys).agg(
        F.sum("_p").alias("planned"), F.sum("_a").alias("recorded")
    )
    kind = (
        F.when(F.col("planned") == 0, "unplanned").when(F.col("recorded") == 0, "missing")
        .when(F.col("recorded") > 1, "duplicate")
    )
    return counts.withColumn("kind", kind).where("kind IS NOT NULL")


def pending(plan: DataFrame, recorded: DataFrame, key: str = "trial_id") -> DataFrame:
    return plan.join(recorded.select(key), key, "left_anti")


def reused(plan: DataFrame, recorded: DataFrame, key: str = "trial_id") -> DataFrame:
    return plan.join(recorded.select(key), key, "left_semi")


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("trials"))


def launch_counts(plan: DataFrame, recorded: DataFrame, key: str = "trial_id") -> DataFrame:
    """Totals of reused and still to be launched trials."""
    marked = plan.join(recorded.select(key, F.lit(True).alias("_seen")).distinct(), key, "left")
    return marked.agg(
        F.count_if(F.col("_seen")).alias("reused"),
        F.count_if(F.col("_seen").isNull()).alias("launched"),
    )


def until_first_failure(
    rows: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Sequence[Column]
) -> DataFrame:
    """Rows of each sequence up to and including its first non-success."""
    failed = (~F.coalesce(F.col("status") == "success", F.lit(False))).cast("bigint")
    out = running(rows, by, order, bucket, "sum", {"_failed_before": failed}, inclusive=False)
    return out.where("_failed_before = 0").drop("_failed_before")


def matrix_gaps(
    rows: DataFrame, by: Sequence[str], column: str, required: Sequence[str]
) -> DataFrame:
    """Groups that lack one of the registered values of ``column``."""
    seen = rows.select(*by, column).distinct()
    wanted = rows.select(*by).distinct().withColumn(
        column, F.explode(F.array(*[F.lit(v) for v in required]))
    )
    return keyed_join(wanted, seen, [*by, column], "left_anti")


def plan_rules() -> list[Rule]:
    """Row-level constraints of a plan; uniqueness is :func:`completeness` territory."""
    c = F.col
    return [
        needs("workload_missing", F.trim("workload") != ""),
        needs("candidate_missing", F.trim("candidate") != ""),
        needs("backend_unknown", c("backend").isin("cpu", "gpu", "mock")),
        needs("threads_not_positive", c("threads") > 0),
        needs("ranks_not_positive", c("mpi_ranks") > 0),
        needs("repetitions_not_positive", c("repetitions") > 0),
        needs("warmups_negative", c("warmups") >= 0),
        rule("ranks_not_divisible",
             F.coalesce(c("mpi_ranks") % c("communicator_product") != 0, F.lit(True))),
    ]
