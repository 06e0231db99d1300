"""Timing rows, eligibility, summaries, oracles, ranks and their report tables."""

from pyspark.sql import functions as F

from queries.base import DUCK_ACCEPTED, DUCK_RUNS, ELIGIBLE, duck, eligible_runs, load, register, runs
from trialflow.functions.stats import mib
from trialflow.operators import timing as T
from trialflow.session import materialized

ROWS = DUCK_RUNS + """, rows_ AS (SELECT *, TRUE AS has_monitoring, problem_instance <> 'inst-13' AS has_features,
  phase = 'measured' AND scientific_success AND coalesce(correct, FALSE) AND purpose <> 'correctness' AS timing_eligible FROM runs)"""


def rows(spark, sf_dir):
    return runs(spark, sf_dir).selectExpr(
        "*", "true AS has_monitoring", "problem_instance <> 'inst-13' AS has_features",
        "phase = 'measured' AND scientific_success AND coalesce(correct, FALSE)"
        " AND purpose <> 'correctness' AS timing_eligible",
    )


# fixed values: the reason codes
REASONS_SQL = {
    "schema_version_not_2_or_3": "schema_version NOT IN (2, 3)",
    "warmup": "phase = 'warmup'",
    "timing_ineligible": "NOT timing_eligible",
    "status_not_success": "status <> 'success'",
    "process_not_successful": "NOT process_success",
    "scientific_not_successful": "NOT scientific_success",
    "correct_not_true": "correct IS NULL OR NOT correct",
    "project_not_clean": "project_git_dirty",
    "correctness_not_validated": "NOT correctness_validated",
    "validation_manifest_invalid": "NOT (validation_required AND validation_valid)",
    "input_changed_before_launch": "NOT unchanged_before_launch",
    "input_changed_after_run": "NOT unchanged_after_run",
    "input_rehash_error": "rehash_error IS NOT NULL",
    "host_monitor_incomplete": "NOT host_complete",
    "resource_samples_missing": "samples <= 0",
    "gpu_monitor_incomplete": "backend = 'gpu' AND NOT gpu_complete",
    "gpu_process_not_observed": "backend = 'gpu' AND NOT gpu_process_observed",
    "wall_time_invalid": "wall_time_s <= 0",
    "solver_time_invalid": "solver_time_s IS NULL OR solver_time_s < 0",
    "input_features_missing": "NOT has_features",
}
REASON_TEXT = "concat_ws(';', " + ", ".join(
    f"CASE WHEN {test} THEN '{name}' END" for name, test in REASONS_SQL.items()
) + ")"
CLASSIFIED = ROWS + f", classified AS (SELECT *, {REASON_TEXT} AS reasons FROM rows_)"


@register("f01_exclusion_reasons", duck(
    "SELECT trial_id, reasons AS exclusion_reasons, reasons = '' AS included FROM classified", CLASSIFIED))
def f01(spark, sf_dir):
    return T.classify(rows(spark, sf_dir)).select(
        "trial_id", F.concat_ws(";", "exclusion_reasons").alias("exclusion_reasons"), "included")


@register("a03_reason_histogram", duck(
    "SELECT reason, CAST(count(*) AS BIGINT) AS records FROM (SELECT unnest(string_split(reasons, ';')) AS reason"
    " FROM classified WHERE reasons <> '') GROUP BY reason", CLASSIFIED))
def a03(spark, sf_dir):
    return T.reason_counts(T.classify(rows(spark, sf_dir)))


@register("a04_record_counts", duck(
    "SELECT CAST(count(*) AS BIGINT) AS input_records, CAST(count(*) FILTER (reasons = '') AS BIGINT) AS included_records,"
    " CAST(count(*) FILTER (reasons <> '') AS BIGINT) AS excluded_records FROM classified", CLASSIFIED))
def a04(spark, sf_dir):
    return T.record_counts(T.classify(rows(spark, sf_dir)))


@register("a05_family_summaries", duck(
    "SELECT family_id, molecule, basis, CAST(count(*) AS BIGINT) AS input_records,"
    " CAST(count(*) FILTER (reasons = '') AS BIGINT) AS included_records,"
    " CAST(count(DISTINCT problem_instance) AS BIGINT) AS problem_instances FROM classified GROUP BY ALL", CLASSIFIED))
def a05(spark, sf_dir):
    return T.family_summary(T.classify(rows(spark, sf_dir)))


@register("a05_family_instances", duck(
    "SELECT DISTINCT family_id, problem_instance FROM classified", CLASSIFIED))
def a05_instances(spark, sf_dir):
    return T.family_instances(T.classify(rows(spark, sf_dir)))


def nested(df):
    """The nested record shape rebuilt from flat rows (missing parts stay NULL)."""
    return df.select(
        "trial_id", "logical_trial_id", "attempt_index", "schema_version", "timestamp_utc",
        F.col("timestamp_utc").alias("finished_timestamp_utc"), "hostname",
        F.col("phase").alias("warmup_or_measured"), "repetition", "problem_instance", "family_id",
        "molecule", "basis", "input_sha256", "backend", "cpu_threads", "wall_time_s", "solver_time_s",
        F.lit(None).cast("double").alias("initialization_time_s"),
        F.lit(None).cast("double").alias("matvec_time_s"), F.lit(None).cast("double").alias("transfer_time_s"),
        "peak_host_rss_mb", "peak_gpu_memory_mb", F.lit(None).cast("bigint").alias("iterations"),
        F.col("energy").alias("energy_or_eigenvalue"), "reference_value", "status", "correct", "timing_eligible",
        "process_success", "scientific_success", "project_git_dirty",
        F.struct(F.struct(F.col("candidate_name").alias("name")).alias("candidate")).alias("logical_identity"),
        F.struct("purpose", "correctness_validated").alias("protocol"),
        F.struct(F.col("validation_required").alias("required"), F.col("validation_valid").alias("valid"))
        .alias("validation_evidence"),
        F.struct("unchanged_before_launch", "unchanged_after_run", "rehash_error").alias("input_integrity"),
        F.struct("host_complete", "samples", "gpu_complete", "gpu_process_observed").alias("resource_monitoring"),
        F.when(F.col("has_features"), F.struct(
            F.struct(F.lit(36).cast("bigint").alias("n_orbitals")).alias("fcidump"),
            F.struct(F.sqrt("n_configurations").cast("bigint").alias("count")).alias("alpha"),
            F.struct(F.sqrt("n_configurations").cast("bigint").alias("count")).alias("beta"),
            "n_configurations", F.col("estimated_work").alias("method0_work_proxy"),
        )).alias("input_features"),
    )


@register("p01_flatten", duck("""
SELECT trial_id, phase, CAST(repetition AS INT) AS repetition, problem_instance, family_id, basis, candidate_name, backend,
 wall_time_s, solver_time_s, correct, purpose, validation_valid, rehash_error, samples,
 CASE WHEN has_features THEN n_configurations END AS n_configurations,
 CASE WHEN has_features THEN CAST(sqrt(n_configurations) AS BIGINT) END AS n_alpha_strings FROM rows_""", ROWS))
def p01(spark, sf_dir):
    return T.flatten_runs(nested(rows(spark, sf_dir))).select(
        "trial_id", "phase", F.col("repetition").cast("int").alias("repetition"), "problem_instance", "family_id",
        "basis", "candidate_name", "backend", "wall_time_s", "solver_time_s", "correct", "purpose",
        "validation_valid", "rehash_error", "samples", "n_configurations", "n_alpha_strings")


@register("p02_feature_projection", duck("""
SELECT trial_id, CASE WHEN has_features THEN CAST(n_configurations AS STRING) ELSE '' END AS n_configurations,
 CASE WHEN has_features THEN CAST(estimated_work AS STRING) ELSE '' END AS estimated_work,
 CASE WHEN has_features THEN '36' ELSE '' END AS n_orbitals FROM rows_""", ROWS))
def p02(spark, sf_dir):
    flat = T.flatten_runs(nested(rows(spark, sf_dir)))
    return flat.select("trial_id", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        for c in ("n_configurations", "estimated_work", "n_orbitals")])


def grouped(spark, sf_dir):
    return T.timing_groups(eligible_runs(spark, sf_dir))


GROUP_SQL = """, eligible AS (SELECT * FROM runs WHERE """ + ELIGIBLE + """),
groups AS (SELECT family_id, problem_instance, input_sha256, candidate_name, backend, cpu_threads, CAST(count(*) AS BIGINT) AS n,
 min(wall_time_s) AS wall_time_s_min, quantile_cont(wall_time_s, 0.25) AS wall_time_s_q1,
 quantile_cont(wall_time_s, 0.5) AS wall_time_s_median, quantile_cont(wall_time_s, 0.75) AS wall_time_s_q3,
 quantile_cont(wall_time_s, 0.75) - quantile_cont(wall_time_s, 0.25) AS wall_time_s_iqr, max(wall_time_s) AS wall_time_s_max,
 min(solver_time_s) AS solver_time_s_min, quantile_cont(solver_time_s, 0.25) AS solver_time_s_q1,
 quantile_cont(solver_time_s, 0.5) AS solver_time_s_median, quantile_cont(solver_time_s, 0.75) AS solver_time_s_q3,
 quantile_cont(solver_time_s, 0.75) - quantile_cont(solver_time_s, 0.25) AS solver_time_s_iqr, max(solver_time_s) AS solver_time_s_max
 FROM eligible GROUP BY ALL)"""
GROUPS = DUCK_RUNS + GROUP_SQL


def rounded(df, digits=8):
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


NUMBERS = [f"{v}_{s}" for v in ("wall_time_s", "solver_time_s") for s in ("min", "q1", "median", "q3", "iqr", "max")]
ROUND_GROUPS = "SELECT family_id, problem_instance, input_sha256, candidate_name, backend, cpu_threads, n, " + ", ".join(
    f"round({c}, 8) AS {c}" for c in NUMBERS) + " FROM groups"


@register("a02_candidate_groups", duck(ROUND_GROUPS, GROUPS))
def a02(spark, sf_dir):
    return rounded(grouped(spark, sf_dir))


@register("a02_group_members", duck("""
SELECT family_id, problem_instance, candidate_name, trial_id, CAST(row_number() OVER (PARTITION BY family_id, problem_instance,
 input_sha256, candidate_name, backend, cpu_threads ORDER BY timestamp_utc, trial_id) AS BIGINT) AS position FROM eligible""", GROUPS))
def a02_members(spark, sf_dir):
    return T.timing_members(eligible_runs(spark, sf_dir)).select(
        "family_id", "problem_instance", "candidate_name", "trial_id", "position")


@register("a01_summary", duck("""
SELECT family_id, backend, CAST(count(*) AS BIGINT) AS n, round(min(wall_time_s), 8) AS wall_time_s_min,
 round(quantile_cont(wall_time_s, 0.25), 8) AS wall_time_s_q1, round(quantile_cont(wall_time_s, 0.5), 8) AS wall_time_s_median,
 round(quantile_cont(wall_time_s, 0.75), 8) AS wall_time_s_q3,
 round(quantile_cont(wall_time_s, 0.75) - quantile_cont(wall_time_s, 0.25), 8) AS wall_time_s_iqr,
 round(max(wall_time_s), 8) AS wall_time_s_max FROM eligible GROUP BY ALL""", GROUPS))
def a01(spark, sf_dir):
    return rounded(T.summary(eligible_runs(spark, sf_dir), ["family_id", "backend"], ["wall_time_s"]))


@register("a01_rank_selected_quantiles", duck("""
SELECT backend, round(quantile_cont(wall_time_s, 0.25), 8) AS wall_time_s_p0, round(quantile_cont(wall_time_s, 0.5), 8) AS wall_time_s_p1,
 round(quantile_cont(wall_time_s, 0.9), 8) AS wall_time_s_p2 FROM eligible GROUP BY ALL""", GROUPS))
def a01_ranked(spark, sf_dir):
    from trialflow.functions.scaled import select_by_rank
    return rounded(select_by_rank(
        eligible_runs(spark, sf_dir), ["backend"], ["wall_time_s"], (0.25, 0.5, 0.9), null_keys=False))


ORACLE_SQL = GROUPS + """, oracle AS (SELECT g.*, min(wall_time_s_median) OVER (PARTITION BY family_id, problem_instance, input_sha256)
 AS minimum FROM groups g)"""


@register("a06_oracle", duck("""
SELECT family_id, problem_instance, candidate_name, round(minimum, 8) AS minimum FROM oracle WHERE wall_time_s_median = minimum""", ORACLE_SQL))
def a06(spark, sf_dir):
    best = T.best_per_workload(grouped(spark, sf_dir), "wall_time_s_median")
    return rounded(best.where("is_best").select("family_id", "problem_instance", "candidate_name", "minimum"))


RATIOS = {"median_wall_ratio": "wall_time_s_median", "median_solver_ratio": "solver_time_s_median"}


@register("j06_candidate_ratios", duck("""
SELECT l.family_id, l.problem_instance, l.candidate_name AS left_candidate, r.candidate_name AS right_candidate,
 round(l.wall_time_s_median / nullif(r.wall_time_s_median, 0), 8) AS median_wall_ratio,
 round(l.solver_time_s_median / nullif(r.solver_time_s_median, 0), 8) AS median_solver_ratio
FROM groups l JOIN groups r ON l.family_id = r.family_id AND l.problem_instance = r.problem_instance
 AND l.input_sha256 = r.input_sha256 AND l.candidate_name < r.candidate_name""", GROUPS))
def j06(spark, sf_dir):
    out = T.candidate_ratios(grouped(spark, sf_dir), ("cpu-16", "gpu-1"), RATIOS)
    return rounded(out.drop("input_sha256"))


@register("r01_crossover", duck("""
SELECT o.family_id, o.problem_instance, o.candidate_name, o.n, round(o.wall_time_s_q1, 8) AS wall_time_s_q1,
 round(o.wall_time_s_median, 8) AS wall_time_s_median, round(o.wall_time_s_q3, 8) AS wall_time_s_q3,
 o.wall_time_s_median = o.minimum AS is_best,
 round(c.wall_time_s_median / nullif(g.wall_time_s_median, 0), 8) AS cpu_over_gpu
FROM oracle o LEFT JOIN oracle c ON c.candidate_name = 'cpu-16' AND c.family_id = o.family_id AND c.problem_instance = o.problem_instance
 LEFT JOIN oracle g ON g.candidate_name = 'gpu-1' AND g.family_id = o.family_id AND g.problem_instance = o.problem_instance""", ORACLE_SQL))
def r01(spark, sf_dir):
    from trialflow.operators.reports import crossover
    out = crossover(grouped(spark, sf_dir), "cpu-16", "gpu-1")
    return rounded(out.select(
        "family_id", "problem_instance", "candidate_name", "n", "wall_time_s_q1", "wall_time_s_median",
        "wall_time_s_q3", "is_best", "cpu_over_gpu"))


@register("f04_balanced_view", duck(
    "SELECT trial_id FROM classified WHERE reasons = '' AND phase = 'measured' AND repetition IN (0, 1, 2)", CLASSIFIED))
def f04(spark, sf_dir):
    return T.balanced_view(T.classify(rows(spark, sf_dir))).select("trial_id")


@register("f05_purpose_filter", duck("SELECT trial_id, purpose FROM rows_ WHERE purpose = 'final'", ROWS))
def f05(spark, sf_dir):
    kept, _ = T.purpose_view(rows(spark, sf_dir))
    return kept.select("trial_id", "purpose")


@register("f05_purpose_violations", duck(
    "SELECT trial_id, 'unexpected_purpose' AS rule FROM rows_ WHERE purpose NOT IN ('final', 'pilot')", ROWS))
def f05_bad(spark, sf_dir):
    return T.purpose_view(rows(spark, sf_dir))[1]


ELIGIBLE_SQL = "status = 'success' AND correct AND timing_eligible AND phase = 'measured'"


@register("f06_eligible_gpu", duck(f"SELECT trial_id FROM rows_ WHERE {ELIGIBLE_SQL} AND backend = 'gpu'", ROWS))
def f06(spark, sf_dir):
    return T.eligible(rows(spark, sf_dir), "gpu").select("trial_id")


@register("f07_eligible_cpu", duck(f"SELECT trial_id FROM rows_ WHERE {ELIGIBLE_SQL} AND backend = 'cpu' AND cpu_threads > 0", ROWS))
def f07(spark, sf_dir):
    return T.eligible(rows(spark, sf_dir), "cpu").select("trial_id")


@register("f08_parity_filter", duck("""
SELECT trial_id FROM (SELECT *, CASE WHEN status = 'success' THEN abs(energy - reference_value) END AS relative_error FROM rows_)
WHERE status = 'success' AND correct AND energy IS NOT NULL AND reference_value IS NOT NULL AND relative_error IS NOT NULL""", ROWS))
def f08(spark, sf_dir):
    df = rows(spark, sf_dir).withColumn(
        "relative_error", F.when(F.col("status") == "success", F.abs(F.col("energy") - F.col("reference_value"))))
    return T.parity_view(df).select("trial_id")


@register("f15_named_views", duck("""
SELECT 'suffix_5' AS view, trial_id FROM rows_ WHERE problem_instance LIKE '%5'
UNION ALL SELECT 'headline', trial_id FROM rows_ WHERE problem_instance IN ('inst-7', 'inst-11')
UNION ALL SELECT 'balanced', trial_id FROM rows_ WHERE phase = 'measured' AND repetition <= 2""", ROWS))
def f15(spark, sf_dir):
    return T.named_views(rows(spark, sf_dir), {
        "suffix_5": F.col("problem_instance").endswith("5"),
        "headline": F.col("problem_instance").isin("inst-7", "inst-11"),
        "balanced": (F.col("phase") == "measured") & (F.col("repetition") <= 2),
    })


@register("a20_eligibility_funnel", duck(f"""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (status = 'success' AND correct) AS BIGINT) AS success_correct,
 CAST(count(*) FILTER ({ELIGIBLE_SQL}) AS BIGINT) AS measured_eligible FROM rows_""", ROWS))
def a20(spark, sf_dir):
    return T.funnel(rows(spark, sf_dir))


@register("a19_thread_scaling", duck(f"""
SELECT problem_instance, family_id, n_configurations, pilot_threads AS cpu_threads, CAST(count(*) AS BIGINT) AS n,
 round(quantile_cont(wall_time_s, 0.5), 8) AS wall_time_s_median, round(quantile_cont(solver_time_s, 0.5), 8) AS solver_time_s_median
FROM rows_ WHERE {ELIGIBLE_SQL} AND backend = 'cpu' AND problem_instance IN (SELECT problem_instance FROM rows_
 WHERE {ELIGIBLE_SQL} AND backend = 'cpu' GROUP BY 1 HAVING count(DISTINCT pilot_threads) >= 2) GROUP BY ALL""", ROWS))
def a19(spark, sf_dir):
    df = T.eligible(rows(spark, sf_dir), "cpu").withColumn("cpu_threads", F.col("pilot_threads"))
    return rounded(T.thread_scaling(df).select(
        "problem_instance", "family_id", "n_configurations", "cpu_threads", "n", "wall_time_s_median",
        "solver_time_s_median"))


@register("a21_memory_headroom", duck(f"""
SELECT problem_instance, n_configurations, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(peak_gpu_memory_mb, 0.5), 8) AS peak_median,
 max(peak_gpu_memory_mb) AS peak_max, max(CAST(640 * 1048576 AS BIGINT) / 1048576e0) AS guard_mib, TRUE AS guard_constant,
 min((20480 - peak_host_rss_mb)) AS minimum_cap_mib FROM rows_ WHERE {ELIGIBLE_SQL} AND backend = 'gpu' GROUP BY ALL""", ROWS))
def a21(spark, sf_dir):
    df = T.eligible(rows(spark, sf_dir), "gpu").select(
        "problem_instance", "n_configurations", "peak_gpu_memory_mb",
        mib(F.lit(640 * 1048576)).alias("guard_mib"), (F.lit(20480.0) - F.col("peak_host_rss_mb")).alias("cap_mib"))
    return rounded(T.headroom(df).select(
        "problem_instance", "n_configurations", "n", F.col("peak_gpu_memory_mb_median").alias("peak_median"),
        F.col("peak_gpu_memory_mb_max").alias("peak_max"), "guard_mib", "guard_constant", "minimum_cap_mib"))


@register("r02_memory_guard", duck(f"""
SELECT trial_id, problem_instance, n_configurations, CAST(repetition AS INT) AS repetition, peak_gpu_memory_mb AS peak_gpu_memory_mib,
 640e0 AS guard_mib, 20480 - peak_host_rss_mb AS cap_mib, 640e0 <= 20480 - peak_host_rss_mb AS admitted
FROM rows_ WHERE {ELIGIBLE_SQL} AND backend = 'gpu'""", ROWS))
def r02(spark, sf_dir):
    from trialflow.operators.reports import memory_guard
    df = rows(spark, sf_dir).withColumn("guard_bytes", F.lit(640 * 1048576).cast("bigint")).withColumn(
        "cap_bytes", ((F.lit(20480.0) - F.col("peak_host_rss_mb")) * 1048576).cast("bigint"))
    return memory_guard(df).withColumn("repetition", F.col("repetition").cast("int"))


@register("w01_competition_rank", duck("""
SELECT problem_instance, candidate_name, CAST(rank() OVER (PARTITION BY family_id, problem_instance ORDER BY wall_time_s_median) AS BIGINT) AS wall_rank,
 CAST(rank() OVER (PARTITION BY family_id, problem_instance ORDER BY solver_time_s_median) AS BIGINT) AS solver_rank FROM groups""", GROUPS))
def w01(spark, sf_dir):
    df = grouped(spark, sf_dir).select(
        "family_id", "problem_instance", "candidate_name", F.col("wall_time_s_median").alias("wall_time_s"),
        F.col("solver_time_s_median").alias("solver_time_s"))
    return T.rank_candidates(df, ("wall_time_s", "solver_time_s"), ("family_id", "problem_instance")).select(
        "problem_instance", "candidate_name", "wall_rank", "solver_rank")


@register("w02_ratio_to_best", duck("""
SELECT problem_instance, candidate_name, round(wall_time_s_median / minimum, 8) AS wall_over_best,
 wall_time_s_median = minimum AS wall_winner FROM oracle""", ORACLE_SQL))
def w02(spark, sf_dir):
    df = grouped(spark, sf_dir).select(
        "family_id", "problem_instance", "candidate_name", F.col("wall_time_s_median").alias("wall_time_s"))
    return rounded(T.rank_candidates(df, ("wall_time_s",), ("family_id", "problem_instance")).select(
        "problem_instance", "candidate_name", "wall_over_best", "wall_winner"))


@register("w03_winner_flips", duck("""
SELECT family_id, lower_size, upper_size, lower_instance, upper_instance, lower_winner, upper_winner FROM (
 SELECT family_id, n_configurations AS upper_size, problem_instance AS upper_instance, winner AS upper_winner,
  lag(n_configurations) OVER w AS lower_size, lag(problem_instance) OVER w AS lower_instance, lag(winner) OVER w AS lower_winner
 FROM (SELECT o.family_id, o.problem_instance, e.n_configurations, min(o.candidate_name) AS winner FROM oracle o
   JOIN (SELECT DISTINCT problem_instance, n_configurations FROM eligible) e USING (problem_instance)
   WHERE wall_time_s_median = minimum GROUP BY ALL)
 WINDOW w AS (PARTITION BY family_id ORDER BY n_configurations, problem_instance)) WHERE lower_winner <> upper_winner""", ORACLE_SQL))
def w03(spark, sf_dir):
    df = eligible_runs(spark, sf_dir)
    keys = ("family_id", "problem_instance", "input_sha256", "n_configurations")
    groups = T.timing_groups(df, (*keys, "candidate_name"))
    best = T.best_per_workload(groups, "wall_time_s_median", keys).where("is_best")
    winners = materialized(best.groupBy(*keys).agg(F.min("candidate_name").alias("winner")))
    return T.winner_flips(winners, ("family_id",), "n_configurations", "problem_instance", "winner")
