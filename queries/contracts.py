"""Contracts over nested records, calibration, attestation, sinks, streams."""

from pyspark.sql import functions as F

from queries.audit import PLAN_KEYS, PLAN_SQL, accepted, cells, done, plan, planned, SCREENED
from queries.base import DUCK_ACCEPTED, DUCK_RUNS, duck, load, parts, pieces, register, runs
from queries.policy import BALANCED_CTE, balanced
from queries.timing import CLASSIFIED, ROWS, rounded, rows
from trialflow.functions.stats import relative_error
from trialflow.operators import audit, contracts, reports
from trialflow.operators import timing as T
from trialflow.operators.rules import check, needs
from trialflow.operators.screen import FACTORS, paired_effects
from trialflow.session import shared_folder
from trialflow.sources import tables
from trialflow.sources.records import conform
from trialflow.sources.samples import trial_peaks  # noqa: F401
from trialflow.streaming import ingest

FILES = "array(named_struct('role', 'alpha', 'path', 'a', 'sha256', input_sha256, 'size_bytes', 1L))"
#: a record that meets every contract, as SQL over the flat run rows
SOUND = {
    "run_key": "trial_id", "trial_id": "sha2(trial_id, 256)", "logical_trial_id": "logical_trial_id", "attempt_index": "0L",
    "schema_version": "3L", "timestamp_utc": "timestamp_utc", "finished_timestamp_utc": "timestamp_utc", "problem_family": "'sweep'",
    "problem_instance": "problem_instance", "family_id": "family_id", "molecule": "molecule", "basis": "'sto-3g'", "input_sha256": "input_sha256",
    "project_git_dirty": "false", "upstream_url": "'https://example.org/solver'", "upstream_git_commit": "'c0ffee'", "official_upstream_primary": "true",
    "n_configurations": "n_configurations", "estimated_work": "estimated_work", "n_orbitals": "2L", "backend": "backend",
    "cpu_threads": "CAST(cpu_threads AS BIGINT)", "mpi_ranks": "1L", "warmup_or_measured": "phase", "repetition": "CAST(repetition AS BIGINT)",
    "command": "array('run')", "wall_time_s": "1.0D", "solver_time_s": "0.5D", "iterations": "3L", "energy_or_eigenvalue": "-1.5D",
    "timeout": "false", "oom": "false", "exit_code": "0L", "status": "'success'", "process_success": "true", "scientific_success": "true",
    "correct": "true", "timing_eligible": "phase = 'measured'", "notes": "CAST(array() AS ARRAY<STRING>)", "input_files": FILES,
    "environment_overrides": "map('OMP_TARGET_OFFLOAD', CASE backend WHEN 'cpu' THEN 'DISABLED' ELSE 'MANDATORY' END, 'CUDA_VISIBLE_DEVICES', '0')",
    "peak_gpu_memory_mb": "CASE backend WHEN 'gpu' THEN 100.0D END",
    "logical_identity": "named_struct('schema_version', 3L, 'sweep_name', 'sweep', 'workload', problem_instance, 'input_sha256', input_sha256, 'upstream_commit', 'c0ffee',"
    " 'family_id', family_id, 'molecule', molecule, 'basis', 'sto-3g', 'candidate', named_struct('name', candidate_name, 'backend', backend, 'threads', CAST(cpu_threads AS BIGINT),"
    " 'mpi_ranks', 1L, 'build_id', 'b', 'artifact_sha256', sha2(backend, 256)))",
    "input_features": "named_struct('combined_input_sha256', input_sha256, 'n_configurations', n_configurations, 'method0_work_proxy', estimated_work)",
    "input_integrity": f"named_struct('initial', {FILES}, 'before_launch', {FILES}, 'after_run', {FILES})",
    "validation_evidence": "named_struct('required', true, 'valid', true, 'errors', CAST(array() AS ARRAY<STRING>))",
    "resource_monitoring": "named_struct('samples', 5L, 'host_complete', true, 'gpu_complete', backend = 'gpu', 'gpu_process_observed', backend = 'gpu')",
    "protocol": "named_struct('purpose', 'final', 'warmups', 1L, 'repetitions', 3L, 'correctness_validated', true)",
    "preflight": "named_struct('gpu', named_struct('index', 0L), 'gpu_idle', true, 'gpu_process_query_ok', true, 'gpu_memory_cap_bytes', 100L, 'host_memory_cap_bytes', 100L)",
    "source_memory_estimate": "named_struct('host_guard_bytes', 50L, 'gpu_host_guard_bytes', 60L, 'gpu_guard_bytes', 70L)",
    "upstream_output": "named_struct('converged', true, 'density', array(0.5D, 1.5D), 'energy', -1.5D, 'final_residual', 1e-9D, 'iteration_records', 3L, 'device_assignment_seen', backend = 'gpu')",
    "physical_cores": "16L",
}


def records(spark, sf_dir, changes=None, extra=(), of=None, beside=None, flat=None):
    """One record per run, or per run whose ``trial_id`` is in ``of``: others are dropped while rows are narrow.

    ``flat`` are the run rows, if they are not those of the given tables.

    ``beside(runs)`` joins what ``extra`` names, also while rows are narrow.
    """
    texts = SOUND | (changes or {})
    flat = runs(spark, sf_dir) if flat is None else flat
    if beside is not None:
        flat = beside(flat)
    if of is not None:
        flat = flat.join(of, "trial_id", "left_semi")
    return flat.selectExpr(*[f"{text} AS {name}" for name, text in texts.items()], *extra)


def broken(*findings):
    """Oracle: one SELECT per expected (condition, rule)."""
    return duck(" UNION ALL ".join(
        f"SELECT trial_id AS run_key, '{name}' AS rule FROM runs WHERE {test}" for test, name in findings), DUCK_RUNS)


@register("f03_record_contract", broken(
    ("samples = 5", "timeout_disagrees"), ("samples = 6 AND phase = 'warmup'", "eligible_without_success"), ("samples = 7", "family_id_not_slug"),
    ("samples = 7", "family_id_identity_differs"), ("samples = 8", "status_unknown"), ("samples = 9", "repetition_negative"), ("samples = 10", "wall_time_s_not_finite"),
    ("samples = 11", "command_empty"), *[("samples = 12", r) for r in (
        "logical_identity_missing", "family_id_identity_differs", "molecule_identity_differs", "basis_identity_differs", "identity_version_differs",
        "identity_workload_differs", "identity_sweep_differs")], ("samples = 13", "trial_id_not_digest"), ("samples = 14", "basis_not_trimmed_text"), ("samples = 14", "basis_identity_differs")))
def f03(spark, sf_dir):
    df = records(spark, sf_dir, {
        "timeout": "samples = 5", "process_success": "NOT (samples = 5 OR (samples = 6 AND phase = 'warmup'))",
        "exit_code": "CASE WHEN samples = 6 AND phase = 'warmup' THEN 1L ELSE 0L END",
        "timing_eligible": "phase = 'measured' AND samples <> 8 OR samples = 6",
        "status": "CASE WHEN samples = 8 THEN 'odd' WHEN samples = 6 AND phase = 'warmup' THEN 'failed' ELSE 'success' END",
        "family_id": "CASE WHEN samples = 7 THEN 'Fam_X' ELSE family_id END", "repetition": "CASE WHEN samples = 9 THEN -1L ELSE CAST(repetition AS BIGINT) END",
        "wall_time_s": "CASE WHEN samples = 10 THEN double('NaN') ELSE 1.0D END", "command": "CASE WHEN samples = 11 THEN CAST(array() AS ARRAY<STRING>) ELSE array('run') END",
        "logical_identity": f"CASE WHEN samples <> 12 THEN {SOUND['logical_identity']} END", "trial_id": "CASE WHEN samples = 13 THEN 'x' ELSE sha2(trial_id, 256) END",
        "basis": "CASE WHEN samples = 14 THEN ' sto-3g' ELSE 'sto-3g' END"})
    from trialflow.schemas import RECORD
    have = set(df.columns)
    wide = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in RECORD.fields if f.name not in have])
    return check(wide, contracts.record_rules(), ["run_key"])


@register("f02_timing_shape", broken(
    ("samples = 5", "input_sha256_invalid"), ("samples = 5", "feature_hash_differs"), ("samples = 6", "candidate_backend_differs"),
    *[("samples = 7", r) for r in ("features_missing", "feature_hash_differs", "feature_size_differs", "feature_work_differs")],
    ("samples = 8", "wall_time_s_invalid"), ("samples = 9", "schema_version_not_2_or_3"), ("samples = 10", "protocol_missing")))
def f02(spark, sf_dir):
    identity = SOUND["logical_identity"].replace("'backend', backend", "'backend', CASE WHEN samples = 6 THEN 'mock' ELSE backend END")
    return check(records(spark, sf_dir, {
        "input_sha256": "CASE WHEN samples = 5 THEN 'zz' ELSE input_sha256 END", "logical_identity": identity,
        "input_features": f"CASE WHEN samples <> 7 THEN {SOUND['input_features']} END", "wall_time_s": "CASE WHEN samples = 8 THEN -1.0D ELSE 1.0D END",
        "schema_version": "CASE WHEN samples = 9 THEN 1L ELSE 3L END", "protocol": f"CASE WHEN samples <> 10 THEN {SOUND['protocol']} END",
    }), contracts.timing_shape_rules(), ["run_key"])


@register("f09_calibration_gate", broken(
    ("samples = 5", "residual_out_of_bounds"), ("samples = 6", "energy_differs"), ("samples = 7", "density_length_differs"),
    ("samples = 8 AND backend = 'cpu'", "cpu_offload_not_disabled"), ("samples = 8 AND backend = 'gpu'", "gpu_offload_not_mandatory"),
    ("samples = 9 AND backend = 'gpu'", "gpu_device_differs"), ("samples = 10", "purpose_not_correctness"), ("samples = 11", "reference_check_failed"),
    ("samples = 12 AND backend = 'gpu'", "gpu_memory_not_observed"), ("samples = 13", "upstream_commit_differs")))
def f09(spark, sf_dir):
    out = (SOUND["upstream_output"].replace("1e-9D", "CASE WHEN samples = 5 THEN 1e-2D ELSE 1e-9D END")
           .replace("'energy', -1.5D", "'energy', CASE WHEN samples = 6 THEN -1.25D ELSE -1.5D END")
           .replace("array(0.5D, 1.5D)", "CASE WHEN samples = 7 THEN array(0.5D) ELSE array(0.5D, 1.5D) END"))
    env = SOUND["environment_overrides"].replace("CASE backend", "CASE WHEN samples = 8 THEN 'ON' ELSE CASE backend").replace("'MANDATORY' END", "'MANDATORY' END END").replace(
        "'CUDA_VISIBLE_DEVICES', '0'", "'CUDA_VISIBLE_DEVICES', CASE WHEN samples = 9 THEN ' 1' ELSE ' 0 ' END")
    return check(records(spark, sf_dir, {
        "upstream_output": out, "environment_overrides": env, "timing_eligible": "false", "correct": "CASE WHEN samples = 11 THEN false END",
        "protocol": SOUND["protocol"].replace("'final'", "CASE WHEN samples = 10 THEN 'final' ELSE 'correctness' END"),
        "peak_gpu_memory_mb": "CASE WHEN backend = 'gpu' THEN CASE WHEN samples = 12 THEN 0.0D ELSE 100.0D END END",
        "upstream_git_commit": "CASE WHEN samples = 13 THEN 'beef' ELSE 'c0ffee' END",
    }), contracts.calibration_rules(1e-6, "https://example.org/solver", "c0ffee"), ["run_key"])


@register("f10_screen_gates", broken(
    ("samples = 5", "purpose_not_pilot"), ("samples = 6", "evidence_has_errors"), ("samples = 7 AND phase = 'warmup'", "eligibility_differs_from_phase"),
    ("samples = 8", "correct_failed"), ("samples = 9", "protocol_geometry_differs"), ("samples = 10", "project_not_clean")))
def f10(spark, sf_dir):
    protocol = SOUND["protocol"].replace("'final'", "CASE WHEN samples = 5 THEN 'final' ELSE 'pilot' END").replace("3L", "CASE WHEN samples = 9 THEN 2L ELSE 1L END")
    return check(records(spark, sf_dir, {
        "protocol": protocol, "validation_evidence": SOUND["validation_evidence"].replace("CAST(array() AS ARRAY<STRING>)", "CASE WHEN samples = 6 THEN array('e') ELSE CAST(array() AS ARRAY<STRING>) END"),
        "timing_eligible": "phase = 'measured' OR samples = 7", "correct": "CASE WHEN samples <> 8 THEN true END", "project_git_dirty": "CASE WHEN samples <> 10 THEN false END",
    }), contracts.screen_rules(), ["run_key"])


@register("f11_campaign_gate", broken(
    ("samples = 5 AND candidate_name = 'cpu-16'", "candidate_threads_differ"), ("samples = 5 AND candidate_name = 'cpu-16'", "threads_differ"), ("samples = 6", "host_guard_over_cap"), ("samples = 7", "input_changed"),
    ("samples = 8 AND backend = 'gpu'", "gpu_monitor_incomplete"), ("samples = 9", "gpu_not_idle"), ("samples = 10", "not_first_attempt"),
    ("basis IS NULL AND samples = 11", "basis_differs"), ("samples = 12", "status_not_success")))
def f11(spark, sf_dir):
    threads = "CASE WHEN samples = 5 AND candidate_name = 'cpu-16' THEN 8L ELSE CAST(cpu_threads AS BIGINT) END"
    plan_rows = pieces(spark, sf_dir, "part", "p_partkey", piece=1 << 18).selectExpr(
        "concat('inst-', CAST(p_partkey AS STRING)) AS problem_instance", "concat('fam-', CAST(p_partkey % 25 AS STRING)) AS plan_family_id",
        "concat('mol-', CAST(p_partkey % 25 AS STRING)) AS plan_molecule", "'sto-3g' AS plan_basis", "'sweep' AS plan_campaign", "1L AS plan_warmups", "3L AS plan_repetitions",
        "1L AS plan_mpi_ranks", "explode(array(named_struct('c', 'cpu-16', 'b', 'cpu', 't', 16L), named_struct('c', 'gpu-1', 'b', 'gpu', 't', 1L))) AS x",
    ).selectExpr("*", "x.c AS candidate_name", "x.b AS plan_backend", "x.t AS plan_threads", "sha2(x.b, 256) AS plan_artifact_sha256").drop("x")
    keys = ["problem_instance", "candidate_name"]

    def beside(flat):
        """Runs sorted and merged with their plan rows in parts of about 4 MB of the table; a broadcast plan would be whole in every task."""
        n = parts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
        return flat.repartition(n, *keys).join(plan_rows.repartition(n, *keys).hint("merge"), keys)

    df = records(spark, sf_dir, {
        "candidate_name": "candidate_name", "cpu_threads": threads, "logical_identity": SOUND["logical_identity"].replace("'threads', CAST(cpu_threads AS BIGINT)", f"'threads', {threads}"),
        "source_memory_estimate": SOUND["source_memory_estimate"].replace("50L", "CASE WHEN samples = 6 THEN 500L ELSE 50L END"),
        "input_integrity": SOUND["input_integrity"].replace(f"'after_run', {FILES}", f"'after_run', CASE WHEN samples = 7 THEN {FILES.replace('1L', '2L')} ELSE {FILES} END"),
        "resource_monitoring": SOUND["resource_monitoring"].replace("'gpu_complete', backend = 'gpu'", "'gpu_complete', backend = 'gpu' AND samples <> 8"),
        "preflight": SOUND["preflight"].replace("'gpu_idle', true", "'gpu_idle', samples <> 9"), "attempt_index": "CASE WHEN samples = 10 THEN 1L ELSE 0L END",
        "basis": "CASE WHEN basis IS NULL AND samples = 11 THEN 'other' ELSE 'sto-3g' END", "status": "CASE WHEN samples = 12 THEN 'failed' ELSE 'success' END"}, extra=[c for c in plan_rows.columns if c.startswith("plan_")], beside=beside)
    return check(df, contracts.campaign_rules(), ["run_key"])


@register("f20_registry_contract", duck("""
SELECT p_partkey, 'entry_id_differs' AS rule FROM part WHERE p_partkey % 19 = 0 UNION ALL SELECT p_partkey, 'basis_status_differs' FROM part WHERE p_partkey % 23 = 0
UNION ALL SELECT p_partkey, 'member_count_differs' FROM part WHERE p_partkey % 29 = 0 UNION ALL SELECT p_partkey, 'n_configurations_not_positive' FROM part WHERE p_size = 1"""))
def f20(spark, sf_dir):
    df = load(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand AS family_id", "p_name AS problem_instance", "sha2(p_name, 256) AS input_sha256", "CAST(p_size - 1 AS BIGINT) AS n_configurations",
        "CAST(NULL AS STRING) AS basis", "CASE WHEN p_partkey % 23 = 0 THEN 'reported' ELSE 'upstream_not_reported' END AS basis_status",
        "CASE WHEN p_partkey % 29 = 0 THEN 4 ELSE 3 END AS source_record_count", "3 AS members",
        "CASE WHEN p_partkey % 19 = 0 THEN 'x' ELSE sha2(concat_ws(chr(0), p_brand, p_name, sha2(p_name, 256)), 256) END AS entry_id")
    return check(df, contracts.registry_rules(), ["p_partkey"])


@register("f21_typed_reload", duck("""
SELECT o_orderkey, 'share_not_a_fraction' AS rule FROM orders WHERE o_orderkey % 10 = 3 OR o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'price_not_positive' FROM orders WHERE o_orderkey % 17 = 0
UNION ALL SELECT o_orderkey, 'ids_not_distinct_digests' FROM orders WHERE o_orderkey % 13 = 0"""))
def f21(spark, sf_dir):
    text = load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 10 = 3 THEN 'n/a' ELSE CAST(o_totalprice / 400000 AS STRING) END AS share",
        "CASE WHEN o_orderkey % 17 = 0 THEN '-1' ELSE CAST(o_totalprice AS STRING) END AS price",
        "to_json(array(sha2(o_orderpriority, 256), CASE WHEN o_orderkey % 13 = 0 THEN sha2(o_orderpriority, 256) ELSE sha2('x', 256) END)) AS ids")
    typed = tables.typed_text(text, {"share": "double", "price": "double"}).withColumn("ids", F.from_json("ids", "array<string>"))
    return check(typed, tables.range_rules(fractions=["share"], positives=["price"], digests=["ids"]), ["o_orderkey"])


@register("f22_screen_output", duck("""
SELECT m.family_id, m.problem_instance, unnest(list_filter([CASE WHEN n <> 8 THEN 'measurement_count' END, CASE WHEN coalesce(e, 0) <> 12 THEN 'effect_count' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT family_id, problem_instance, count(*) AS n FROM cells GROUP BY ALL) m LEFT JOIN (SELECT family_id, problem_instance, count(*) AS e FROM effects GROUP BY ALL) x
 ON x.family_id = m.family_id AND x.problem_instance = m.problem_instance""", SCREENED))
def f22(spark, sf_dir):
    df = cells(spark, sf_dir)
    return contracts.screen_output_violations(paired_effects(df), df, FACTORS)


@register("r04_parity_table", duck("""
SELECT trial_id, family_id, backend, round(abs(energy - reference_value) / greatest(abs(reference_value), 1e-300) * 1e9, 4) AS error_ppb FROM runs WHERE status = 'success' AND correct""", DUCK_RUNS))
def r04(spark, sf_dir):
    df = runs(spark, sf_dir).withColumn("relative_error", relative_error(F.col("energy"), F.col("reference_value"), "reference"))
    return reports.parity(T.parity_view(df)).select("trial_id", "family_id", "backend", F.round(F.col("relative_error") * 1e9, 4).alias("error_ppb"))


def attested(spark, sf_dir):
    df = runs(spark, sf_dir).withColumn("started", F.col("started").cast("timestamp")).withColumn(
        "finished", F.timestamp_micros(F.unix_micros("started") + F.round(F.col("wall_time_s") * 1e6).cast("bigint"))).withColumn(
        "repetition", F.col("repetition").cast("bigint"))
    views = {"balanced": (F.col("phase") == "measured") & (F.col("repetition") <= 2), "big": F.col("n_configurations") >= 900}
    return reports.attest(
        planned(spark, sf_dir), df, PLAN_KEYS, views, [needs("status_not_success", F.col("status") == "success"), needs("not_clean", ~F.col("project_git_dirty"))],
        ("phase", "backend", "family_id"), ("trial_id", "input_sha256"), 1.734376528)


@register("r08_attestation_counts", duck("""
SELECT 'phase' AS dimension, phase AS value, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY ALL UNION ALL SELECT 'backend', backend, count(*) FROM runs GROUP BY ALL UNION ALL SELECT 'family_id', family_id, count(*) FROM runs GROUP BY ALL
UNION ALL SELECT 'view', 'balanced', count(*) FROM runs WHERE phase = 'measured' AND repetition <= 2 UNION ALL SELECT 'view', 'big', count(*) FROM runs WHERE n_configurations >= 900""", DUCK_RUNS))
def r08(spark, sf_dir):
    made = attested(spark, sf_dir)
    return made["counts"].unionByName(made["view_sizes"].select(F.lit("view").alias("dimension"), F.col("view").alias("value"), F.col("records").alias("n")))


@register("r08_attestation_gate", duck("""
SELECT 'completeness' AS gate, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT p.n AS p, a.n AS a FROM (SELECT workload AS problem_instance, candidate AS candidate_name, phase, repetition, count(*) AS n FROM plan GROUP BY ALL) p
  FULL JOIN (SELECT problem_instance, candidate_name, phase, CAST(repetition AS BIGINT) AS repetition, count(*) AS n FROM runs GROUP BY ALL) a USING (problem_instance, candidate_name, phase, repetition)) WHERE p IS NULL OR a IS NULL OR a > 1) AS findings
UNION ALL SELECT 'violations', (SELECT CAST(count(*) FILTER (status <> 'success') + count(*) FILTER (project_git_dirty) AS BIGINT) FROM runs)
UNION ALL SELECT 'overlaps', (SELECT CAST(count(*) AS BIGINT) FROM (SELECT started, max(started + to_microseconds(CAST(round(wall_time_s * 1e6) AS BIGINT))) OVER (PARTITION BY hostname ORDER BY started, trial_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM runs) WHERE started < earlier)""", PLAN_SQL, DUCK_RUNS))
def r08_gate(spark, sf_dir):
    made = attested(spark, sf_dir)
    return reports.attestation_findings(made)


@register("r09_calibration_manifest", duck("""
SELECT family_id, problem_instance, repetition, round(abs(c - g) / greatest(abs(c), abs(g)) * 1e9, 5) AS energy_error_ppb, round(greatest(abs(cw - gw), abs(cs - gs)), 8) AS density_linf FROM (
 SELECT family_id, problem_instance, repetition, max(energy) FILTER (backend = 'cpu') AS c, max(energy) FILTER (backend = 'gpu') AS g, max(wall_time_s) FILTER (backend = 'cpu') AS cw, max(wall_time_s) FILTER (backend = 'gpu') AS gw,
  max(solver_time_s) FILTER (backend = 'cpu') AS cs, max(solver_time_s) FILTER (backend = 'gpu') AS gs, count(*) AS n FROM accepted GROUP BY ALL)
WHERE n = 2 AND abs(c - g) / greatest(abs(c), abs(g)) <= 5e-12 AND greatest(abs(cw - gw), abs(cs - gs)) <= 20""", DUCK_ACCEPTED))
def r09(spark, sf_dir):
    df = accepted(spark, sf_dir).withColumn("density", F.array("wall_time_s", "solver_time_s"))
    good, _ = audit.backend_pairs(df, ["family_id", "problem_instance", "repetition"], ["energy", "density"])
    agreed, _ = audit.calibrate(good, 5e-12, 20.0)
    return agreed.select("family_id", "problem_instance", "repetition", F.round(F.col("energy_relative_error") * 1e9, 5).alias("energy_error_ppb"),
                         F.round("density_linf", 8).alias("density_linf"))


# -- sinks: written, read back, compared ----------------------------------------


def scratch(spark, name):
    import uuid
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("s10_timing_csv", duck("""
SELECT trial_id, CASE WHEN reasons = '' THEN 'true' ELSE 'false' END AS included, CASE WHEN reasons <> '' THEN reasons END AS exclusion_reasons, basis, candidate_name FROM classified""", CLASSIFIED))
def s10(spark, sf_dir):
    path = scratch(spark, "timing-csv")
    tables.write_csv(tables.timing_csv_rows(T.classify(rows(spark, sf_dir))), path, "gzip")
    return spark.read.option("header", True).option("escape", '"').csv(path).select(
        "trial_id", "included", "exclusion_reasons", "basis", "candidate_name")


@register("s11_result_csv", duck("""
SELECT problem_instance, candidate_name, '["' || replace(source_record_ids, ',', '","') || '"]' AS source_record_ids FROM balanced""", BALANCED_CTE))
def s11(spark, sf_dir):
    path = scratch(spark, "result-csv")
    tables.write_csv(tables.json_cells(balanced(spark, sf_dir).select("problem_instance", "candidate_name", "source_record_ids")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


# -- streams over events ----------------------------------------------------------

EVENT = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark, sf_dir):
    return spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@register("t01_incremental_ingest", duck("SELECT event_id AS trial_id, event_type, value FROM events WHERE value > 5"))
def t01(spark, sf_dir):
    """Every record arrives twice; one copy is stored, unsound ones are kept out."""
    once = event_stream(spark, sf_dir)
    twice = once.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.col("event_id").alias("trial_id"), F.col("ts").alias("started"), "event_type", "value")
    table = scratch(spark, "ingest")
    query = ingest.ingest_stream(
        twice, f"{table}/rows", f"{table}/checkpoint", watermark="60 days", rules=[needs("value_too_small", F.col("value") > 5)],
        violations=f"{table}/violations")
    query.awaitTermination()
    return spark.read.parquet(f"{table}/rows").select("trial_id", "event_type", "value")


@register("t01_ingest_batch", duck("SELECT event_id AS trial_id, event_type, value FROM events WHERE value > 5"))
def t01_batch(spark, sf_dir):
    both = load(spark, sf_dir, "events").select(F.col("event_id").alias("trial_id"), "event_type", "value", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    return ingest.ingest_batch(both, rules=[needs("value_too_small", F.col("value") > 5)])


PEAKS = """SELECT 'trial-' || user_id AS trial_id, @TS[time_bucket(INTERVAL 1 HOUR, ts)] AS window_start, CAST(count(*) AS BIGINT) AS samples, max(value) AS peak_host_rss_mib,
 max(CASE WHEN event_type <> 'error' THEN value * 2 END) AS peak_gpu_memory_mib FROM events GROUP BY ALL"""


def sampled(df):
    return df.select(
        F.concat(F.lit("trial-"), F.col("user_id").cast("string")).alias("trial_id"), "ts", F.col("value").alias("host_rss_mib"),
        F.when(F.col("event_type") != "error", F.col("value") * 2).alias("gpu_memory_mib"))


def stamped(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("t02_live_peaks", duck(PEAKS))
def t02(spark, sf_dir):
    table = scratch(spark, "peaks")
    query = ingest.stream_peaks(sampled(event_stream(spark, sf_dir)), f"{table}/rows", f"{table}/checkpoint")
    query.awaitTermination()
    return stamped(ingest.latest_peaks(spark.read.parquet(f"{table}/rows")))


@register("t02_peaks_batch", duck(PEAKS))
def t02_batch(spark, sf_dir):
    return stamped(ingest.window_peaks(sampled(load(spark, sf_dir, "events"))))


@register("t02_trial_sessions", duck("""
SELECT trial_id, @TS[min(ts)] AS session_start, CAST(count(*) AS BIGINT) AS samples, max(value) AS peak_host_rss_mib FROM (
 SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY trial_id ORDER BY ts, event_id) AS s
 FROM (SELECT *, 'trial-' || user_id AS trial_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY trial_id, s"""))
def t02_sessions(spark, sf_dir):
    out = ingest.trial_sessions(sampled(load(spark, sf_dir, "events")))
    return out.select("trial_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "samples", "peak_host_rss_mib")
