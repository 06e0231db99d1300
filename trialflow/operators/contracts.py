"""The contracts of records, calibrations, screens and campaigns as rule lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.functions.identity import canonical_id_udf, is_digest, same_inputs
from trialflow.functions.stats import finite, is_false, is_true
from trialflow.operators.rules import Rule, needs, rule
from trialflow.schemas import BACKENDS, PHASES, STATUSES

# fixed value: pattern of family identifiers
SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"


def _text(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def _trimmed(value: Column) -> Column:
    return _text(value) & (value == F.trim(value))


def _if(when: Column, holds: Column) -> Column:
    """Implication: a rule that only applies under ``when``."""
    return ~F.coalesce(when, F.lit(False)) | F.coalesce(holds, F.lit(False))


def record_rules() -> list[Rule]:
    """Contract of one nested record, all versions."""
    c = F.col
    v3 = c("schema_version") == 3
    v2 = c("schema_version").isin(2, 3)
    success = c("status") == "success"
    rules = [
        needs("schema_version_unsupported", c("schema_version").isin(1, 2, 3)),
        needs("trial_id_not_digest", is_digest(c("trial_id"))),
        needs("logical_trial_id_not_digest", is_digest(c("logical_trial_id"))),
        needs("attempt_index_negative", c("attempt_index") >= 0),
        needs("logical_identity_missing", _if(v2, c("logical_identity").isNotNull())),
        needs("status_unknown", c("status").isin(*STATUSES)),
        needs("backend_unknown", c("backend").isin(*BACKENDS)),
        needs("phase_unknown", c("warmup_or_measured").isin(*PHASES)),
        needs("command_empty", (F.size("command") > 0) & F.forall("command", lambda a: a.isNotNull())),
        needs("timeout_not_boolean", c("timeout").isNotNull()),
        needs("oom_not_boolean", c("oom").isNotNull()),
        needs("timeout_disagrees", c("timeout") == (c("status") == "timeout")),
        needs("oom_disagrees", c("oom") == (c("status") == "oom")),
        needs("success_exit_code", _if(success, c("exit_code") == 0)),
        *[needs(f"{f}_not_boolean", c(f).isNotNull())
          for f in ("process_success", "scientific_success", "timing_eligible")],
        needs("process_success_disagrees",
              c("process_success") == (c("exit_code").eqNullSafe(F.lit(0)) & ~is_true(c("timeout")))),
        needs("success_without_science", _if(success, c("scientific_success"))),
        needs("eligible_without_success", _if(c("timing_eligible"), success)),
        needs("notes_not_strings", c("notes").isNotNull() & F.forall("notes", lambda n: n.isNotNull())),
        *[needs(f"{f}_missing", c(f).isNotNull())
          for f in ("input_files", "environment_overrides", "preflight", "resource_monitoring")],
        *[rule(f"{f}_negative", F.coalesce(c(f) < 0, F.lit(False)))
          for f in ("physical_cores", "n_alpha_strings", "n_beta_strings", "n_configurations",
                    "estimated_cache_bytes", "cpu_threads", "mpi_ranks", "repetition")],
        *[rule(f"{f}_not_finite", c(f).isNotNull() & ~finite(c(f)))
          for f in ("wall_time_s", "initialization_time_s", "solver_time_s", "matvec_time_s",
                    "transfer_time_s", "energy_or_eigenvalue", "reference_value",
                    "relative_error", "peak_host_rss_mb", "peak_gpu_memory_mb")],
    ]
    for f in ("family_id", "molecule", "basis"):
        rules += [
            needs(f"{f}_not_trimmed_text", _if(v3, _trimmed(c(f)))),
            needs(f"{f}_identity_differs", _if(v3, c(f) == c(f"logical_identity.{f}"))),
        ]
    rules += [
        needs("family_id_not_slug", _if(v3, c("family_id").rlike(SLUG))),
        needs("identity_version_differs", _if(v3, c("logical_identity.schema_version") == 3)),
        needs("identity_workload_differs", _if(v3, c("logical_identity.workload") == c("problem_instance"))),
        needs("identity_sweep_differs", _if(v3, c("logical_identity.sweep_name") == c("problem_family"))),
    ]
    return rules


def identity_violations(documents: DataFrame) -> DataFrame:
    """``path, rule`` where stored ids are not the hashes of the stored identity.

    Needs the raw text: the hash covers the identity object exactly as written.
    """
    digest = canonical_id_udf()
    attempt = F.concat(
        F.lit('{"attempt_index":'), F.get_json_object("text", "$.attempt_index"),
        F.lit(',"logical_trial_id":"'), F.get_json_object("text", "$.logical_trial_id"), F.lit('"}'),
    )
    rows = documents.where(F.get_json_object("text", "$.logical_identity").isNotNull()).select(
        "path", F.get_json_object("text", "$.trial_id").alias("trial_id"),
        F.get_json_object("text", "$.logical_trial_id").alias("logical_trial_id"),
        digest(raw_member(F.col("text"), "logical_identity")).alias("_l"),
        F.sha2(attempt, 256).alias("_t"),
    )
    names = F.array_compact(F.array(
        F.when(~F.col("logical_trial_id").eqNullSafe(F.col("_l")), F.lit("logical_trial_id_differs")),
        F.when(~F.col("trial_id").eqNullSafe(F.col("_t")), F.lit("trial_id_differs")),
    ))
    return rows.select("path", F.explode(names).alias("rule"))


def raw_member(text: Column, name: str) -> Column:
    """JSON text of one top-level member."""
    return F.get_json_object(text, f"$.{name}")


def timing_shape_rules() -> list[Rule]:
    """What a timing record must look like before it is classified."""
    c = F.col
    timed = c("warmup_or_measured").isin("warmup", "measured")
    v3 = timed & (c("schema_version") == 3)
    candidate = "logical_identity.candidate"
    rules = [
        needs("schema_version_not_2_or_3", c("schema_version").isin(2, 3)),
        needs("problem_instance_invalid", _if(timed, _text(c("problem_instance")))),
        needs("input_sha256_invalid", _if(timed, is_digest(c("input_sha256")))),
        *[needs(f"{f}_invalid", _if(timed, _text(c(f)))) for f in ("timestamp_utc", "finished_timestamp_utc")],
        needs("candidate_missing", _if(timed, c(candidate).isNotNull())),
        needs("candidate_name_invalid", _if(timed, _text(c(f"{candidate}.name")))),
        needs("candidate_backend_differs", _if(timed, c(f"{candidate}.backend").eqNullSafe(c("backend")))),
        needs("candidate_threads_differ", _if(timed, c(f"{candidate}.threads").eqNullSafe(c("cpu_threads")))),
        needs("candidate_ranks_differ", _if(v3, c(f"{candidate}.mpi_ranks").eqNullSafe(c("mpi_ranks")))),
        needs("candidate_build_invalid", _if(v3, _text(c(f"{candidate}.build_id")))),
        needs("candidate_artifact_invalid", _if(v3, is_digest(c(f"{candidate}.artifact_sha256")))),
        needs("features_missing", _if(timed, c("input_features").isNotNull())),
        needs("feature_hash_differs",
              _if(timed, c("input_features.combined_input_sha256").eqNullSafe(c("input_sha256")))),
        needs("feature_size_differs",
              _if(timed, c("input_features.n_configurations").eqNullSafe(c("n_configurations")))),
        needs("feature_work_differs",
              _if(timed, c("input_features.method0_work_proxy").eqNullSafe(c("estimated_work")))),
        *[needs(f"{f}_missing", _if(timed, c(f).isNotNull()))
          for f in ("input_integrity", "validation_evidence", "resource_monitoring", "protocol")],
        *[needs(f"{f}_invalid", _if(timed & (c("status") == "success"), finite(c(f)) & (c(f) >= 0)))
          for f in ("wall_time_s", "solver_time_s")],
    ]
    for f in ("family_id", "molecule", "basis"):
        rules += [
            needs(f"{f}_invalid", _if(v3, _trimmed(c(f)))),
            needs(f"{f}_differs", _if(v3, c(f).eqNullSafe(c(f"logical_identity.{f}")))),
        ]
    return rules


def calibration_rules(
    maximum_residual: float, upstream_url: str, upstream_commit: str
) -> list[Rule]:
    """Which records may serve as calibration evidence of one backend."""
    c = F.col
    gpu, cpu = c("backend") == "gpu", c("backend") == "cpu"
    env, pre, mon, out = ("environment_overrides", "preflight", "resource_monitoring", "upstream_output")
    offload = c(env)["OMP_TARGET_OFFLOAD"]
    device = F.trim(c(env)["CUDA_VISIBLE_DEVICES"])
    return [
        needs("schema_version_not_2_or_3", c("schema_version").isin(2, 3)),
        needs("backend_not_cpu_or_gpu", cpu | gpu),
        needs("upstream_url_differs", c("upstream_url") == upstream_url),
        needs("upstream_commit_differs", c("upstream_git_commit") == upstream_commit),
        needs("upstream_not_primary", c("official_upstream_primary")),
        needs("project_not_clean", is_false(c("project_git_dirty"))),
        needs("not_successful",
              (c("status") == "success") & c("process_success") & c("scientific_success")
              & (c("exit_code") == 0) & is_false(c("timeout")) & is_false(c("oom"))),
        rule("reference_check_failed", is_false(c("correct"))),
        needs("purpose_not_correctness", c("protocol.purpose") == "correctness"),
        needs("is_timing_evidence", is_false(c("timing_eligible"))),
        needs("input_sha256_invalid", is_digest(c("input_sha256"))),
        needs("identity_hash_differs", c("logical_identity.input_sha256") == c("input_sha256")),
        needs("identity_commit_differs", c("logical_identity.upstream_commit") == upstream_commit),
        needs("problem_instance_missing", _text(c("problem_instance"))),
        needs("not_converged", c(f"{out}.converged")),
        needs("residual_out_of_bounds",
              finite(c(f"{out}.final_residual")) & c(f"{out}.final_residual").between(0.0, maximum_residual)),
        needs("energy_differs", finite(c("energy_or_eigenvalue")) & (c("energy_or_eigenvalue") == c(f"{out}.energy"))),
        needs("iterations_invalid", c("iterations") >= 0),
        needs("iterations_differ", c("iterations") == c(f"{out}.iteration_records")),
        needs("density_missing", F.size(f"{out}.density") > 0),
        needs("density_not_finite", F.forall(f"{out}.density", finite)),
        needs("n_orbitals_not_positive", c("n_orbitals") > 0),
        needs("density_length_differs", F.size(f"{out}.density") == c("n_orbitals")),
        needs("gpu_preflight_missing", c(f"{pre}.gpu").isNotNull()),
        needs("gpu_query_failed", c(f"{pre}.gpu_process_query_ok")),
        needs("gpu_not_idle", c(f"{pre}.gpu_idle")),
        needs("host_monitor_incomplete", c(f"{mon}.host_complete")),
        needs("cpu_offload_not_disabled", _if(cpu, offload == "DISABLED")),
        needs("gpu_offload_not_mandatory", _if(gpu, offload == "MANDATORY")),
        needs("gpu_device_not_assigned", _if(gpu, _text(device))),
        needs("gpu_device_differs", _if(gpu, device == c(f"{pre}.gpu.index").cast("string"))),
        needs("gpu_monitor_incomplete", _if(gpu, c(f"{mon}.gpu_complete"))),
        needs("gpu_process_not_observed", _if(gpu, c(f"{mon}.gpu_process_observed"))),
        needs("gpu_samples_missing", _if(gpu, c(f"{mon}.samples") > 0)),
        needs("gpu_memory_not_observed", _if(gpu, finite(c("peak_gpu_memory_mb")) & (c("peak_gpu_memory_mb") > 0))),
        needs("gpu_device_line_missing", _if(gpu, c(f"{out}.device_assignment_seen"))),
    ]


def screen_rules(warmups: int = 1, repetitions: int = 1) -> list[Rule]:
    """Gates of a parameter screen: verified pilot records, eligible exactly when measured."""
    c = F.col
    return [
        *[needs(f"{f}_failed", c(f)) for f in ("process_success", "scientific_success", "correct")],
        needs("status_not_success", c("status") == "success"),
        needs("project_not_clean", is_false(c("project_git_dirty"))),
        needs("eligibility_differs_from_phase",
              c("timing_eligible") == (c("warmup_or_measured") == "measured")),
        needs("purpose_not_pilot", c("protocol.purpose") == "pilot"),
        needs("protocol_geometry_differs",
              (c("protocol.warmups") == warmups) & (c("protocol.repetitions") == repetitions)),
        needs("correctness_not_validated", c("protocol.correctness_validated")),
        needs("evidence_invalid", c("validation_evidence.required") & c("validation_evidence.valid")),
        needs("evidence_has_errors", F.size("validation_evidence.errors") == 0),
    ]


def campaign_rules() -> list[Rule]:
    """Gates of a final campaign; ``plan_*`` columns come from the joined plan row."""
    c = F.col
    gpu = c("backend") == "gpu"
    candidate = "logical_identity.candidate"
    pre, mon, est = "preflight", "resource_monitoring", "source_memory_estimate"
    same = [
        ("candidate_backend_differs", c(f"{candidate}.backend").eqNullSafe(c("plan_backend"))),
        ("candidate_threads_differ", c(f"{candidate}.threads").eqNullSafe(c("plan_threads"))),
        ("candidate_ranks_differ", c(f"{candidate}.mpi_ranks").eqNullSafe(c("plan_mpi_ranks"))),
        ("candidate_artifact_differs", c(f"{candidate}.artifact_sha256").eqNullSafe(c("plan_artifact_sha256"))),
        ("backend_differs", c("backend").eqNullSafe(c("plan_backend"))),
        ("threads_differ", c("cpu_threads").eqNullSafe(c("plan_threads"))),
        ("ranks_differ", c("mpi_ranks").eqNullSafe(c("plan_mpi_ranks"))),
        ("campaign_differs", c("problem_family").eqNullSafe(c("plan_campaign"))),
        ("family_differs", c("family_id").eqNullSafe(c("plan_family_id"))),
        ("molecule_differs", c("molecule").eqNullSafe(c("plan_molecule"))),
        ("basis_differs", c("basis").eqNullSafe(c("plan_basis"))),
        ("warmups_differ", c("protocol.warmups").eqNullSafe(c("plan_warmups"))),
        ("repetitions_differ", c("protocol.repetitions").eqNullSafe(c("plan_repetitions"))),
    ]
    outcome = {
        "status_not_success": c("status") == "success",
        "process_not_successful": c("process_success"),
        "scientific_not_successful": c("scientific_success"),
        "correct_not_true": c("correct"),
        "timed_out": is_false(c("timeout")),
        "out_of_memory": is_false(c("oom")),
        "exit_code_not_zero": c("exit_code") == 0,
        "not_first_attempt": c("attempt_index") == 0,
        "project_not_clean": is_false(c("project_git_dirty")),
        "eligibility_differs_from_phase": c("timing_eligible") == (c("warmup_or_measured") == "measured"),
        "purpose_not_final": c("protocol.purpose") == "final",
        "correctness_not_validated": c("protocol.correctness_validated"),
        "evidence_invalid": c("validation_evidence.required") & c("validation_evidence.valid")
        & (F.size("validation_evidence.errors") == 0),
        "gpu_not_idle": c(f"{pre}.gpu_idle"),
        "gpu_query_failed": c(f"{pre}.gpu_process_query_ok"),
        "host_monitor_incomplete": c(f"{mon}.host_complete"),
        "gpu_monitor_incomplete": _if(
            gpu, c(f"{mon}.gpu_complete") & c(f"{mon}.gpu_process_observed") & (c("peak_gpu_memory_mb") > 0)),
        "input_changed": same_inputs(c("input_integrity.initial"), c("input_integrity.before_launch"))
        & same_inputs(c("input_integrity.initial"), c("input_integrity.after_run")),
        "host_guard_over_cap": c(f"{est}.host_guard_bytes") <= c(f"{pre}.host_memory_cap_bytes"),
        "gpu_guard_over_cap": _if(
            gpu, (c(f"{est}.gpu_guard_bytes") <= c(f"{pre}.gpu_memory_cap_bytes"))
            & (c(f"{est}.gpu_host_guard_bytes") <= c(f"{pre}.host_memory_cap_bytes"))),
    }
    return [*[needs(n, t) for n, t in same], *[needs(n, t) for n, t in outcome.items()]]


def registry_rules() -> list[Rule]:
    """Row contract of a family registry; coverage is checked with ``partition_check``."""
    c = F.col
    expected = F.sha2(F.concat_ws("\0", "family_id", "problem_instance", "input_sha256"), 256)
    return [
        needs("entry_id_differs", c("entry_id") == expected),
        needs("family_missing", _text(c("family_id"))),
        needs("input_sha256_invalid", is_digest(c("input_sha256"))),
        needs("n_configurations_not_positive", c("n_configurations") > 0),
        needs("basis_status_differs",
              c("basis_status") == F.when(_text(c("basis")), "reported").otherwise("upstream_not_reported")),
        needs("member_count_differs", c("source_record_count") == c("members")),
    ]


def screen_output_violations(
    effects: DataFrame, measurements: DataFrame, factors: dict[str, tuple],
    workload: Sequence[str] = ("family_id", "problem_instance"),
) -> DataFrame:
    """Workloads whose row counts differ from the full factorial design."""
    cells = 1
    for levels in factors.values():
        cells *= len(levels)
    pairs = sum(cells // len(levels) for levels in factors.values())
    seen = measurements.groupBy(*workload).agg(
        F.count(F.lit(1)).alias("_m"), F.countDistinct("candidate_name").alias("_u"))
    made = effects.groupBy(*workload).agg(F.count(F.lit(1)).alias("_e"))
    joined = seen.join(made, list(workload), "left")
    names = F.array_compact(F.array(
        F.when(F.col("_m") != cells, F.lit("measurement_count")),
        F.when(F.col("_u") != F.col("_m"), F.lit("candidate_repeated")),
        F.when(F.coalesce("_e", F.lit(0)) != pairs, F.lit("effect_count")),
    ))
    return joined.select(*workload, F.explode(names).alias("rule"))
