"""Threshold fits, metrics, balanced data, trees, screens."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from trialflow.operators import policy as P
from trialflow.operators import screen as S
from trialflow.operators import trees


def pair_rows(spark, rows):
    return spark.createDataFrame(
        rows, "family_id string, problem_instance string, n_configurations long, cpu_time double, gpu_time double")


def fit(pairs):
    curve = P.size_curve(pairs.withColumn("fold_id", F.lit("x")), ["fold_id"])
    return P.fit_thresholds(curve).first()


def test_threshold_is_the_geometric_midpoint(spark):
    pairs = pair_rows(spark, [("f", f"i{n}", n, 1.0 if n <= 16 else 4.0, 2.0) for n in (16, 32, 64, 128)])
    model = fit(pairs)
    assert (model["kind"], model["threshold"], model["objective"]) == ("geometric_midpoint", math.sqrt(16 * 32), 1.0)


def test_ties_keep_the_first_cut_and_sentinels(spark):
    assert fit(pair_rows(spark, [("f", f"i{n}", n, 1.0, 1.0) for n in (16, 32)]))["kind"] == "always_gpu"
    assert fit(pair_rows(spark, [("f", f"i{n}", n, 1.0, 2.0) for n in (16, 32)]))["kind"] == "always_cpu"
    assert fit(pair_rows(spark, [("f", f"i{n}", n, 2.0, 1.0) for n in (16, 32)]))["kind"] == "always_gpu"


def brute(rows):
    sizes = sorted({r[2] for r in rows})
    cuts = [("always_gpu", None)] + [("geometric_midpoint", math.sqrt(a * b)) for a, b in zip(sizes, sizes[1:])] + [("always_cpu", None)]
    best = None
    for kind, t in cuts:
        logs = []
        for _, _, n, c, g in rows:
            cpu = kind == "always_cpu" or (t is not None and n <= t)
            logs.append(math.log((c if cpu else g) / min(c, g)))
        value = math.fsum(logs) / len(logs)
        if best is None or value < best[2] - 1e-11:
            best = (kind, t, value)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_leave_one_out_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{i % 3}", f"i{i}", rng.choice([4, 9, 16, 25, 36, 49]), rng.uniform(0.5, 4), rng.uniform(0.5, 4)) for i in range(14)]
    rows.append(("f0", "big", 400, 9.0, 1.0))
    pairs = pair_rows(spark, rows)
    loio = {r["problem_instance"]: r for r in P.loio_thresholds(pairs).collect()}
    for row in rows:
        kind, t, value = brute([r for r in rows if r is not row])
        got = loio[row[1]]
        assert got["kind"] == kind and got["threshold"] == pytest.approx(t) and got["objective"] == pytest.approx(math.exp(value))
    lofo = {r["fold_id"]: r for r in P.fit_thresholds(P.family_curves(pairs)).collect()}
    for f in ("f0", "f1", "f2"):
        kind, t, _ = brute([r for r in rows if r[0] != f])
        assert lofo[f]["kind"] == kind and lofo[f]["threshold"] == pytest.approx(t)


def test_held_out_changes_cannot_move_a_model(spark):
    rng = random.Random(5)
    rows = [(f"f{i % 2}", f"i{i}", 2 ** (i % 6 + 2), rng.uniform(1, 3), rng.uniform(1, 3)) for i in range(12)]
    changed = [r if r[0] != "f0" else (*r[:3], r[3] * 9, r[4] / 7) for r in rows]
    models = [
        {r["fold_id"]: (r["kind"], r["threshold"]) for r in P.fit_thresholds(P.family_curves(pair_rows(spark, x))).collect()}
        for x in (rows, changed)
    ]
    assert models[0]["f0"] == models[1]["f0"]


def test_metric_denominators(spark):
    columns = ("family_id string, policy string, valid boolean, failure boolean, normalized_runtime double, normalized_regret double,"
               " selection_correct boolean, within_5pct_oracle boolean, speedup_vs_fixed_cpu double, speedup_vs_fixed_gpu double")
    df = spark.createDataFrame([
        ("f", "p", True, False, 1.0, 0.0, True, True, 1.0, 2.0), ("f", "p", True, False, 2.0, 1.0, False, False, None, 2.0),
        ("f", "p", False, True, None, None, False, False, None, None)], columns)
    for hot in (None, 1):
        row = P.policy_metrics(df, hot).where("scope = 'pooled'").first()
        assert (row["instances_total"], row["valid_instances"], row["failure_count"]) == (3, 2, 1)
        assert row["geomean_selected_over_best"] == pytest.approx(math.sqrt(2))
        assert (row["regret_median"], row["regret_p90"], row["selection_accuracy"]) == (0.5, 0.9, pytest.approx(1 / 3))
        assert row["geomean_speedup_cpu"] is None and row["geomean_speedup_gpu"] == pytest.approx(2.0)


def measured(spark, rows):
    df = spark.createDataFrame(
        rows, "family_id string, problem_instance string, candidate_name string, backend string, repetition int, wall_time_s double, trial_id string")
    return df.select("*", F.sha2("problem_instance", 256).alias("input_sha256"), F.lit(10).alias("n_configurations"),
                     (F.lit(100) - F.col("repetition")).alias("host_cap_bytes"), F.lit(50).alias("gpu_cap_bytes"))


def full(instance):
    return [("f", instance, c, b, r, float(r + k), f"{instance}{c}{r}") for k, (c, b) in enumerate((("cpu-16", "cpu"), ("gpu-1", "gpu")), 1) for r in range(3)]


def test_balanced_dataset(spark):
    rows = full("ok") + full("short")[:-1] + full("twice") + [("f", "twice", "gpu-1", "gpu", 0, 1.0, "again")] + full("lone")[:3]
    good, bad = P.balanced_dataset(measured(spark, rows), {"cpu-16": "cpu", "gpu-1": "gpu"}, ["n_configurations"])
    kept = {r["candidate_name"]: r for r in good.collect()}
    assert set(kept) == {"cpu-16", "gpu-1"} and kept["cpu-16"]["median_wall_time_s"] == 2.0
    assert kept["cpu-16"]["source_record_ids"] == ["okcpu-160", "okcpu-161", "okcpu-162"] and kept["gpu-1"]["host_cap_bytes"] == 98
    found = {(r["problem_instance"], r["rule"]) for r in bad.collect()}
    assert found == {("short", "repetitions_incomplete_or_repeated"), ("twice", "repetitions_incomplete_or_repeated"), ("lone", "candidates_incomplete")}


def test_balanced_dataset_does_not_depend_on_order(spark):
    rows = full("a") + full("b")
    base = None
    for n in (1, 7, 40):
        random.Random(n).shuffle(rows)
        good, _ = P.balanced_dataset(measured(spark, rows).repartition(n), {"cpu-16": "cpu", "gpu-1": "gpu"})
        got = sorted(map(str, good.collect()))
        base = base or got
        assert got == base


def test_predictions_follow_the_reason_order(spark):
    df = spark.createDataFrame(
        [("f", "a", 4, 2.0, 1.0, True, True), ("f", "b", 4, 2.0, 1.0, True, False), ("f", "c", 4, 2.0, 1.0, False, False)],
        "family_id string, problem_instance string, n_configurations long, cpu_time double, gpu_time double, cpu_feasible boolean, gpu_feasible boolean")
    c = F.col
    df = df.withColumn("best_time", F.least(F.when(c("cpu_feasible"), c("cpu_time")), F.when(c("gpu_feasible"), c("gpu_time")))).withColumn(
        "best_names", F.array_compact(F.array(F.when(c("cpu_feasible") & (c("cpu_time") == c("best_time")), P.CPU), F.when(c("gpu_feasible") & (c("gpu_time") == c("best_time")), P.GPU))))
    rows = P.predict_policies(df, {"gpu": F.lit(P.GPU), "none": F.lit(None), "odd": F.lit("tpu"), "best": P.best_name()}).collect()
    got = {(r["problem_instance"], r["policy"]): (r["invalid_reason"], r["normalized_regret"], r["selection_correct"]) for r in rows}
    assert got["a", "gpu"] == (None, 0.0, True) and got["b", "gpu"] == ("selected_candidate_memory_infeasible", None, False)
    assert got["a", "none"][0] == "policy_returned_no_candidate" and got["a", "odd"][0] == "candidate_not_in_matrix"
    assert {got["c", p][0] for p in ("gpu", "none", "odd", "best")} == {"no_feasible_candidates"}
    assert got["b", "best"] == (None, 0.0, True)


def grid(spark, workloads):
    rows = [
        (f"fam{w % 3}", f"w{w}", 100 * (w // 3 + 1), b, n, s, f"{b}/{n}/{s}", 1.0 + w + (b == "cpu") + (n == 20) * 0.5 + s * 0.25, 0.5)
        for w in range(workloads) for b, n, s in itertools.product(("cpu", "gpu"), (20, 48), (False, True))
    ]
    return spark.createDataFrame(rows, "family_id string, problem_instance string, n_configurations long, backend string, bit_length int, shuffle boolean, candidate_name string, wall_time_s double, solver_time_s double")


def test_full_factorial_geometry(spark):
    tables = S.screen(grid(spark, 9))
    assert tables["measurement"].count() == 72 and tables["paired_effect"].count() == 108
    assert {r["problem_instance"]: r["n"] for r in tables["paired_effect"].groupBy("problem_instance").agg(F.count("*").alias("n")).collect()} == {f"w{i}": 12 for i in range(9)}
    scopes = {r["scope"]: r["n"] for r in tables["timing_summary"].groupBy("scope").agg(F.count("*").alias("n")).collect()}
    assert scopes == {"all": 8, "family": 24, "size": 24}
    assert tables["factor_summary"].where("scope = 'all'").count() == 3 and tables["factor_summary"].where("scope = 'family'").count() == 9
    row = tables["factor_summary"].where("scope = 'all' AND factor = 'backend'").first()
    assert (row["n"], row["wall_right"], row["wall_left"], row["solver_tie"]) == (36, 36, 0, 36)


def test_incomplete_screen_is_reported(spark):
    from trialflow.operators.contracts import screen_output_violations
    df = grid(spark, 2).where("NOT (problem_instance = 'w1' AND candidate_name = 'cpu/20/False')")
    bad = screen_output_violations(S.paired_effects(df), df, S.FACTORS)
    assert {(r["problem_instance"], r["rule"]) for r in bad.collect()} == {("w1", "measurement_count"), ("w1", "effect_count")}


def test_tree_splits_where_the_runtime_jumps(spark):
    rows = [(float(n), float(g), math.log1p(5.0 if n > 3 else 1.0 + g)) for n in range(8) for g in (0, 1)]
    df = spark.createDataFrame(rows, f"log1p_n_configurations double, backend_gpu double, {trees.TARGET} double")
    nodes = trees.fit_tree(df, P.SIZE_FEATURES)
    assert nodes[0]["feature"] == "log1p_n_configurations" and 3 <= nodes[0]["threshold"] < 4
    scored = df.withColumn("p", trees.tree_column(nodes))
    assert scored.where(F.abs(F.col("p") - F.col(trees.TARGET)) > 1e-9).count() == 0
    leaves = sum(n["type"] == "leaf" for n in nodes)
    assert leaves <= 8 and trees.node_table(spark, {("f", "s"): nodes}).count() == len(nodes)


def test_features_must_be_known_before_the_run(spark):
    with pytest.raises(ValueError):
        trees.require_allowed(["log1p_n_configurations", "peak_gpu_memory_mb"])


@pytest.mark.parametrize("nodes", [
    [{"node_id": 0, "type": "split", "feature": "x", "threshold": 1.0, "left": 0, "right": 0}],
    [{"node_id": 0, "type": "split", "feature": "x", "threshold": 1.0, "left": 1, "right": 2}],
    [{"node_id": 0, "type": "leaf", "value": float("nan")}],
    [{"node_id": 0, "type": "leaf", "value": 1.0}, {"node_id": 0, "type": "leaf", "value": 1.0}],
    [{"node_id": 0, "type": "odd"}],
])
def test_broken_trees_are_rejected(spark, nodes):
    with pytest.raises(ValueError):
        trees.tree_column(nodes)


def test_infeasible_candidates_never_win(spark):
    df = spark.createDataFrame(
        [("f", "a", "cpu-16", 2.0, True), ("f", "a", "gpu-1", 1.0, False), ("f", "b", "cpu-16", 1.0, False), ("f", "c", "gpu-1", 1.0, True), ("f", "c", "cpu-16", 1.0, True)],
        "family_id string, problem_instance string, candidate_name string, p double, ok boolean")
    got = {r["problem_instance"]: (r["selected_candidate_name"], r["invalid_reason"]) for r in trees.select_by_tree(df, F.col("p"), F.col("ok")).collect()}
    assert got == {"a": ("cpu-16", None), "b": (None, "no_feasible_candidates"), "c": ("cpu-16", None)}


def test_every_family_is_a_fold(spark):
    from queries import policy

    folder = "/root/testdata/sf0.001"
    families = {r[0] for r in policy.modelled(spark, folder).select("family_id").distinct().collect()}
    found = policy.m03(spark, folder).collect()
    assert len(families) > 5
    assert {(r["fold_id"], r["feature_set"]) for r in found} == {(f, s) for f in families for s in policy.FEATURE_SETS}
