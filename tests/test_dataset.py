"""Contract of the balanced model dataset."""

import pytest
from pyspark.sql import functions as F

from trialflow.operators import dataset as D
from trialflow.operators import policy as P

SCHEMA = ("instance_id string, family_id string, problem_instance string, input_sha256 string, n_configurations bigint, host_cap_bytes bigint, gpu_cap_bytes bigint,"
          " candidate_name string, source_record_ids array<string>, feature_values map<string,double>, extra string")
FEATURES = {f: 1.0 for f in P.FULL_FEATURES}


def row(instance, candidate, **changes):
    base = {"instance_id": f"f::{instance}", "family_id": "f", "problem_instance": instance, "input_sha256": "a" * 64, "n_configurations": 4, "host_cap_bytes": 1,
            "gpu_cap_bytes": None, "candidate_name": candidate, "source_record_ids": [f"{instance}-{candidate}-{k}" for k in range(3)], "feature_values": dict(FEATURES), "extra": "x"}
    return tuple((base | changes).values())


@pytest.fixture
def sound(spark):
    return spark.createDataFrame([row(i, c) for i in ("a", "b") for c in (P.CPU, P.GPU)], SCHEMA)


def listed(rows):
    return rows.select(F.explode("source_record_ids").alias("trial_id"))


def violations(rows, stored, ids=None):
    found = D.dataset_violations(rows, listed(stored) if ids is None else ids, D.instance_summaries(stored), D.family_summaries(stored), [P.CPU, P.GPU])
    return {tuple(r) for r in found.collect()}


def test_a_sound_dataset_has_no_violation(sound):
    assert violations(sound, sound) == set() and D.feature_violations(sound).count() == 0


@pytest.mark.parametrize("values, expected", [
    (None, {(f, "feature_missing") for f in P.FULL_FEATURES}), (FEATURES | {"wall_time_s": 1.0}, {("wall_time_s", "feature_not_allowed")}),
    ({k: v for k, v in FEATURES.items() if k != "cpu_threads"}, {("cpu_threads", "feature_missing")}),
    (FEATURES | {"backend_gpu": float("inf")}, {("backend_gpu", "feature_not_finite")}), (FEATURES | {"backend_gpu": None}, {("backend_gpu", "feature_not_finite")}),
    (FEATURES | {"basis": float("nan")}, {("basis", "feature_not_allowed"), ("basis", "provenance_as_feature")}),
])
def test_feature_maps_are_the_allow_list(spark, values, expected):
    rows = spark.createDataFrame([row("a", P.CPU, feature_values=values), row("b", P.CPU)], SCHEMA)
    assert {tuple(r) for r in D.feature_violations(rows).collect()} == {("f::a", P.CPU, *e) for e in expected}


def test_only_allowed_features_can_be_registered(sound):
    with pytest.raises(ValueError):
        D.feature_violations(sound, ["cpu_threads", "wall_time_s"])


def test_records_rows_and_summaries_are_checked(spark, sound):
    rows = spark.createDataFrame([
        row("a", P.CPU), row("a", P.GPU, source_record_ids=["a-cpu-16-0", "new", None]),
        row("b", P.CPU, input_sha256=None), row("c", "tpu", instance_id="f::d", source_record_ids=["x"])], SCHEMA)
    assert violations(rows, sound) == {
        ("a-cpu-16-0", "source_reused"), ("new", "source_not_listed"), (None, "source_not_listed"), *[(f"a-gpu-1-{k}", "source_not_cited") for k in range(3)],
        *[(f"b-gpu-1-{k}", "source_not_cited") for k in range(3)], ("x", "source_not_listed"), ("f::b/cpu-16", "input_not_digest"), ("f::d/tpu", "instance_id_differs"),
        ("f::d/tpu", "candidate_not_registered"), ("f::d/tpu", "source_count_differs"), ("f::b", "instance_summary_differs"), ("f::b", "candidates_incomplete"),
        ("f::d", "instance_summary_missing"), ("f::d", "candidates_incomplete"), ("f", "family_summary_differs")}


def test_empty_tables(sound):
    none = sound.limit(0)
    assert violations(none, none) == set() and D.feature_violations(none).count() == 0
    assert ("f::a", "instance_without_rows") in violations(none, sound) and ("f", "family_without_rows") in violations(none, sound)
