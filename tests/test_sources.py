"""Record reader, contracts, sinks, identities, audits."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialflow.functions import derive, identity, outcome
from trialflow.operators import audit, contracts
from trialflow.operators.rules import ContractError, check, gate, needs, rule, split
from trialflow.schemas import REQUIRED_FIELDS, REQUIRED_V2, REQUIRED_V3
from trialflow.sources import artifacts, records, tables


def compact(value):
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def sha(value):
    return hashlib.sha256(value.encode()).hexdigest()


def document(**changes):
    identity_ = {"schema_version": 3, "family_id": "n-two", "molecule": "N2", "basis": "b", "workload": "w", "sweep_name": "s",
                 "solver": {"tolerance": 1e-08, "max_time": 300.0}, "input_sha256": "0" * 64}
    record = {name: None for name in REQUIRED_FIELDS + REQUIRED_V2 + REQUIRED_V3}
    logical = sha(compact(identity_))
    record.update(
        schema_version=3, logical_identity=identity_, logical_trial_id=logical, attempt_index=0,
        trial_id=sha(compact({"attempt_index": 0, "logical_trial_id": logical})), family_id="n-two", molecule="N2", basis="b",
        problem_instance="w", problem_family="s", status="success", backend="cpu", warmup_or_measured="measured", command=["x"],
        timeout=False, oom=False, exit_code=0, process_success=True, scientific_success=True, timing_eligible=True, notes=[],
        input_files=[], environment_overrides={}, preflight={}, resource_monitoring={}, repetition=0, wall_time_s=1.5)
    record.update(changes)
    return record


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    sound = document()
    (folder / f"{sound['trial_id']}.json").write_text(json.dumps(sound))
    texts = {
        "stem": json.dumps(sound), "list": "[1]", "broken": "{", "nan": json.dumps(sound).replace("1.5", "NaN"),
        "float": json.dumps(document(repetition=5.0)), "bool": json.dumps(document(attempt_index=True)),
        "twice": json.dumps(sound)[:-1] + ', "seed": 1, "seed": 2}', "nested": json.dumps(sound).replace('"workload": "w"', '"workload": "w", "workload": "w"'),
        "version": json.dumps(document(schema_version=9)), "short": json.dumps({k: v for k, v in sound.items() if k != "seed"}),
    }
    for name, text in texts.items():
        (folder / f"{name}.json").write_text(text)
    good, bad = records.read_runs(spark, str(folder))
    found = {}
    for r in bad.collect():
        found.setdefault(r["path"].rsplit("/", 1)[1].removesuffix(".json"), set()).add(r["rule"])
    return folder, good, found


def test_only_the_sound_record_is_read(read):
    folder, good, found = read
    rows = good.collect()
    assert len(rows) == 1 and rows[0]["wall_time_s"] == 1.5 and rows[0]["logical_identity"]["workload"] == "w"
    assert found["stem"] == {"file_name_differs"} and found["list"] == {"root_not_object", "value_of_wrong_type"} - ({"value_of_wrong_type"})
    assert found["broken"] == {"invalid_json"} and found["nan"] == {"non_finite_number"}
    assert found["float"] == {"value_of_wrong_type"} and found["bool"] == {"value_of_wrong_type"}
    assert found["twice"] == {"duplicate_key"} and found["nested"] == {"duplicate_key"}
    assert "schema_version_unsupported" in found["version"] and "missing:seed" in found["short"]


def test_identity_is_the_hash_of_the_document(spark, read):
    folder, _, _ = read
    documents = records.read_documents(spark, str(folder)).where("name NOT IN ('list.json', 'broken.json', 'nan.json')")
    assert not {r["path"] for r in contracts.identity_violations(documents.where("name NOT IN ('bool.json', 'nested.json', 'twice.json')")).collect()}
    forged = documents.where("name = 'stem.json'").withColumn("text", F.replace("text", F.lit("1e-08"), F.lit("1e-07")))
    assert {r["rule"] for r in contracts.identity_violations(forged).collect()} == {"logical_trial_id_differs"}


def test_sound_record_meets_its_contract(read):
    _, good, _ = read
    assert {r["rule"] for r in check(good, contracts.record_rules(), ["trial_id"]).collect()} == set()


@pytest.mark.parametrize("changes, expected", [
    ({"status": "odd", "timing_eligible": False}, "status_unknown"), ({"timeout": True, "process_success": False}, "timeout_disagrees"),
    ({"exit_code": 1, "process_success": False}, "success_exit_code"), ({"family_id": "N Two"}, "family_id_not_slug"),
    ({"command": []}, "command_empty"), ({"repetition": -1}, "repetition_negative"), ({"scientific_success": False}, "success_without_science"),
    ({"attempt_index": -1}, "attempt_index_negative"), ({"molecule": " N2"}, "molecule_not_trimmed_text"), ({"problem_instance": "v"}, "identity_workload_differs"),
])
def test_each_broken_field_is_named(spark, changes, expected):
    text = json.dumps(document(**changes))
    name = document(**changes)["trial_id"] + ".json"
    docs = spark.createDataFrame([("p", name, text)], "path string, name string, text string")
    good, bad = records.parse_documents(docs)
    assert bad.count() == 0
    assert expected in {r["rule"] for r in check(good, contracts.record_rules(), ["trial_id"]).collect()}


def test_selection_by_id_and_landing(spark, tmp_path):
    runs = spark.createDataFrame([("a", 3), ("b", 2)], "trial_id string, schema_version int")
    ids = spark.createDataFrame([("a",), ("a",), ("z",)], "trial_id string")
    kept, bad = records.select_runs(runs, ids)
    assert [r["trial_id"] for r in kept.collect()] == ["a"]
    assert {(r["trial_id"], r["rule"]) for r in bad.collect()} == {("a", "id_repeated"), ("z", "id_unknown")}
    records.land_runs(runs, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").iterdir() if p.is_dir()} == {"schema_version=2", "schema_version=3"}
    wide = records.conform(runs)
    assert wide.columns[0] == "schema_version" and wide.count() == 2


def test_gate_fails_closed(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "k int, v int")
    rules = [needs("positive", F.col("v") > 0), rule("too_big", F.coalesce(F.col("v") > 3, F.lit(False)))]
    good, bad = split(df, rules, ["k"])
    assert good.count() == 0 and {(r["k"], r["rule"]) for r in bad.collect()} == {(1, "too_big"), (2, "positive")}
    with pytest.raises(ContractError, match="too_big"):
        gate(bad)
    gate(bad.where("false"))


def test_hashes_equal_hashlib(spark):
    a, b = sha("a"), sha("b")
    df = spark.createDataFrame([(a, b)], "a string, b string")
    expected = hashlib.sha256(b"v1\0" + b"one\0" + bytes.fromhex(a) + b"two\0" + bytes.fromhex(b)).hexdigest()
    assert df.select(identity.role_hash("v1", {"one": F.col("a"), "two": F.col("b")})).first()[0] == expected
    files = F.array(F.struct(F.lit("r").alias("role"), F.lit("p").alias("path"), F.col("a").alias("sha256"), F.lit(3).alias("size_bytes")))
    assert df.select(identity.semantic_hash(files)).first()[0] == sha(compact([{"role": "r", "sha256": a, "size_bytes": 3}]))
    assert df.select(identity.seeded_key(F.lit("x"), F.lit(7))).first()[0] == sha("x\0" + "7")


def test_redaction_and_density(spark):
    row = spark.range(1).select(
        identity.redact(F.create_map(F.lit("my_token"), F.lit("v"), F.lit("PATH"), F.lit("/"))).alias("e"),
        derive.repair_density(F.lit("[1.0, 2.5"))[0].alias("d"), derive.repair_density(F.lit("[1.0, x]"))[0].alias("x"),
        derive.repair_density(F.lit("[]"))[0].alias("n"),
    ).first()
    assert row["e"] == {"my_token": f"<redacted:sha256:{sha('v')[:12]}>", "PATH": "/"}
    assert row["d"] == [1.0, 2.5] and row["x"] is None and row["n"] is None


@pytest.mark.parametrize("text, hit", [("Out of Memory", True), ("cuda error: no memory", True), ("OOM", True), ("room", False), ("cuda\nmemory", False)])
def test_oom_evidence(spark, text, hit):
    null = F.lit(None).cast("string")
    status, _ = outcome.process_status(null, F.lit(False), F.lit(1), null, F.lit(text))
    assert spark.range(1).select(status).first()[0] == ("oom" if hit else "failed")


def test_snapshot_is_written_only_when_rows_change(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, [1.5]), (1, [1.5]), (2, None)], "k int, v array<double>")
    assert tables.write_table(df, path) and not tables.write_table(df.repartition(3), path)
    assert tables.write_table(df.dropDuplicates(), path)
    assert spark.read.parquet(tables.current_snapshot(spark, path)).count() == 2


def test_csv_round_trip_and_missing_columns(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("a,\"b", 1.5, ["x", "y"]), ("c", None, [])], "k string, v double, l array<string>")
    tables.write_csv(tables.json_cells(df), path)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType()), T.StructField("l", T.ArrayType(T.StringType()))])
    assert sorted(map(tuple, tables.read_table(spark, path, schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    with pytest.raises(ContractError, match="w"):
        tables.read_table(spark, path, T.StructType([*schema.fields, T.StructField("w", T.LongType())]))


def test_inventory(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"abc")
    row = artifacts.inventory(spark, str(tmp_path)).first()
    assert (row["size_bytes"], row["sha256"]) == (3, hashlib.sha256(b"abc").hexdigest())


def test_chain_hash_ignores_order_and_sees_every_change(spark):
    rows = [(f"t{i}", i % 3) for i in range(200)] + [("copy", 1)] * 50
    def chain(data, n):
        return audit.chain_hash(spark.createDataFrame(data, "t string, k int").repartition(n), ["t", "k"]).first()
    base = chain(rows, 1)
    assert base == chain(rows[::-1], 9) and base["records"] == 250
    assert chain(rows[:-1], 1)["chain_sha256"] != base["chain_sha256"]
    assert chain([("t0", 9), *rows[1:]], 1)["chain_sha256"] != base["chain_sha256"]


def test_strong_overlap_sees_beyond_the_neighbour(spark):
    df = spark.createDataFrame(
        [("h", "a", 0, 9000), ("h", "b", 10, 20), ("h", "c", 4000, 4010), ("h", "d", 9000, 9001)], "host string, id string, s long, e long"
    ).select("host", "id", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    assert {r["id"] for r in audit.overlaps(df, ["host"], "id", "s", "e").collect()} == {"b", "c"}
    assert {r["id"] for r in audit.overlaps(df, ["host"], "id", "s", "e", strong=False).collect()} == {"b"}


@pytest.mark.parametrize("text, fault", [
    ('{"a":1}', None), (' {"a":[1,{"b":2}]} \n', None), ('{"a":"NaN"}', None), ('{"a":1e400}', None), ('{"a":"\\u00e9\\"}"}', None),
    ('{"a":1,"a":2}', "duplicate_key"), ('{"b":[{"a":1,"a":{}}]}', "duplicate_key"), ('{"\\u0061":1,"a":2}', "duplicate_key"), ('[{"a":1,"a":2}]', "duplicate_key"),
    ('{"b":{"a":NaN}}', "non_finite_number"), ('{"a":-Infinity,"c":"x"}', "non_finite_number"),
    ("[1]", "root_not_object"), ("null", "root_not_object"), ('"x"', "root_not_object"), ("5", "root_not_object"),
    ('{"a":1} x', "invalid_json"), ('{"a":1}{"b":2}', "invalid_json"), ('{"a":1},{"b":2}', "invalid_json"), ('{"a":1}]', "invalid_json"), ('{"a":1}}', "invalid_json"),
    ('{"a":1}],[{}', "invalid_json"), ("", "invalid_json"), (None, "invalid_json"), ("{'a':1}", "invalid_json"), ('{"a":01}', "invalid_json"), ('{"a":"\t"}', "invalid_json"), ('{"a":1,}', "invalid_json"),
])
def test_faults_of_a_strict_parser(spark, text, fault):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(records.strict_fault(F.col("text"))).first()[0] == fault


def test_documents_and_samples_are_read_back_from_their_files(spark, tmp_path):
    rows = [("a/b c", "x.json", '{"k": 1}\n{"l": 2}'), ("ü", "y.json", "[1]")]
    folder = str(tmp_path / "docs")
    records.write_documents(spark.createDataFrame(rows, "path string, name string, text string"), folder)
    got = {tuple(r) for r in records.read_documents(spark, folder, base=folder).collect()}
    assert got == {(p, n, t + "\n") for p, n, t in rows}
    from trialflow.sources import samples
    values = [("t 1+2%", 0.5, 1.0, None, None, None, None), ("t 1+2%", 1.5, 2.0, 3.0, None, None, None), ("é/x", 0.0, None, None, None, None, None)]
    made = spark.createDataFrame(values, "trial_id string, elapsed_s double, host_rss_mib double, gpu_memory_mib double, gpu_utilization_pct double, gpu_temperature_c double, gpu_power_w double")
    samples.write_samples(made, str(tmp_path / "samples"))
    assert {tuple(r) for r in samples.read_sample_folders(spark, str(tmp_path / "samples")).collect()} == set(values)
