"""What keeps queries small at size: parses, passes, shuffles and files."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from trialflow.sources import records

FOLDER = "/root/testdata/sf0.001"
QUERIES = contract.queries()

needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the driver's tables")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_sound_document_is_parsed_once(spark):
    texts = {
        '{"a": {"b": 1}}': None, ' \n\t{} ': None, "[1]": "root_not_object", "null": "root_not_object", "1, 2": "invalid_json", "{}] , [{}": "invalid_json",
        "{}] x": "invalid_json", '{}} , {"r":{}': "invalid_json", '{},"m"] x': "invalid_json", '{"a":1,"a":1}': "duplicate_key",
        '{"a":{"b":1,"b":2}}': "duplicate_key", '{"a":NaN}': "non_finite_number", "": "invalid_json", None: "invalid_json",
    }
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    judged = docs.select("text", records.strict_fault(F.col("text")).alias("fault"))
    assert {r["text"]: r["fault"] for r in judged.collect()} == texts
    # one for every text, one for the rendering of a faulty one
    assert plan_of(judged).count("parseJson") <= 2


@needs_tables
def test_documents_land_compressed(spark):
    assert all(f.endswith(".json.gz") for f in QUERIES["s03_directory_scan"](spark, FOLDER).inputFiles())


@needs_tables
def test_only_chosen_runs_become_documents(spark):
    from queries.files import first_documents
    plan = plan_of(first_documents(spark, FOLDER))
    assert plan.index("Generate") < plan.index("LeftSemi")


@pytest.mark.parametrize("width", [1, 5, 16, 24])
def test_hamming_pairs_equal_brute_force_and_narrow_ones_are_looked_up(spark, width):
    import random
    from trialflow.operators import features as X
    draw = random.Random(width)
    texts = sorted({"".join(draw.choice("01") for _ in range(width)) for _ in range(60)})
    rows = [(f, i, t) for f in ("f", "g") for i, t in enumerate(texts[: 20 if f == "g" else None])]
    df = spark.createDataFrame(rows, "file string, pos long, bits string")
    dist = lambda x, y: sum(a != b for a, b in zip(x, y))
    pairs = {(f, i, j, dist(x, y)) for f, i, x in rows for g, j, y in rows if f == g and i != j and dist(x, y) <= 4}
    near = X.hamming_neighbours(df, width)
    assert sorted(map(tuple, near.collect())) == sorted(pairs)
    odd = {p for p in pairs if texts[p[1]].count("1") != texts[p[2]].count("1")}
    assert sorted(map(tuple, X.hamming_neighbours(df, width, unequal=True).collect())) == sorted(odd)
    degrees = {(r["file"], r["node"]): (r["s"], r["d"]) for r in X.string_degrees(df, width).collect()}
    assert degrees == {(f, i): tuple(sum(p[:2] == (f, i) and p[3] == k for p in pairs) for k in (2, 4)) for f, i, _ in rows}
    # a join of bands compares each pair within a band; a lookup does not
    assert ("l_band" in plan_of(near)) == (width == 24)


@needs_tables
def test_timing_csv_is_compressed(spark):
    assert all(f.endswith(".csv.gz") for f in QUERIES["s10_timing_csv"](spark, FOLDER).inputFiles())


@needs_tables
@pytest.mark.parametrize("name", ["a27_log_reduction", "a27_log_violations"])
def test_logs_are_dealt_out_before_their_lines_are_made(spark, name):
    from queries.base import pieces
    plan = plan_of(QUERIES[name](spark, FOLDER))
    # the one shuffle is of orders; events are reduced where they are made
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("REPARTITION_BY_NUM")
    parts = [pieces(spark, FOLDER, "orders", "o_orderkey", piece=p).rdd.getNumPartitions() for p in (1 << 15, 1 << 13)]
    assert parts[1] > 3 * parts[0] - 4 and parts[0] > 1


@needs_tables
@pytest.mark.parametrize("name, tables", [("j04_completeness", 2), ("a30_workload_entries", 1)])
def test_groups_of_instances_are_dealt_out_first(spark, name, tables):
    assert plan_of(QUERIES[name](spark, FOLDER)).count("REPARTITION_BY_NUM") == tables


@needs_tables
def test_campaign_rows_meet_their_plan_while_narrow(spark):
    plan = plan_of(QUERIES["f11_campaign_gate"](spark, FOLDER))
    assert plan.count("REPARTITION_BY_NUM") == 3 and "BroadcastHashJoin" not in plan
    assert "run_key" in plan[:plan.index("SortMergeJoin")] and "run_key" not in plan[plan.index("SortMergeJoin"):]


def ancestors(plan, text):
    """Nodes of a plan's text above the first line that holds ``text``."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    at = next(i for i, line in enumerate(lines) if text in line)
    least, found = depth[at], []
    for i in range(at - 1, -1, -1):
        if depth[i] < least:
            least = depth[i]
            found.append(lines[i])
    return found


@needs_tables
def test_trials_are_shuffled_once_for_their_evidence(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        above = ancestors(plan_of(QUERIES["j11_validation_evidence"](spark, FOLDER)), "AS trial_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum("Exchange hashpartitioning" in line for line in above) == 1


def test_evidence_of_unknown_and_null_inputs(spark):
    from trialflow.operators import audit
    trials = spark.createDataFrame(
        [("a", "h", "k"), ("b", "h", "z"), ("c", "x", "k"), ("d", None, "k"), ("e", "h", None), ("f", "t", "k")],
        "trial_id string, input_sha256 string, solver_key string").selectExpr("*", "1.0D AS reference_value", "'cpu' AS backend", "'s' AS artifact_sha256")
    validated = spark.createDataFrame([("h", "k", 1.0), ("t", "k", 1.0), ("t", "k", 2.0), (None, "k", 1.0)], "input_sha256 string, solver_key string, reference_value double")
    artifacts = spark.createDataFrame([("cpu", "s")], "backend string, artifact_sha256 string")
    got = {r["trial_id"]: r["errors"] for r in audit.validation_evidence(trials, validated, artifacts).collect()}
    assert got == {"a": [], "b": ["solver_not_validated"], "c": ["input_not_validated"], "d": ["input_not_validated"],
                   "e": ["solver_not_validated"], "f": ["validated_more_than_once"]}


@needs_tables
def test_members_of_small_groups_take_one_shuffle(spark):
    frame = QUERIES["a02_group_members"](spark, FOLDER)
    frame.collect()
    final = plan_of(frame).split("== Initial Plan ==")[0]
    # one of hashes and counts, one of rows
    assert final.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("hot_rows", [0, 3, 100])
def test_numbers_are_the_same_for_small_and_large_groups(spark, hot_rows):
    from trialflow.functions.scaled import numbered_groups
    sizes = {("a", 1): 7, ("a", None): 5, (None, 1): 3, ("b", 2): 1}
    rows = [(*k, (i * 11) % n) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(k, j, v) for k, j, v in rows], "k string, j int, v int")
    out = numbered_groups(df, ["k", "j"], ("v",), [F.floor(F.col("v") / 2)], "n", hot_rows)
    assert sorted((r["v"], r["n"]) for r in out.collect()) == sorted((v, v + 1) for *_, v in rows) and out.count() == len(rows)
    assert dict(out.dtypes)["n"] == "bigint"


@needs_tables
def test_attempts_are_accepted_among_raw_rows(spark):
    from queries.audit import accepted
    from queries.policy import balanced
    plan = plan_of(accepted(spark, FOLDER))
    # digests are taken of accepted rows only
    assert "sha2(" in plan and plan.index("sha2(") < plan.index("min_by(") and "sha2(" not in plan[plan.index("Exchange"):]
    # one shuffle picks the attempts, one by instance serves the groups and windows after it
    assert plan_of(balanced(spark, FOLDER)).count("Exchange hashpartitioning") == 2


def test_equal_attempts_fall_to_the_first_by_time_then_id(spark, tmp_path):
    import datetime
    from queries.audit import accepted
    day = lambda d: datetime.datetime(1995, 1, d)
    # instance 5: an earlier day wins; instance 6: of one day the id that sorts first as text wins
    rows = [(9, 5, 1, day(2)), (10, 5, 1, day(1)), (9, 6, 1, day(3)), (10, 6, 1, day(3)), (None, 6, 1, day(9))]
    spark.createDataFrame([(o, p, s, 2, 20.0, 1000.0, 0.01, 0.01, "R", "O", d) for o, p, s, d in rows], (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
        " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["problem_instance"]: r["trial_id"] for r in accepted(spark, str(tmp_path)).collect()}
    assert got == {"inst-5": "10-2-5-1-100000", "inst-6": "10-2-6-1-100000"}


def test_equal_training_rows_are_counted_before_the_first_level(spark, monkeypatch):
    from trialflow.operators import policy, trees
    written = []
    monkeypatch.setattr(trees, "materialized", lambda df: written.append(df.cache()) or written[-1])
    rows = spark.range(400).select(
        F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("family_id"), (F.col("id") % 5).cast("double").alias("log1p_n_configurations"),
        (F.col("id") % 2).cast("double").alias("backend_gpu"), (F.col("id") % 7).cast("double").alias(trees.TARGET))
    table = trees.grow_trees(rows, {"size_only": policy.SIZE_FEATURES}, max_depth=1).collect()
    # 5 sizes in each of two families, 40 rows of each
    assert written[0].count() == 10 and written[0].agg(F.sum("n")).first()[0] == 400
    roots = {r["fold_id"]: (r["sample_count"], r["value"]) for r in table if r["node_id"] == 0}
    assert roots.keys() == {"f0", "f1"}
    for fold, odd in (("f0", 1), ("f1", 0)):
        targets = [i % 7 for i in range(400) if i % 2 == odd]
        assert roots[fold][0] == len(targets) and abs(roots[fold][1] - sum(targets) / len(targets)) < 1e-8


@needs_tables
def test_rows_for_metrics_hold_no_digest_and_picks_are_dealt_out_before_theirs(spark):
    from queries.policy import balanced, modelled
    lean, full = plan_of(modelled(spark, FOLDER, provenance=False)), plan_of(balanced(spark, FOLDER))
    assert "sha2(" not in lean and "source_record_ids" not in lean
    # texts are compared only to pick the attempts
    assert "SortAggregate" not in lean[:lean.index("REPARTITION_BY_COL")]
    assert "sha2(" in full and "sha2(" not in full[full.index("REPARTITION_BY_COL"):]


@needs_tables
def test_lean_rows_are_the_full_ones(spark):
    from queries.policy import modelled
    lean = modelled(spark, FOLDER, provenance=False)
    full = modelled(spark, FOLDER).select(*lean.columns)
    assert lean.count() and not lean.exceptAll(full).count() and not full.exceptAll(lean).count()


def test_a_file_above_the_part_is_hashed_part_by_part(spark, tmp_path, monkeypatch):
    import gzip
    import hashlib
    import random
    from trialflow.sources import artifacts
    draw = random.Random(8)
    noise = draw.randbytes(300_000)
    contents = {
        "noise": noise, "ended": noise + b"\n", "returns": b"\r\n\n\r" * 50_000, "marked": b"\xef\xbb\xbf" + noise, "marked and ended": b"\xef\xbb\xbf" + noise + b"\n",
        "one line": b"\0" * 200_000, "part[1]={a,b}*": noise[::-1], "late line": b"\0" * 150_000 + b"\n" + noise[:90_000], "small": b"abc\n",
        "exact": noise[:1 << 16], "packed.gz": gzip.compress(noise[:90_000]),
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(artifacts, "PART", 1 << 16)
    expected = {(name, len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}

    def found():
        return [(r["path"].rsplit("/", 1)[-1], r["size_bytes"], r["sha256"]) for r in artifacts.inventory(spark, str(tmp_path)).collect()]

    got = found()
    assert set(got) == expected and len(got) == len(expected)
    assert artifacts._lines(spark, str(tmp_path / "noise")).rdd.getNumPartitions() == 5
    (tmp_path / "packed.gz").unlink()
    # as large as no file may be that is read whole
    monkeypatch.setattr(artifacts, "PART", 1 << 15)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 15))
    try:
        assert set(found()) == {e for e in expected if e[0] != "packed.gz"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


@needs_tables
def test_every_run_becomes_a_file_batch_after_batch(spark, tmp_path, monkeypatch):
    from queries import base, files
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_orderkey % 61 IN (1, 3, 8) AND l_linenumber = 2")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(files, "FILES_AT_ONCE", 40)
    folders = []
    monkeypatch.setattr(files, "scratch", lambda spark, name: folders.append(str(tmp_path / f"{name}-{len(folders)}")) or folders[-1])
    sound = {(r["trial_id"], r["backend"]) for r in base.runs(spark, str(tmp_path)).where("samples NOT BETWEEN 3 AND 8").collect()}
    got = [(r["path"], r["backend"]) for r in QUERIES["s03_file_per_record_scan"](spark, str(tmp_path)).collect()]
    assert set(got) == sound and len(got) == len(sound) < lines.count()
    written = [Path(f) for f in folders if "/files-" in f]
    assert len(written) == -(-lines.count() // 40) > 1 and not any(list(f.iterdir()) for f in written)


@pytest.mark.parametrize("mounted", [True, False])
def test_equal_paths_null_and_odd_ones_keep_their_files(spark, tmp_path, monkeypatch, mounted):
    if not mounted:
        monkeypatch.setattr(records, "_local", lambda spark, folder: None)
    rows = [("a", "x.json", "1"), ("a", "x.json", "2"), ("1992-01-02", "007", "3"), (None, "n", "4"), ("a=b:*?", "{[^]}", None), ("ü\\%41", "'\"#", "5")]
    folder = str(tmp_path / "docs")
    records.write_documents(spark.createDataFrame(rows, "path string, name string, text string"), folder)
    got = [tuple(r) for r in records.read_documents(spark, folder, base=folder).collect()]
    assert sorted(got, key=str) == sorted(((p, n, f"{t or ''}\n") for p, n, t in rows), key=str)
    records.remove_documents(spark, folder)
    assert not list((tmp_path / "docs").glob("group=*"))


@needs_tables
def test_landed_documents_give_way_to_the_next(spark, tmp_path, monkeypatch):
    from queries import base, files
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_orderkey % 61 IN (1, 3, 8)")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(files, "LANDED_AT_ONCE", 100)
    monkeypatch.setattr(files, "scratch", lambda spark, name: str(tmp_path / name))
    landed, parse = [], files.R.parse_documents
    monkeypatch.setattr(files.R, "parse_documents", lambda docs: landed.append((docs.count(), set(docs.inputFiles()))) or parse(docs))
    sound = {(r["trial_id"], r["backend"]) for r in base.runs(spark, str(tmp_path)).where("samples NOT BETWEEN 3 AND 8").collect()}
    got = [(r["path"], r["backend"]) for r in QUERIES["s03_directory_scan"](spark, str(tmp_path)).collect()]
    assert set(got) == sound and len(got) == len(sound)
    # every document lands, in files that are gone once they are read
    assert len(landed) == -(-lines.count() // 100) > 2 and sum(n for n, _ in landed) == lines.count() > 2 * max(n for n, _ in landed)
    assert all(f.endswith(".json.gz") for _, files_ in landed for f in files_) and not list((tmp_path / "documents").glob("*.gz"))


@needs_tables
@pytest.mark.parametrize("name", ["s01_record_scan", "s01_record_violations"])
def test_runs_are_dealt_out_in_small_parts_before_their_documents_are_made(spark, monkeypatch, name):
    from queries import files
    monkeypatch.setattr(files, "PART", 1 << 10)
    frame = QUERIES[name](spark, FOLDER)
    size = Path(f"{FOLDER}/lineitem.parquet").stat().st_size
    assert "REPARTITION_BY_NUM" in plan_of(frame) and frame.rdd.getNumPartitions() == -(-size // (1 << 10))
