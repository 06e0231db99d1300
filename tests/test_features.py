"""Bit strings, Hamming graphs, integral files, logs, memory arithmetic."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trialflow.functions import memory
from trialflow.operators import features as X
from trialflow.operators import logs
from trialflow.sources import texts


def strings(spark, lists):
    rows = [(f, i, b) for f, bits in lists.items() for i, b in enumerate(bits)]
    return spark.createDataFrame(rows, "file string, pos long, bits string")


@pytest.mark.parametrize("width", [8, 18, 70, 130])
def test_hamming_join_equals_all_pairs(spark, width):
    rng = random.Random(width)
    base = "".join(rng.choice("01") for _ in range(width))
    made = {base}
    while len(made) < 40:
        word = list(rng.choice(sorted(made)))
        for i in rng.sample(range(width), rng.choice([1, 2, 3, 4])):
            word[i] = "1" if word[i] == "0" else "0"
        made.add("".join(word))
    bits = sorted(made)
    df = strings(spark, {"f": bits})
    edges = X.hamming_neighbours(df, width)
    got = sorted((r["a"], r["b"], r["dist"]) for r in edges.collect())
    expected = []
    for a, b in itertools.permutations(range(len(bits)), 2):
        d = sum(x != y for x, y in zip(bits[a], bits[b]))
        if d <= 4:
            expected.append((a, b, d))
    assert got == sorted(expected)
    row = X.degree_stats(df, edges).first()
    single = [sum(1 for a, _, d in expected if a == i and d == 2) for i in range(len(bits))]
    double = [sum(1 for a, _, d in expected if a == i and d == 4) for i in range(len(bits))]
    assert row["directed_single_edges"] == sum(single) and row["directed_double_edges"] == sum(double)
    assert (row["single_degree_min"], row["single_degree_max"]) == (min(single), max(single))
    assert (row["double_degree_min"], row["double_degree_max"]) == (min(double), max(double))


def test_pair_budget(spark):
    df = strings(spark, {"f": ["0011", "0101", "1001", "0110"]})
    assert X.pair_counts(df, 5).where("within_budget").count() == 0
    row = X.pair_counts(df, 6).first()
    assert row["unordered_pair_comparisons"] == 6
    stats = X.degree_stats(df, X.hamming_neighbours(df, 4, budget=6), 6).first()
    s, d = stats["directed_single_edges"], stats["directed_double_edges"]
    work = spark.range(1).select(memory.work_proxy(*[F.lit(x) for x in (4, 4, s, d, s, d)]).alias("w")).first()["w"]
    assert work == 16 + 2 * 4 * (s + d) + s * s
    beyond = X.degree_stats(df, X.hamming_neighbours(df, 4, budget=5), 5).first()
    assert beyond["determinants"] == 4 and not beyond["within_budget"] and beyond["single_degree_max"] is None


def test_isolated_strings_count_with_degree_zero(spark):
    df = strings(spark, {"f": ["00000000", "11111111", "00000011"]})
    row = X.degree_stats(df, X.hamming_neighbours(df, 8)).first()
    assert (row["single_degree_min"], row["single_degree_max"], row["directed_single_edges"]) == (0, 1, 2)
    lonely = strings(spark, {"f": ["0000"]})
    row = X.degree_stats(lonely, X.hamming_neighbours(lonely, 4)).first()
    assert (row["single_edge_density"], row["single_degree_max"]) == (0.0, 0)


def test_guard_and_caps(spark):
    mib = 1024 * 1024
    row = spark.range(1).select(
        memory.guard(F.lit(0).cast("bigint")).alias("a"), memory.guard(F.lit(5178984).cast("bigint")).alias("b"),
        memory.guard(F.lit(48694708).cast("bigint")).alias("c"),
        memory.gpu_cap(F.lit(100 * 1024 * mib)).alias("d"), memory.host_cap(F.lit(11)).alias("e"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (512 * mib, 576 * mib, 640 * mib)
    assert (row["d"], row["e"]) == (20 * 1024 * mib, 8)


def test_memory_estimate_is_an_upper_bound_without_edges(spark):
    fields = "n_orbitals long, n_alpha long, n_beta long, integral_records long, file_bytes long, alpha_single long, alpha_double long, beta_single long, beta_double long"
    df = spark.createDataFrame([(4, 6, 6, 9, 100, 12, 6, 12, 6), (4, 6, 6, 9, 100, None, None, None, None)], fields)
    known, bound = memory.memory_estimate(df, bit_length=20, max_block=10, iterations=6).orderBy("helper_is_upper_bound").collect()
    assert known["helper_is_upper_bound"] is False and bound["helper_is_upper_bound"] is True
    assert bound["gpu_known_bytes"] >= known["gpu_known_bytes"] and bound["helper_host_bytes"] > known["helper_host_bytes"]
    assert known["integral_bytes"] == 8 * (6 * 16 + 55) and known["local_configurations"] == 36
    with pytest.raises(ValueError):
        memory.memory_estimate(df, bit_length=20, max_block=1, iterations=1, method=1)


def test_lines_keep_file_order_across_splits(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{i} x{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = texts.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(lines) == 5003
    for r in lines:
        name = r["file"].rsplit("/", 1)[1][0]
        assert r["line"] == f"{name}{r['pos']} x{r['pos']}"


def test_bitstring_tokens_and_violations(spark, tmp_path):
    (tmp_path / "d.txt").write_text("0011 0101\n\n  1100\n")
    rows = texts.read_bitstrings(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["bits"]) for r in rows] == [(0, "0011"), (1, "0101"), (2, "1100")]
    df = strings(spark, {"dup": ["01", "01"], "len": ["01", "011"], "text": ["0a", "01"], "ok": ["01", "10"]})
    found = {(r["file"], r["rule"]) for r in X.bitstring_violations(df).collect()}
    assert found == {("dup", "duplicate"), ("len", "unequal_length"), ("text", "not_binary")}
    stats = {r["file"]: r for r in X.bitstring_stats(df.where("file = 'len'")).collect()}["len"]
    assert (stats["occupancy_min"], stats["occupancy_max"], stats["occupancy_mean"], stats["occupancy_variance"]) == (1, 2, 1.5, 0.25)


HEADER = ["&FCI NORB=2,NELEC=2,MS2=0,", " ORBSYM=1,", "1, ISYM=1 /"]


def integral_files(spark, files):
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, pos long, line string")


def test_integral_file(spark):
    lines = integral_files(spark, {"f": HEADER + [" 0.5D+01 1 1 1 1", "-2.0 2 1 0 0", "", "0.0 0 0 0 0", "1.0 1 0 0 0", "x 1 1 1 1", "1.0 3 1 1 1", "1 2 3"]})
    headers, body, bad = X.split_integral_lines(lines)
    good, bad_headers = X.parse_headers(headers)
    assert bad.count() == 0 and bad_headers.count() == 0
    h = good.first()
    assert (h["norb"], h["nelec"], h["ms2"], h["isym"], h["orbsym"]) == (2, 2, 0, 1, [1, 1])
    rows, bad_rows = X.parse_integrals(body, good)
    assert {(r["pos"], r["rule"]) for r in bad_rows.collect()} == {
        (7, "index_shape"), (8, "value_not_finite"), (9, "index_out_of_range"), (10, "field_count")}
    s = X.integral_stats(rows, good).first()
    assert (s["integral_records"], s["core_integrals"], s["one_electron_integrals"], s["two_electron_integrals"]) == (3, 1, 1, 1)
    assert (s["exact_zero_integrals"], s["sum_abs_integrals"], s["max_abs_integral"]) == (1, 7.0, 5.0)
    assert (s["compact_two_electron_slots"], s["source_integral_doubles"]) == (6, 30)


@pytest.mark.parametrize("line, rule", [
    ("&FCI NORB=0,NELEC=0,MS2=0,ORBSYM=1,ISYM=1 &END", "norb_not_positive"),
    ("&FCI NORB=1,NELEC=3,MS2=1,ORBSYM=1,ISYM=1 &END", "nelec_out_of_range"),
    ("&FCI NORB=2,NELEC=2,MS2=1,ORBSYM=1,1,ISYM=1 &END", "nelec_ms2_inconsistent"),
    ("&FCI NORB=2,NELEC=2,MS2=0,ORBSYM=1,ISYM=1 &END", "orbsym_length"),
    ("&FCI NORB=2,NELEC=2,MS2=0,ORBSYM=1,1 &END", "ISYM_missing"),
    ("&FCI NORB=2,NORB=2,NELEC=2,MS2=0,ORBSYM=1,1,ISYM=1 &END", "NORB_repeated"),
    ("&FCI NORB=a,NELEC=2,MS2=0,ORBSYM=1,1,ISYM=1 &END", "NORB_not_integer"),
])
def test_header_contract(spark, line, rule):
    headers, _, _ = X.split_integral_lines(integral_files(spark, {"f": [line, "1.0 1 1 1 1"]}))
    assert rule in {r["rule"] for r in X.parse_headers(headers)[1].collect()}


def test_missing_or_open_header(spark):
    _, _, bad = X.split_integral_lines(integral_files(spark, {"a": ["1.0 1 1 1 1"], "b": ["&FCI NORB=1"]}))
    assert {(r["file"], r["rule"]) for r in bad.collect()} == {("a", "namelist_missing"), ("b", "namelist_unterminated")}


LOG = [
    "rank 0 has device 0", "Elapsed time for helper construction 0.25 (sec)", "Elapsed time for init 0.5 (sec)",
    "Davidson iteration 0.1 (tol=0.5): e", "  Davidson iteration 4.9 (tol=1e-9): e", "Elapsed time for davidson 2.0 (sec)",
    "Sample-based diagonalization: Energy = -7.5", "Sample-based diagonalization: density = [0.5, 1.5",
]


def log_lines(spark, logs_):
    rows = [(f, i, line) for f, lines in logs_.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, pos long, line string")


def test_log_reduction(spark):
    good, bad = logs.reduce_logs(logs.parse_logs(log_lines(spark, {"l": LOG})), 1e-8)
    r = good.first()
    assert (r["final_restart_index"], r["final_subspace_index"], r["final_residual"], r["converged"]) == (4, 9, 1e-9, True)
    assert (r["density"], r["density_bracket_repaired"], r["initialization_time_s"], r["energy"]) == ([0.5, 1.5], True, 0.75, -7.5)
    assert r["device_assignment_seen"] and r["measurement_time_s"] is None and bad.count() == 0


def test_log_violations(spark):
    cases = {
        "none": ["nothing"], "two": LOG + ["Sample-based diagonalization: Energy = 1"], "nodev": LOG[1:],
        "bad": LOG[:-1] + ["Sample-based diagonalization: density = [0.5, [1]"], "rep": LOG + [LOG[1]],
    }
    lines = log_lines(spark, cases)
    names = spark.createDataFrame([(f, 2) for f in cases], "file string, expected_orbitals int")
    _, bad = logs.reduce_logs(logs.parse_logs(lines), 1e-8, names, require_device=True)
    found = {(r["file"], r["rule"]) for r in bad.collect()}
    assert {("none", "no_iteration"), ("none", "energy_count"), ("two", "energy_count"), ("nodev", "device_line_missing"),
            ("bad", "density_malformed"), ("rep", "helper_construction_time_s_repeated")} <= found


def test_long_lists_keep_their_pairs(spark):
    texts = [format(i * 2654435761 % (1 << 24), "024b") for i in range(1500)]
    df = spark.createDataFrame([("big", i, t) for i, t in enumerate(texts)], "file string, pos bigint, bits string")
    near = X.hamming_neighbours(df, 24)
    values = [int(t, 2) for t in texts]
    want = {d: sum(1 for a in values for b in values if (a ^ b).bit_count() == d) for d in (2, 4)}
    stats = X.degree_stats(df, near).first()
    assert (stats["directed_single_edges"], stats["directed_double_edges"]) == (want[2], want[4])


@pytest.mark.parametrize("width, n, constant", [(64, 3000, True), (70, 400, True), (16, 600, False), (5, 32, False)])
def test_degrees_by_deletion_equal_all_pairs(spark, width, n, constant):
    rng = random.Random(width)
    found = set()
    while len(found) < n:
        bits = ["0"] * width
        # few electrons above a common core, as in a real list
        for i in rng.sample(range(width), 3 if constant and width > 16 else rng.randint(0, width)):
            bits[i] = "1"
        found.add("".join(bits))
    strings = sorted(found)
    numbers = [int(b, 2) for b in strings]
    want = {}
    for i, x in enumerate(numbers):
        near = [(x ^ y).bit_count() for y in numbers]
        want[i] = (near.count(2), near.count(4))
    df = spark.createDataFrame([("f", i, b) for i, b in enumerate(strings)] + [("g", 0, "0" * width)], "file string, pos bigint, bits string")
    got = {(r["file"], r["node"]): (r["s"], r["d"]) for r in X.string_degrees(df, width).collect()}
    assert got == {("f", i): v for i, v in want.items()} | {("g", 0): (0, 0)}
    row = X.degree_stats(df, None, degrees=X.string_degrees(df, width)).where("file = 'f'").first()
    assert row["directed_single_edges"] == sum(s for s, _ in want.values()) and row["double_degree_max"] == max(d for _, d in want.values())
