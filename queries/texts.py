"""Bit strings, Hamming graphs, integral files, logs, samples."""

from pyspark.sql import functions as F

from queries.base import duck, load, pieces, register
from queries.timing import rounded
from trialflow.operators import features as X
from trialflow.operators import logs
from trialflow.session import materialized
from trialflow.sources import samples, texts

#: a vector of 64 elements gives four strings of its signs
BITS, PARTS = 16, 4
STRINGS_CTE = f"""raw AS (SELECT 'list-' || label AS file, vec_id * {PARTS} + part AS vec_id, """ + " || ".join(
    f"CASE WHEN embedding[part * {BITS} + {i}] > 0 THEN '1' ELSE '0' END" for i in range(1, BITS + 1)) + f""" AS bits FROM embeddings, (SELECT unnest(range({PARTS})) AS part)),
strings AS (SELECT file, bits, CAST(row_number() OVER (PARTITION BY file ORDER BY min(vec_id)) - 1 AS BIGINT) AS pos FROM raw GROUP BY file, bits)"""


def raw_strings(spark, sf_dir):
    signs = [F.concat(*[F.when(F.col("embedding")[p * BITS + i] > 0, "1").otherwise("0") for i in range(BITS)]) for p in range(PARTS)]
    rows = load(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode(F.array(*signs)).alias("part", "bits"))
    return rows.select(F.concat(F.lit("list-"), F.col("label").cast("string")).alias("file"), (F.col("vec_id") * PARTS + F.col("part")).alias("vec_id"), "bits")


def strings(spark, sf_dir):
    """Distinct masks of each list in first-seen order."""
    from trialflow.functions.scaled import numbered
    first = raw_strings(spark, sf_dir).groupBy("file", "bits").agg(F.min("vec_id").alias("v"))
    return numbered(first, ["file"], ("v",), [F.floor(F.col("v") / 65536)], "n").select(
        "file", (F.col("n") - 1).alias("pos"), "bits")


@register("s05_bitstring_scan", duck("""
SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY vec_id, part) - 1 AS BIGINT) AS pos, bits FROM (
 SELECT file, vec_id, 0 AS part, bits FROM raw UNION ALL SELECT file, vec_id, 1, reverse(bits) FROM raw WHERE vec_id % 3 = 0)""", STRINGS_CTE))
def s05(spark, sf_dir):
    lines = raw_strings(spark, sf_dir).select("file", F.col("vec_id").alias("pos"), F.concat(
        F.lit("  "), "bits", F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("\t "), F.reverse("bits"))).otherwise(" ")).alias("line"))
    return texts.bitstrings(lines)


@register("s05_bitstring_violations", duck("""
SELECT DISTINCT file, 'duplicate' AS rule FROM (SELECT file, bits FROM odd GROUP BY ALL HAVING count(*) > 1)
UNION SELECT file, 'not_binary' FROM odd WHERE NOT regexp_full_match(bits, '[01]+') UNION SELECT file, 'unequal_length' FROM odd GROUP BY file HAVING min(length(bits)) <> max(length(bits))
UNION SELECT file, 'unexpected_length' FROM odd GROUP BY file HAVING min(length(bits)) <> 16 OR max(length(bits)) <> 16""", STRINGS_CTE + """,
odd AS (SELECT file, CASE WHEN vec_id % 97 = 0 THEN 'x' || bits WHEN vec_id % 89 = 0 THEN bits || '0' ELSE bits END AS bits FROM raw)"""))
def s05_bad(spark, sf_dir):
    odd = raw_strings(spark, sf_dir).selectExpr(
        "file", "CASE WHEN vec_id % 97 = 0 THEN concat('x', bits) WHEN vec_id % 89 = 0 THEN concat(bits, '0') ELSE bits END AS bits")
    return X.bitstring_violations(odd, BITS)


@register("w07_ordered_position", duck("SELECT file, pos, bits FROM strings", STRINGS_CTE))
def w07(spark, sf_dir):
    return strings(spark, sf_dir)


STATS = """SELECT file, CAST(count(*) AS BIGINT) AS "count", CAST(count(DISTINCT bits) AS BIGINT) AS unique_count, CAST(max(length(bits)) AS BIGINT) AS bit_length, CAST(min(o) AS BIGINT) AS occupancy_min,
 CAST(max(o) AS BIGINT) AS occupancy_max, round(avg(o), 8) AS occupancy_mean, round(var_pop(o), 8) AS occupancy_variance FROM (SELECT *, length(replace(bits, '0', '')) AS o FROM raw) GROUP BY file"""


@register("a12_bitstring_statistics", duck(STATS, STRINGS_CTE))
def a12(spark, sf_dir):
    return rounded(X.bitstring_stats(raw_strings(spark, sf_dir)))


EDGES = STRINGS_CTE + """, edges AS (SELECT l.file, l.pos AS a, r.pos AS b, CAST(bit_count(xor(l.bits::BIT, r.bits::BIT)) AS BIGINT) AS dist
 FROM strings l JOIN strings r ON l.file = r.file AND l.pos <> r.pos)"""


@register("j08_hamming_join", duck("SELECT file, a, b, dist FROM edges WHERE dist <= 4", EDGES))
def j08(spark, sf_dir):
    return X.hamming_neighbours(materialized(strings(spark, sf_dir)), BITS)


@register("a14_degree_statistics", duck("""
SELECT file, CAST(count(*) AS BIGINT) AS determinants, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS unordered_pair_comparisons, CAST(sum(s) AS BIGINT) AS directed_single_edges, CAST(sum(d) AS BIGINT) AS directed_double_edges,
 CAST(min(s) AS BIGINT) AS single_degree_min, CAST(max(s) AS BIGINT) AS single_degree_max, round(avg(s), 8) AS single_degree_mean, CAST(min(d) AS BIGINT) AS double_degree_min, CAST(max(d) AS BIGINT) AS double_degree_max,
 round(avg(d), 8) AS double_degree_mean, round(sum(s) / (count(*) * (count(*) - 1) * 1e0), 8) AS single_edge_density, round(sum(d) / (count(*) * (count(*) - 1) * 1e0), 8) AS double_edge_density
FROM (SELECT n.file, n.pos, count(*) FILTER (dist = 2) AS s, count(*) FILTER (dist = 4) AS d FROM strings n LEFT JOIN edges e ON e.file = n.file AND e.a = n.pos GROUP BY ALL) GROUP BY file""", EDGES))
def a14(spark, sf_dir):
    nodes = materialized(strings(spark, sf_dir))
    return rounded(X.degree_stats(nodes, None, degrees=X.string_degrees(nodes, BITS)))


@register("f17_canonical_order", duck("""
SELECT file, CAST(count(*) AS BIGINT) AS inversions FROM (SELECT file, bits, lag(bits) OVER (PARTITION BY file ORDER BY pos) AS before FROM strings) WHERE before > bits GROUP BY 1""", STRINGS_CTE))
def f17(spark, sf_dir):
    return X.unsorted_files(materialized(strings(spark, sf_dir)))


SIZES = (8, 16, 32)


@register("j13_prefix_variants", duck("SELECT file, pos, bits, size FROM strings, (VALUES (8), (16), (32)) v(size) WHERE pos < size", STRINGS_CTE))
def j13(spark, sf_dir):
    return X.prefix_variants(strings(spark, sf_dir), SIZES)


@register("s13_workload_manifest", duck("""
SELECT file, size, CAST(count(*) AS BIGINT) AS line_count, CAST(count(*) * count(*) AS BIGINT) AS n_configurations, CAST(sum(length(bits) + 1) AS BIGINT) AS size_bytes,
 sha256(string_agg(bits || chr(10), '' ORDER BY pos)) AS sha256, count(*) = size AS complete FROM strings, (VALUES (8), (16), (32)) v(size) WHERE pos < size GROUP BY file, size""", STRINGS_CTE))
def s13(spark, sf_dir):
    return X.variant_manifest(X.prefix_variants(strings(spark, sf_dir), SIZES))


@register("f16_inventory_checks", duck("""
SELECT file, 'file_missing' AS rule FROM (VALUES ('list-none')) v(file)
UNION ALL SELECT file, 'count_differs' FROM (SELECT file, count(*) AS n FROM raw GROUP BY 1) WHERE file <> 'list-3'
UNION ALL SELECT file, 'duplicates' FROM raw GROUP BY 1 HAVING count(*) > count(DISTINCT bits)
UNION ALL SELECT file, 'occupancy_not_constant' FROM raw GROUP BY 1 HAVING min(length(replace(bits, '0', ''))) <> max(length(replace(bits, '0', '')))""", STRINGS_CTE))
def f16(spark, sf_dir):
    observed = X.bitstring_stats(raw_strings(spark, sf_dir))
    manifest = observed.select(
        "file", F.when(F.col("file") == "list-3", F.col("count")).otherwise(F.lit(-1)).cast("bigint").alias("count"), "bit_length",
    ).unionByName(spark.range(1).select(F.lit("list-none").alias("file"), F.lit(4).cast("bigint").alias("count"), F.lit(BITS).cast("bigint").alias("bit_length")))
    return X.inventory_rules(observed, manifest)


# -- integral files: body lines from orders, header lines from nation -----------

NFILES = 20


def integral_lines(spark, sf_dir):
    body = load(spark, sf_dir, "orders").select(
        F.concat(F.lit("ints-"), (F.col("o_custkey") % NFILES).cast("string")).alias("file"), (F.col("o_orderkey") + 10).alias("pos"),
        F.concat_ws(
            "  ", F.lit(""), F.concat((F.col("o_totalprice").cast("bigint") - 250000).cast("string"), F.lit(".25D-02")),
            *[(F.col("o_orderkey") % m).cast("string") for m in (3, 5)],
            *[F.when(F.col("o_orderkey") % 2 == 0, "0").otherwise((F.col("o_orderkey") % m).cast("string")) for m in (4, 7)]).alias("line"))
    norb = F.col("n_nationkey") % 3 + 6
    head = F.array(
        F.concat(F.lit("&FCI NORB= "), norb.cast("string"), F.lit(",NELEC=6,MS2=0,")),
        F.concat(F.lit(" ORBSYM="), F.repeat(F.lit("1,"), norb)), F.lit("  ISYM=1,"), F.lit(" &END"))
    headers = load(spark, sf_dir, "nation").select(
        F.concat(F.lit("ints-"), F.col("n_nationkey").cast("string")).alias("file"), F.posexplode(head).alias("pos", "line"))
    return body.unionByName(headers.where("NOT (file = 'ints-4' AND pos = 3)"))


INTEGRALS = f"""lines AS (SELECT o_custkey % {NFILES} AS f, o_orderkey + 10 AS pos, ((CAST(trunc(o_totalprice) AS BIGINT) - 250000) + CASE WHEN CAST(trunc(o_totalprice) AS BIGINT) < 250000 THEN -0.25e0 ELSE 0.25e0 END) / 1e2 AS value,
 o_orderkey % 3 AS i, o_orderkey % 5 AS j, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 4 END AS k, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey % 7 END AS l FROM orders WHERE o_custkey % {NFILES} <> 4),
heads AS (SELECT CAST(n_nationkey AS BIGINT) AS f, CAST(n_nationkey % 3 + 6 AS BIGINT) AS norb FROM nation WHERE n_nationkey <> 4),
shaped AS (SELECT *, CASE WHEN i = 0 AND j = 0 AND k = 0 AND l = 0 THEN 'core' WHEN i > 0 AND j > 0 AND k = 0 AND l = 0 THEN 'one_electron' WHEN i > 0 AND j > 0 AND k > 0 AND l > 0 THEN 'two_electron' ELSE 'invalid' END AS shape
 FROM lines JOIN heads USING (f) WHERE greatest(i, j, k, l) <= norb)"""


def parsed(spark, sf_dir):
    headers, body, bad = X.split_integral_lines(integral_lines(spark, sf_dir))
    good, bad_headers = X.parse_headers(headers)
    rows, bad_rows = X.parse_integrals(body, good)
    return good, rows, bad.unionByName(bad_headers), bad_rows


@register("s06_integral_scan", duck("SELECT 'ints-' || f AS file, pos, round(value, 6) AS value, i, j, k, l, shape FROM shaped WHERE shape <> 'invalid'", INTEGRALS))
def s06(spark, sf_dir):
    return parsed(spark, sf_dir)[1].withColumn("value", F.round("value", 6))


@register("s06_integral_violations", duck("SELECT 'ints-' || f AS file, pos, 'index_shape' AS rule FROM shaped WHERE shape = 'invalid'", INTEGRALS))
def s06_bad(spark, sf_dir):
    return parsed(spark, sf_dir)[3]


@register("p17_header_validation", duck("""
SELECT 'ints-' || n_nationkey AS file, CASE n_nationkey WHEN 4 THEN 'namelist_unterminated' ELSE 'namelist_not_first' END AS rule FROM nation WHERE n_nationkey IN (3, 4)""", INTEGRALS))
def p17(spark, sf_dir):
    """A text line before the namelist of one file, a blank one before that of another."""
    early = load(spark, sf_dir, "nation").where("n_nationkey IN (3, 5)").select(
        F.concat(F.lit("ints-"), F.col("n_nationkey").cast("string")).alias("file"), F.lit(-1).cast("bigint").alias("pos"),
        F.when(F.col("n_nationkey") == 3, "written by hand &FCI").otherwise("  ").alias("line"))
    headers, _, bad = X.split_integral_lines(integral_lines(spark, sf_dir).unionByName(early))
    return bad.unionByName(X.parse_headers(headers)[1])


@register("a13_integral_statistics", duck("""
SELECT 'ints-' || f AS file, norb, CAST(count(*) AS BIGINT) AS integral_records, CAST(count(*) FILTER (shape = 'core') AS BIGINT) AS core_integrals, CAST(count(*) FILTER (shape = 'one_electron') AS BIGINT) AS one_electron_integrals,
 CAST(count(*) FILTER (shape = 'two_electron') AS BIGINT) AS two_electron_integrals, CAST(count(*) FILTER (value = 0) AS BIGINT) AS exact_zero_integrals, round(sum(abs(value)), 4) AS sum_abs, round(max(abs(value)), 6) AS max_abs,
 (norb * (norb + 1) // 2) * (norb * (norb + 1) // 2 + 1) // 2 AS slots FROM shaped WHERE shape <> 'invalid' GROUP BY f, norb""", INTEGRALS))
def a13(spark, sf_dir):
    good, rows, _, _ = parsed(spark, sf_dir)
    return X.integral_stats(rows, good).select(
        "file", "norb", "integral_records", "core_integrals", "one_electron_integrals", "two_electron_integrals", "exact_zero_integrals",
        F.round("sum_abs_integrals", 4).alias("sum_abs"), F.round("max_abs_integral", 6).alias("max_abs"),
        F.col("compact_two_electron_slots").alias("slots"))


# -- solver logs: one log per order ---------------------------------------------


def log_lines(orders):
    k = F.col("o_orderkey")
    lines = F.array_compact(F.array(
        F.when(k % 2 == 0, " rank 0 has device 0 "), F.lit("noise line"),
        F.lit("Elapsed time for helper construction 0.5 (sec)"), F.concat(F.lit("Elapsed time for init "), (k % 8 / 4).cast("string"), F.lit(" (sec)")),
        F.lit("Davidson iteration 0.1 (tol=1.5e-1): "), F.when(k % 5 != 0, F.concat(F.lit(" Davidson iteration 1."), (k % 4).cast("string"), F.lit(" (tol=2.5e-9): x"))),
        F.concat(F.lit("Elapsed time for davidson  "), (F.col("o_custkey") / 4).cast("string"), F.lit(" (sec) ")),
        F.concat(F.lit("Sample-based diagonalization: Energy = -"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")),
        F.when(k % 7 == 0, F.lit("Sample-based diagonalization: Energy = -1.0")),
        F.concat(F.lit("Sample-based diagonalization: density = [0.5, 1.25, "), (k % 16 / 16).cast("string"), F.when(k % 3 == 0, "").otherwise("]")),
        F.when(k % 11 == 0, F.lit("Elapsed time for mult 1.0 (sec)")), F.when(k % 22 == 0, F.lit("Elapsed time for mult 2.0 (sec)"))))
    return orders.select(k.alias("file"), F.posexplode(lines).alias("pos", "line"))


@register("s07_log_scan", duck("""
SELECT file, kind, round(value, 6) AS value FROM (
 SELECT o_orderkey AS file, 'device' AS kind, NULL::DOUBLE AS value FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'helper_construction_time_s', 0.5e0 FROM orders
 UNION ALL SELECT o_orderkey, 'initial_state_time_s', (o_orderkey % 8) / 4e0 FROM orders UNION ALL SELECT o_orderkey, 'iteration', 0.15e0 FROM orders UNION ALL SELECT o_orderkey, 'iteration', 2.5e-9 FROM orders WHERE o_orderkey % 5 <> 0
 UNION ALL SELECT o_orderkey, 'solver_time_s', o_custkey / 4e0 FROM orders UNION ALL SELECT o_orderkey, 'energy', -o_totalprice FROM orders UNION ALL SELECT o_orderkey, 'energy', -1e0 FROM orders WHERE o_orderkey % 7 = 0
 UNION ALL SELECT o_orderkey, 'density', NULL FROM orders UNION ALL SELECT o_orderkey, 'post_solver_matvec_time_s', 1e0 FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT o_orderkey, 'post_solver_matvec_time_s', 2e0 FROM orders WHERE o_orderkey % 22 = 0)"""))
def s07(spark, sf_dir):
    return rounded(logs.parse_logs(log_lines(load(spark, sf_dir, "orders"))).select("file", "kind", "value"), 6)


def log_events(spark, sf_dir):
    """Events of whole logs: orders are dealt out by log first, a dozen lines come of each."""
    return logs.parse_logs(log_lines(pieces(spark, sf_dir, "orders", "o_orderkey", piece=1 << 20)))


@register("a27_log_reduction", duck("""
SELECT o_orderkey AS file, CASE WHEN o_orderkey % 5 = 0 THEN 0.15e0 ELSE 2.5e-9 END AS final_residual, o_orderkey % 5 <> 0 AS converged, CASE WHEN o_orderkey % 5 = 0 THEN CAST(1 AS BIGINT) ELSE 2 END AS iteration_records,
 CASE WHEN o_orderkey % 5 = 0 THEN CAST(0 AS BIGINT) ELSE 1 END AS final_restart_index, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE o_orderkey % 4 END AS final_subspace_index, -o_totalprice AS energy,
 round(0.5e0 + 1.25e0 + (o_orderkey % 16) / 16e0, 6) AS density_sum, o_orderkey % 3 = 0 AS density_bracket_repaired, o_orderkey % 2 = 0 AS device_assignment_seen, round(0.5e0 + (o_orderkey % 8) / 4e0, 6) AS initialization_time_s
FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 22 <> 0"""))
def a27(spark, sf_dir):
    good, _ = logs.reduce_logs(log_events(spark, sf_dir), 1e-8)
    return good.select(
        "file", "final_residual", "converged", "iteration_records", "final_restart_index", "final_subspace_index", "energy",
        F.round(F.aggregate("density", F.lit(0.0), lambda a, x: a + x), 6).alias("density_sum"), "density_bracket_repaired",
        "device_assignment_seen", F.round("initialization_time_s", 6).alias("initialization_time_s"))


@register("a27_log_violations", duck("""
SELECT o_orderkey AS file, 'energy_count' AS rule FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'post_solver_matvec_time_s_repeated' FROM orders WHERE o_orderkey % 22 = 0"""))
def a27_bad(spark, sf_dir):
    return logs.reduce_logs(log_events(spark, sf_dir), 1e-8)[1]


# -- resource samples: one sample per event, one trial per user ------------------


def sample_lines(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("trial-"), F.col("user_id").cast("string")).alias("trial_id"), F.concat_ws(
            ",", (F.col("event_id") / 8).cast("string"), F.col("value").cast("string"),
            F.when(F.col("event_type") == "error", "").otherwise((F.col("value") * 2).cast("string")),
            F.when(F.col("event_type") == "click", "").otherwise("50.0"), F.lit("61.5"), F.lit("")).alias("line"))


SAMPLES_SQL = """samples AS (SELECT 'trial-' || user_id AS trial_id, event_id / 8e0 AS elapsed_s, value AS host_rss_mib, CASE WHEN event_type <> 'error' THEN value * 2 END AS gpu_memory_mib,
 CASE WHEN event_type <> 'click' THEN 50e0 END AS gpu_utilization_pct, 61.5e0 AS gpu_temperature_c, NULL::DOUBLE AS gpu_power_w FROM events)"""


@register("s04_sample_scan", duck("SELECT * FROM samples", SAMPLES_SQL))
def s04(spark, sf_dir):
    return samples.parse_samples(sample_lines(spark, sf_dir))


@register("s04_sample_file_scan", duck("SELECT * FROM samples", SAMPLES_SQL))
def s04_files(spark, sf_dir):
    """Samples written as one CSV file per trial and read back from the files."""
    from queries.contracts import scratch
    folder = scratch(spark, "samples")
    samples.write_samples(samples.parse_samples(sample_lines(spark, sf_dir)), folder)
    return samples.read_sample_folders(spark, folder)


@register("a26_trial_peaks", duck("""
SELECT trial_id, CAST(count(*) AS BIGINT) AS samples, max(host_rss_mib) AS peak_host_rss_mib, max(gpu_memory_mib) AS peak_gpu_memory_mib, max(elapsed_s) AS last_elapsed_s, bool_and(host_rss_mib IS NOT NULL) AS host_complete,
 bool_or(gpu_memory_mib IS NOT NULL) AS gpu_process_observed, bool_and(gpu_utilization_pct IS NOT NULL) AS gpu_complete FROM samples GROUP BY 1""", SAMPLES_SQL))
def a26(spark, sf_dir):
    return samples.trial_peaks(samples.parse_samples(sample_lines(spark, sf_dir)))
