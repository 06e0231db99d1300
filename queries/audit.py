"""Plans, joins, reconciliation, set checks, temporal checks."""

from pyspark.sql import functions as F

from queries.base import DUCK_ACCEPTED, DUCK_RUNS, ELIGIBLE, RUNS_SQL, duck, eligible_runs, instance_runs, load, pieces, register, runs, spark_text
from queries.timing import CLASSIFIED, GROUPS, ROWS, grouped, rounded, rows
from trialflow.functions.scaled import keyed_join
from trialflow.functions.stats import pct
from trialflow.operators import audit
from trialflow.operators import timing as T
from trialflow.operators.rules import check
from trialflow.plans import grid

# -- plans: campaigns are the 25 families of part, candidates and protocol per campaign

PLAN_SQL = """workloads AS (SELECT concat('fam-', CAST(p_partkey % 25 AS STRING)) AS campaign, concat('inst-', CAST(p_partkey AS STRING)) AS workload, p_partkey AS position FROM part),
protocol AS (SELECT concat('fam-', CAST(n_nationkey AS STRING)) AS campaign, CAST(n_nationkey % 2 AS BIGINT) AS warmups, CAST(3 AS BIGINT) AS repetitions, CAST(1729 AS BIGINT) AS seed FROM nation),
candidates AS (SELECT concat('fam-', CAST(n_nationkey AS STRING)) AS campaign, unnest(['cpu-16', 'gpu-1']) AS candidate FROM nation),
phases AS (SELECT campaign, seed, 'warmup' AS phase, 0 AS phase_order, unnest(generate_series(0, warmups - 1)) AS repetition FROM protocol
 UNION ALL SELECT campaign, seed, 'measured', 1, unnest(generate_series(0, repetitions - 1)) FROM protocol),
plan AS (SELECT w.campaign, workload, position, candidate, phase, phase_order, repetition,
  sha256(concat_ws(chr(0), 'order-v1', CAST(seed AS STRING), w.campaign, workload, phase, CAST(repetition AS STRING), candidate)) AS order_key
 FROM workloads w JOIN candidates USING (campaign) JOIN phases p ON p.campaign = w.campaign),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY campaign, phase, repetition, workload ORDER BY order_key, candidate) AS BIGINT) AS slot_position FROM plan)"""


def plan(spark, sf_dir):
    nation = load(spark, sf_dir, "nation").withColumn("campaign", F.concat(F.lit("fam-"), F.col("n_nationkey").cast("string")))
    workloads = pieces(spark, sf_dir, "part", "p_partkey", piece=1 << 18).select(
        F.concat(F.lit("fam-"), (F.col("p_partkey") % 25).cast("string")).alias("campaign"),
        F.concat(F.lit("inst-"), F.col("p_partkey").cast("string")).alias("workload"), F.col("p_partkey").alias("position"))
    candidates = nation.select("campaign", F.explode(F.array(F.lit("cpu-16"), F.lit("gpu-1"))).alias("candidate"))
    protocol = nation.select(
        "campaign", (F.col("n_nationkey") % 2).cast("bigint").alias("warmups"), F.lit(3).cast("bigint").alias("repetitions"),
        F.lit(1729).cast("bigint").alias("seed"))
    return grid.expand_plan(workloads, candidates, protocol)


@register("j09_trial_grid", duck("SELECT campaign, workload, candidate, phase, repetition FROM plan", PLAN_SQL))
def j09(spark, sf_dir):
    return plan(spark, sf_dir).select("campaign", "workload", "candidate", "phase", "repetition")


@register("o02_seeded_shuffle", duck("SELECT workload, candidate, phase, repetition, order_key, slot_position FROM ordered", PLAN_SQL))
def o02(spark, sf_dir):
    return grid.shuffled(plan(spark, sf_dir)).select("workload", "candidate", "phase", "repetition", "order_key", "slot_position")


@register("o03_first_trials", duck("""
SELECT workload, candidate, phase, repetition FROM ordered ORDER BY campaign, phase_order, repetition, position, slot_position, candidate LIMIT 200""", PLAN_SQL))
def o03(spark, sf_dir):
    return grid.first_trials(grid.shuffled(plan(spark, sf_dir)), 200).select("workload", "candidate", "phase", "repetition")


@register("o01_protocol_order", duck("""
SELECT family_id, candidate_name, wall_time_s_max, CASE candidate_name WHEN 'gpu-1' THEN CAST(1 AS BIGINT) WHEN 'cpu-16' THEN 2 END AS candidate_name_order
FROM groups ORDER BY candidate_name_order, family_id, problem_instance""", GROUPS))
def o01(spark, sf_dir):
    return grid.protocol_order(grouped(spark, sf_dir), "candidate_name", ("gpu-1", "cpu-16"), "family_id", "problem_instance").select(
        "family_id", "candidate_name", "wall_time_s_max", "candidate_name_order")


KEYED = """, planned AS (SELECT workload AS problem_instance, candidate AS candidate_name, phase, repetition FROM plan),
done AS (SELECT problem_instance, candidate_name, phase, CAST(repetition AS BIGINT) AS repetition FROM runs)"""


def done(spark, sf_dir):
    return instance_runs(spark, sf_dir).select("problem_instance", "candidate_name", "phase", F.col("repetition").cast("bigint").alias("repetition"))


def planned(spark, sf_dir):
    return plan(spark, sf_dir).select(
        F.col("workload").alias("problem_instance"), F.col("candidate").alias("candidate_name"), "phase", "repetition")


PLAN_KEYS = ["problem_instance", "candidate_name", "phase", "repetition"]


@register("j04_completeness", duck("""
SELECT *, CASE WHEN planned = 0 THEN 'unplanned' WHEN recorded = 0 THEN 'missing' ELSE 'duplicate' END AS kind FROM (
 SELECT problem_instance, candidate_name, phase, repetition, coalesce(p.n, 0) AS planned, coalesce(a.n, 0) AS recorded
 FROM (SELECT *, count(*) AS n FROM planned GROUP BY ALL) p FULL JOIN (SELECT *, count(*) AS n FROM done GROUP BY ALL) a
 USING (problem_instance, candidate_name, phase, repetition)) WHERE planned = 0 OR recorded = 0 OR recorded > 1""", PLAN_SQL, DUCK_RUNS + KEYED))
def j04(spark, sf_dir):
    return grid.completeness(planned(spark, sf_dir), done(spark, sf_dir), PLAN_KEYS)


RESUME = KEYED + """, pid AS (SELECT concat_ws('/', problem_instance, candidate_name, phase, CAST(repetition AS STRING)) AS trial_id FROM planned),
did AS (SELECT DISTINCT concat_ws('/', problem_instance, candidate_name, phase, CAST(repetition AS STRING)) AS trial_id FROM done)"""


def ids(df):
    return df.select(F.concat_ws("/", "problem_instance", "candidate_name", "phase", F.col("repetition").cast("string")).alias("trial_id"))


@register("j12_resume_pending", duck("SELECT trial_id FROM pid WHERE trial_id NOT IN (SELECT trial_id FROM did)", PLAN_SQL, DUCK_RUNS + RESUME))
def j12(spark, sf_dir):
    return grid.pending(ids(planned(spark, sf_dir)), ids(done(spark, sf_dir)))


@register("j12_resume_reused", duck("SELECT trial_id FROM pid WHERE trial_id IN (SELECT trial_id FROM did)", PLAN_SQL, DUCK_RUNS + RESUME))
def j12_reused(spark, sf_dir):
    return grid.reused(ids(planned(spark, sf_dir)), ids(done(spark, sf_dir)))


@register("a25_status_histogram", duck("SELECT status, CAST(count(*) AS BIGINT) AS trials FROM runs GROUP BY 1", DUCK_RUNS))
def a25(spark, sf_dir):
    return grid.status_counts(runs(spark, sf_dir))


@register("a25_launch_totals", duck("""
SELECT CAST(count(*) FILTER (d.trial_id IS NOT NULL) AS BIGINT) AS reused, CAST(count(*) FILTER (d.trial_id IS NULL) AS BIGINT) AS launched
FROM pid LEFT JOIN did d USING (trial_id)""", PLAN_SQL, DUCK_RUNS + RESUME))
def a25_launch(spark, sf_dir):
    return grid.launch_counts(ids(planned(spark, sf_dir)), ids(done(spark, sf_dir)))


@register("w08_until_first_failure", duck("""
SELECT hostname, trial_id, status FROM (SELECT hostname, trial_id, status, sum(CASE WHEN status <> 'success' THEN 1 ELSE 0 END)
 OVER (PARTITION BY hostname ORDER BY timestamp_utc, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs) WHERE coalesce(before, 0) = 0""", DUCK_RUNS))
def w08(spark, sf_dir):
    return grid.until_first_failure(
        runs(spark, sf_dir).select("hostname", "trial_id", "status", "timestamp_utc"), ["hostname"], ("timestamp_utc", "trial_id"),
        [F.substring("timestamp_utc", 1, 16)]).select("hostname", "trial_id", "status")


@register("a29_matrix_gaps", duck("""
SELECT i.problem_instance, i.repetition, c.candidate_name FROM (SELECT DISTINCT problem_instance, repetition FROM eligible) i, (VALUES ('cpu-16'), ('gpu-1')) c(candidate_name)
WHERE NOT EXISTS (SELECT 1 FROM eligible e WHERE e.problem_instance = i.problem_instance AND e.repetition = i.repetition AND e.candidate_name = c.candidate_name)""", GROUPS))
def a29(spark, sf_dir):
    return grid.matrix_gaps(eligible_runs(spark, sf_dir), ["problem_instance", "repetition"], "candidate_name", ("cpu-16", "gpu-1"))


@register("f23_plan_constraints", duck("""
SELECT p_partkey, 'ranks_not_divisible' AS rule FROM part WHERE (p_partkey % 48 + 1) % (p_partkey % 5 + 1) <> 0
UNION ALL SELECT p_partkey, 'threads_not_positive' FROM part WHERE p_partkey % 31 = 0
UNION ALL SELECT p_partkey, 'backend_unknown' FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT p_partkey, 'repetitions_not_positive' FROM part WHERE p_size % 10 = 0"""))
def f23(spark, sf_dir):
    df = load(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_name AS workload", "p_brand AS candidate", "CASE WHEN p_partkey % 7 = 0 THEN 'tpu' ELSE 'cpu' END AS backend",
        "p_partkey % 31 AS threads", "p_partkey % 48 + 1 AS mpi_ranks", "p_size % 10 AS repetitions", "0 AS warmups",
        "p_partkey % 5 + 1 AS communicator_product")
    return check(df, grid.plan_rules(), ["p_partkey"])


# -- joins ---------------------------------------------------------------------


@register("j01_metadata_join", duck("""
SELECT r.trial_id, r.wall_time_s, o_orderpriority FROM runs r JOIN lineitem_ids USING (trial_id) JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F'""", DUCK_RUNS + """, lineitem_ids AS (SELECT l_orderkey, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
 CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 1e2) AS BIGINT) AS STRING)) AS trial_id FROM lineitem)"""))
def j01(spark, sf_dir):
    left, right = metadata_sides(spark, sf_dir)
    good, _ = audit.attach_metadata(left, right, ["flag"], ["o_orderpriority"])
    return good.select("trial_id", "wall_time_s", "o_orderpriority")


@register("j01_metadata_violations", duck("""
SELECT r.trial_id, CASE WHEN o_orderstatus IS NULL THEN 'record_missing' ELSE 'flag_differs' END AS rule FROM runs r JOIN lineitem_ids USING (trial_id) LEFT JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus IS NULL OR o_orderstatus <> 'F'""", DUCK_RUNS + """, lineitem_ids AS (SELECT l_orderkey, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
 CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(CAST(round(l_extendedprice * 1e2) AS BIGINT) AS STRING)) AS trial_id FROM lineitem)"""))
def j01_bad(spark, sf_dir):
    left, right = metadata_sides(spark, sf_dir)
    return audit.attach_metadata(left, right, ["flag"], ["o_orderpriority"])[1]


def metadata_sides(spark, sf_dir):
    df = runs(spark, sf_dir)
    left = df.select("trial_id", "wall_time_s", F.lit("F").alias("flag"))
    records = df.select("trial_id", F.split("trial_id", "-")[0].cast("bigint").alias("o_orderkey")).join(
        load(spark, sf_dir, "orders"), "o_orderkey").select("trial_id", F.col("o_orderstatus").alias("flag"), "o_orderpriority")
    return left, records


@register("j02_reconcile", duck("""
SELECT o_orderkey, kind, field FROM (
 SELECT coalesce(l.k, r.k) AS o_orderkey, CASE WHEN l.k IS NULL THEN 'missing_left' WHEN r.k IS NULL THEN 'missing_right' ELSE 'field_mismatch' END AS kind,
  unnest(CASE WHEN l.k IS NULL OR r.k IS NULL THEN [NULL] ELSE list_filter([CASE WHEN l.status IS DISTINCT FROM r.status THEN 'status' END,
   CASE WHEN l.priority IS DISTINCT FROM r.priority THEN 'priority' END], lambda x: x IS NOT NULL) END) AS field
 FROM (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 13 <> 0) l
 FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS priority
  FROM orders WHERE o_orderkey % 11 <> 0) r ON l.k = r.k)"""))
def j02(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    left = orders.where("o_orderkey % 13 <> 0").selectExpr("o_orderkey", "o_orderstatus AS status", "o_orderpriority AS priority")
    right = orders.where("o_orderkey % 11 <> 0").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderpriority END AS priority")
    return audit.reconcile(left, right, ["o_orderkey"], ["status", "priority"])


REGISTRY = """registry AS (SELECT concat('inst-', CAST(p_partkey AS STRING)) AS problem_instance, @SHA[concat('inst-', CAST(CASE WHEN p_partkey % 9 = 0 THEN p_partkey + 1 ELSE p_partkey END AS STRING))] AS input_sha256,
 concat('fam-', CAST(p_partkey % 25 AS STRING)) AS family_id, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE (@DIV[p_partkey;25] % 50 + 2) * (@DIV[p_partkey;25] % 50 + 2) END AS n_configurations
 FROM part WHERE p_partkey % 10 <> 3
 UNION ALL SELECT concat('inst-', CAST(p_partkey AS STRING)), @SHA[concat('inst-', CAST(p_partkey AS STRING))], 'copy', 4 FROM part WHERE p_partkey % 21 = 0 AND p_partkey % 9 <> 0)"""


@register("j03_registry_lookup", duck("""
SELECT q.problem_instance, q.input_sha256, CASE WHEN e.n > 1 THEN 'ambiguous' WHEN e.n = 1 AND e.size = q.n_configurations THEN 'match' WHEN e.n = 1 THEN 'component_disagreement'
 WHEN q.problem_instance IN (SELECT problem_instance FROM registry) OR q.input_sha256 IN (SELECT input_sha256 FROM registry) THEN 'hash_disagreement' ELSE 'unknown' END AS outcome,
 CASE WHEN e.n = 1 AND e.size = q.n_configurations THEN e.family_id END AS family_id
FROM (SELECT DISTINCT problem_instance, input_sha256, n_configurations FROM runs) q LEFT JOIN (SELECT problem_instance, input_sha256, count(*) AS n, max(n_configurations) AS size,
 max(family_id) AS family_id FROM registry GROUP BY ALL) e USING (problem_instance, input_sha256)""", DUCK_RUNS, REGISTRY))
def j03(spark, sf_dir):
    return audit.registry_lookup(runs(spark, sf_dir), registry(spark, sf_dir), ["n_configurations"])


def registry(spark, sf_dir):
    from queries.base import spark_text
    body = REGISTRY[REGISTRY.index("(") + 1:REGISTRY.rindex(")")]
    return spark.sql(spark_text(body).replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))


PAIR_SQL = """, firsts AS (SELECT * FROM accepted), sides AS (SELECT family_id, problem_instance, repetition, CAST(count(*) FILTER (backend = 'cpu') AS BIGINT) AS cpu_rows,
 CAST(count(*) FILTER (backend = 'gpu') AS BIGINT) AS gpu_rows, max(wall_time_s) FILTER (backend = 'cpu') AS cpu_wall_time_s, max(wall_time_s) FILTER (backend = 'gpu') AS gpu_wall_time_s FROM firsts GROUP BY ALL)"""


#: columns of a run that an accepted attempt is made of
ATTEMPT = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_linestatus, l_shipdate"


def accepted(spark, sf_dir, by_instance=False):
    """First eligible attempt of every (instance, candidate, repetition).

    It is picked among the table's own rows: sorted rows are narrow and sort by a number,
    and only the picked ones get their texts and digests. ``by_instance`` deals the picked
    rows out by instance before that.
    """
    text = spark_text(RUNS_SQL)
    instance = "concat('inst-', CAST(l_partkey AS STRING))"
    rows_ = spark.sql(text.replace("FROM {lineitem}", f", struct({ATTEMPT}) AS row FROM {{lineitem}}"), lineitem=load(spark, sf_dir, "lineitem"))
    picked = rows_.where(ELIGIBLE).groupBy("row.l_partkey", "candidate_name", "repetition").agg(
        F.min_by("row", F.struct("started", "trial_id")).alias("first"))
    # tax and return flag told which rows are eligible; nothing below reads them
    first = picked.selectExpr("first.*", "CAST(NULL AS DOUBLE) AS l_tax", "CAST(NULL AS STRING) AS l_returnflag", f"{instance} AS problem_instance")
    if by_instance:
        first = first.repartition("problem_instance")
    return spark.sql(text.replace(f"{instance} AS problem_instance", "problem_instance"), lineitem=first).select(
        "problem_instance", "candidate_name", "repetition", "trial_id", "timestamp_utc", "family_id", "backend", "input_sha256",
        "n_configurations", "estimated_work", "wall_time_s", "solver_time_s", "energy", "samples")


@register("j05_backend_pairs", duck("SELECT family_id, problem_instance, repetition, cpu_wall_time_s, gpu_wall_time_s FROM sides WHERE cpu_rows = 1 AND gpu_rows = 1", DUCK_ACCEPTED + PAIR_SQL))
def j05(spark, sf_dir):
    good, _ = audit.backend_pairs(
        accepted(spark, sf_dir), ["family_id", "problem_instance", "repetition"], ["wall_time_s"])
    return good


@register("j05_unpaired", duck("SELECT family_id, problem_instance, repetition, cpu_rows, gpu_rows FROM sides WHERE cpu_rows <> 1 OR gpu_rows <> 1", DUCK_ACCEPTED + PAIR_SQL))
def j05_bad(spark, sf_dir):
    return audit.backend_pairs(
        accepted(spark, sf_dir), ["family_id", "problem_instance", "repetition"], ["wall_time_s"])[1]


VIEWS = {"balanced": "phase = 'measured' AND repetition <= 2", "suffix_5": "problem_instance LIKE '%5'", "big": "n_configurations >= 900"}


@register("j10_view_membership", duck(
    "SELECT trial_id, concat_ws(',', " + ", ".join(f"CASE WHEN {VIEWS[v]} THEN '{v}' END" for v in sorted(VIEWS)) + ") AS views FROM runs", DUCK_RUNS))
def j10(spark, sf_dir):
    df = runs(spark, sf_dir)
    views = T.named_views(df, {name: F.expr(test) for name, test in VIEWS.items()})
    return audit.view_membership(df.select("trial_id"), views).select("trial_id", F.concat_ws(",", "views").alias("views"))


EVIDENCE = """, asked AS (SELECT trial_id, input_sha256, CAST(bit_length AS STRING) AS solver_key, reference_value, family_id, backend, @SHA[concat(backend, CASE WHEN samples = 9 THEN 'x' ELSE '' END)] AS artifact_sha256 FROM runs),
validated AS (SELECT @SHA[concat('inst-', CAST(p_partkey AS STRING))] AS input_sha256, '48' AS solver_key, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN -1e0 ELSE -1e0 * (100 + p_partkey % 7) END AS reference_value,
 CASE WHEN p_partkey % 17 = 0 THEN 'other' ELSE concat('fam-', CAST(p_partkey % 25 AS STRING)) END AS family_id FROM part WHERE p_partkey % 4 <> 1
 UNION ALL SELECT @SHA[concat('inst-', CAST(p_partkey AS STRING))], '48', 1e0, 'dup' FROM part WHERE p_partkey % 20 = 2)"""


@register("j11_validation_evidence", duck("""
SELECT trial_id, concat_ws(';', CASE WHEN h.input_sha256 IS NULL THEN 'input_not_validated' END,
 CASE WHEN h.input_sha256 IS NOT NULL AND v.n IS NULL THEN 'solver_not_validated' END, CASE WHEN v.n > 1 THEN 'validated_more_than_once' END,
 CASE WHEN v.n = 1 AND v.ref IS NULL THEN 'reference_not_finite' END,
 CASE WHEN v.n = 1 AND v.ref <> a.reference_value THEN 'reference_differs' END, CASE WHEN v.n = 1 AND v.fam <> a.family_id THEN 'family_id_differs' END,
 CASE WHEN a.artifact_sha256 NOT IN (sha256('cpu'), sha256('gpu')) THEN 'artifact_unknown' END) AS errors
FROM asked a LEFT JOIN (SELECT DISTINCT input_sha256 FROM validated) h USING (input_sha256)
LEFT JOIN (SELECT input_sha256, solver_key, count(*) AS n, max(reference_value) AS ref, max(family_id) AS fam FROM validated GROUP BY ALL) v USING (input_sha256, solver_key)""", DUCK_RUNS + EVIDENCE))
def j11(spark, sf_dir):
    from queries.base import spark_text
    trials = runs(spark, sf_dir).selectExpr(
        "trial_id", "input_sha256", "CAST(bit_length AS STRING) AS solver_key", "reference_value", "family_id", "backend",
        "sha2(concat(backend, CASE WHEN samples = 9 THEN 'x' ELSE '' END), 256) AS artifact_sha256")
    body = EVIDENCE[EVIDENCE.index("validated AS (") + len("validated AS ("):EVIDENCE.rindex(")")]
    validated = spark.sql(spark_text(body).replace("FROM part", "FROM {part}"), part=load(spark, sf_dir, "part"))
    artifacts = runs(spark, sf_dir).select("backend", F.sha2("backend", 256).alias("artifact_sha256")).distinct()
    return audit.validation_evidence(trials, validated, artifacts, ["family_id"]).select(
        "trial_id", F.concat_ws(";", "errors").alias("errors"))


@register("j15_group_members", duck("""
SELECT a.problem_instance, a.candidate_name, a.trial_id, a.wall_time_s FROM accepted a JOIN (SELECT problem_instance, candidate_name FROM accepted WHERE repetition IN (0, 1, 2)
 GROUP BY ALL HAVING count(*) = 3) USING (problem_instance, candidate_name) WHERE repetition IN (0, 1, 2)""", DUCK_ACCEPTED))
def j15(spark, sf_dir):
    df = accepted(spark, sf_dir).where("repetition IN (0, 1, 2)")
    # three registered repetitions bound the list
    groups = df.groupBy("problem_instance", "candidate_name").agg(F.collect_list("trial_id").alias("record_ids")).where("size(record_ids) = 3")
    return audit.members(groups, runs(spark, sf_dir), ["problem_instance", "candidate_name"], ["wall_time_s"])


@register("j16_vector_parity", duck("""
SELECT a.vec_id // 2 AS pair, round(list_max(list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]))), 8) AS linf,
 round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) ** 2))), 8) AS l2
FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1"""))
def j16(spark, sf_dir):
    df = load(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 2 AS pair", "CASE WHEN vec_id % 2 = 0 THEN 'cpu' ELSE 'gpu' END AS backend", "embedding")
    good, _ = audit.backend_pairs(df, ["pair"], ["embedding"])
    linf, l2 = audit.vector_parity(F.col("cpu_embedding"), F.col("gpu_embedding"))
    return rounded(good.select("pair", linf.alias("linf"), l2.alias("l2")))


@register("j17_inventory_diff", duck("""
SELECT path, kind, field FROM (SELECT coalesce(d.path, o.path) AS path, CASE WHEN d.path IS NULL THEN 'undeclared' WHEN o.path IS NULL THEN 'absent' ELSE 'changed' END AS kind,
 unnest(CASE WHEN d.path IS NULL OR o.path IS NULL THEN [NULL] ELSE list_filter([CASE WHEN d.size_bytes <> o.size_bytes THEN 'size_bytes' END, CASE WHEN d.sha256 <> o.sha256 THEN 'sha256' END], lambda x: x IS NOT NULL) END) AS field
 FROM (SELECT url || page_id AS path, CAST(length(html) AS BIGINT) AS size_bytes, sha256(html) AS sha256 FROM pages WHERE page_id % 7 <> 0) d
 FULL JOIN (SELECT url || page_id AS path, CAST(length(html) AS BIGINT) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes, sha256(html || CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END) AS sha256
  FROM pages WHERE page_id % 4 <> 0) o ON d.path = o.path)"""))
def j17(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").withColumn("path", F.concat("url", F.col("page_id").cast("string")))
    declared = pages.where("page_id % 7 <> 0").selectExpr("path", "CAST(length(html) AS BIGINT) AS size_bytes", "sha2(html, 256) AS sha256")
    observed = pages.where("page_id % 4 <> 0").selectExpr(
        "path", "CAST(length(html) AS BIGINT) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS size_bytes",
        "sha2(concat(html, CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END), 256) AS sha256")
    return audit.inventory_diff(declared, observed)


# -- aggregate checks ----------------------------------------------------------


@register("a11_constant_within", duck("""
SELECT problem_instance, unnest(list_filter([CASE WHEN count(DISTINCT coalesce(input_sha256, '')) > 1 THEN 'input_sha256' END, CASE WHEN count(DISTINCT bit_length) > 1 THEN 'bit_length' END,
 CASE WHEN count(DISTINCT coalesce(rehash_error, '')) > 1 THEN 'rehash_error' END, CASE WHEN count(DISTINCT coalesce(basis, '')) > 1 THEN 'basis' END], lambda x: x IS NOT NULL)) AS field
FROM runs GROUP BY problem_instance""", DUCK_RUNS))
def a11(spark, sf_dir):
    return audit.constant_within(runs(spark, sf_dir), ["problem_instance"], ["input_sha256", "bit_length", "rehash_error", "basis"])


DIMENSIONS = ("phase", "backend", "family_id", "candidate_name", "status", "hostname")


@register("a15_campaign_counts", duck(" UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY {d}" for d in DIMENSIONS), DUCK_RUNS))
def a15(spark, sf_dir):
    return audit.counts(runs(spark, sf_dir), DIMENSIONS)


@register("a16_resource_summary", duck("""
SELECT max(peak_host_rss_mb) AS peak_host_rss_mb, max(peak_gpu_memory_mb) AS peak_gpu_memory_mb, min(23034 - peak_gpu_memory_mb) AS minimum_preflight_free_gpu_mib,
 max(samples * 1e0) AS maximum_preflight_temperature_c, max(estimated_work) AS maximum_gpu_guard_bytes FROM runs""", DUCK_RUNS))
def a16(spark, sf_dir):
    return audit.resource_summary(runs(spark, sf_dir).select(
        "peak_host_rss_mb", "peak_gpu_memory_mb", (F.lit(23034) - F.col("peak_gpu_memory_mb")).alias("gpu_free_mib"),
        (F.col("samples") * 1.0).alias("gpu_temperature_c"), F.col("estimated_work").alias("gpu_guard_bytes")))


LATENCY = """latency AS (SELECT event_type, CAST(count(*) AS BIGINT) AS n, min(value) * 1e3 AS min_us, quantile_cont(value, 0.5) * 1e3 AS median_us, quantile_cont(value, 0.9) * 1e3 AS p90_us,
 quantile_cont(value, 0.95) * 1e3 AS p95_us, max(value) * 1e3 AS max_us FROM events GROUP BY 1)"""


@register("a17_latency_summary", duck("""
SELECT event_type, n, round(min_us, 5) AS min_us, round(median_us, 5) AS median_us, round(p90_us, 5) AS p90_us, round(p95_us, 5) AS p95_us, round(max_us, 5) AS max_us FROM latency""", LATENCY))
def a17(spark, sf_dir):
    return rounded(latency(spark, sf_dir), 5)


def latency(spark, sf_dir):
    from trialflow.sources.samples import latency_summary
    df = load(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 1e6).cast("bigint").alias("ns"))
    return latency_summary(df, ["event_type"])


@register("a17_selection_counts", duck("SELECT event_type, user_id % 3 AS selected, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL"))
def a17_counts(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("selected")).agg(F.count(F.lit(1)).alias("n"))


@register("a18_overhead_share", duck("""
SELECT event_type, round(median_us, 5) AS median_us, round(s, 8) AS shortest_run_s, round(median_us / 1e6 / s, 8) AS share FROM latency, (SELECT min(wall_time_s_median) AS s FROM groups)""", LATENCY, GROUPS))
def a18(spark, sf_dir):
    out = audit.overhead_share(latency(spark, sf_dir), grouped(spark, sf_dir))
    return out.select("event_type", F.round("median_us", 5).alias("median_us"), F.round("shortest_run_s", 8).alias("shortest_run_s"),
                      F.round("share", 8).alias("share"))


@register("a24_evidence_chain", duck("""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM runs) AS records, sha256(string_agg(h, '' ORDER BY h)) AS chain_sha256 FROM (
 SELECT substr(h, 1, 2) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM (
  SELECT substr(h, 1, 5) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM (
   SELECT sha256(concat_ws(chr(0), h, CAST(n AS STRING))) AS h FROM (SELECT sha256(concat_ws(chr(0), trial_id, input_sha256, CAST(estimated_work AS STRING))) AS h, count(*) AS n FROM runs GROUP BY 1))
  GROUP BY substr(h, 1, 5)) GROUP BY substr(h, 1, 2))""", DUCK_RUNS))
def a24(spark, sf_dir):
    return audit.chain_hash(runs(spark, sf_dir), ["trial_id", "input_sha256", "estimated_work"])


SIZED = """, sized AS (SELECT problem_instance, n_configurations + CASE WHEN samples = 11 AND hostname = 'host-3' THEN 1 ELSE 0 END AS n_configurations FROM runs)"""


def sized(spark, sf_dir):
    return runs(spark, sf_dir).selectExpr(
        "problem_instance", "n_configurations + CASE WHEN samples = 11 AND hostname = 'host-3' THEN 1 ELSE 0 END AS n_configurations")


@register("a28_size_map", duck("SELECT problem_instance, min(n_configurations) AS n_configurations FROM sized GROUP BY 1 HAVING min(n_configurations) = max(n_configurations)", DUCK_RUNS + SIZED))
def a28(spark, sf_dir):
    return audit.size_map(sized(spark, sf_dir))[0]


@register("a28_size_conflicts", duck("SELECT problem_instance, min(n_configurations) AS lowest, max(n_configurations) AS highest FROM sized GROUP BY 1 HAVING min(n_configurations) <> max(n_configurations)", DUCK_RUNS + SIZED))
def a28_bad(spark, sf_dir):
    return audit.size_map(sized(spark, sf_dir))[1]


@register("a30_workload_entries", duck("""
SELECT family_id, problem_instance, input_sha256, CAST(count(*) AS BIGINT) AS members, min(trial_id) AS first_member, max(trial_id) AS last_member, max(n_configurations) AS n_configurations,
 sha256(concat_ws(chr(0), family_id, problem_instance, input_sha256)) AS entry_id FROM runs GROUP BY family_id, problem_instance, input_sha256""", DUCK_RUNS))
def a30(spark, sf_dir):
    return audit.workload_entries(instance_runs(spark, sf_dir), ["n_configurations"])[0]


@register("a31_rederivation_audit", duck("""
SELECT family_id, finding FROM (SELECT s.family_id, unnest(list_filter([CASE WHEN s.n <> f.n THEN 'n' END, CASE WHEN abs(s.t - f.t) > 1e-9 THEN 't' END], lambda x: x IS NOT NULL)) AS finding
 FROM (SELECT family_id, count(*) + CASE WHEN family_id = 'fam-3' THEN 1 ELSE 0 END AS n, max(wall_time_s) + CASE WHEN family_id = 'fam-4' THEN 1e-3 ELSE 1e-15 END AS t FROM runs WHERE family_id <> 'fam-9' GROUP BY 1) s
 JOIN (SELECT family_id, count(*) AS n, max(wall_time_s) AS t FROM runs GROUP BY 1) f USING (family_id)) UNION ALL SELECT 'fam-9', 'not_stored'""", DUCK_RUNS))
def a31(spark, sf_dir):
    fresh = runs(spark, sf_dir).groupBy("family_id").agg(F.count(F.lit(1)).alias("n"), F.max("wall_time_s").alias("t"))
    stored = fresh.where("family_id <> 'fam-9'").select(
        "family_id", (F.col("n") + F.when(F.col("family_id") == "fam-3", 1).otherwise(0)).alias("n"),
        (F.col("t") + F.when(F.col("family_id") == "fam-4", 1e-3).otherwise(1e-15)).alias("t"))
    return audit.rederive_diff(stored, fresh, ["family_id"], ["n", "t"])


INTERVALS = "intervals AS (SELECT event_id, user_id AS host, ts AS started, ts + to_microseconds(CAST(round(value * 1e8) AS BIGINT)) AS finished FROM events)"


def intervals(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("host"), F.col("ts").cast("timestamp").alias("started"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 1e8).cast("bigint")).alias("finished"))


@register("w04_overlaps", duck("""
SELECT host, event_id, @TS[started] AS started, @TS[earlier] AS earlier_finish FROM (SELECT *, max(finished) OVER (PARTITION BY host ORDER BY started, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM intervals) WHERE started < earlier""", INTERVALS))
def w04(spark, sf_dir):
    return stamps(audit.overlaps(intervals(spark, sf_dir), ["host"], "event_id", "started", "finished"))


@register("w04_adjacent_overlaps", duck("""
SELECT host, event_id, @TS[started] AS started, @TS[earlier] AS earlier_finish FROM (SELECT *, lag(finished) OVER (PARTITION BY host ORDER BY started, event_id) AS earlier FROM intervals) WHERE started < earlier""", INTERVALS))
def w04_weak(spark, sf_dir):
    return stamps(audit.overlaps(intervals(spark, sf_dir), ["host"], "event_id", "started", "finished", strong=False))


def stamps(df):
    return df.select(*[
        F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


@register("w04_temporal_summary", duck("""
SELECT host, CAST(count(*) AS BIGINT) AS trials, CAST(count(*) FILTER (finished < started) AS BIGINT) AS negative_intervals,
 round((epoch_us(max(finished)) - epoch_us(min(started))) / 1e6, 6) AS span_s, round(sum(epoch_us(finished) - epoch_us(started)) / 1e6, 4) AS busy_s FROM intervals GROUP BY 1""", INTERVALS))
def w04_summary(spark, sf_dir):
    return audit.temporal_summary(intervals(spark, sf_dir), ["host"], "started", "finished").select(
        "host", "trials", "negative_intervals", F.round("span_s", 6).alias("span_s"), F.round("busy_s", 4).alias("busy_s"))


# -- sets ----------------------------------------------------------------------


@register("u01_union_campaigns", duck("""
SELECT campaign, family_id, peak, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'cpu' AS campaign, family_id, NULL::DOUBLE AS peak FROM runs WHERE backend = 'cpu'
 UNION ALL SELECT 'gpu', family_id, peak_gpu_memory_mb FROM runs WHERE backend = 'gpu') GROUP BY ALL""", DUCK_RUNS))
def u01(spark, sf_dir):
    df = runs(spark, sf_dir)
    both = audit.union_campaigns({
        "cpu": df.where("backend = 'cpu'").select("family_id"),
        "gpu": df.where("backend = 'gpu'").select("family_id", F.col("peak_gpu_memory_mb").alias("peak"))})
    return both.groupBy("campaign", "family_id", "peak").agg(F.count(F.lit(1)).alias("n"))


@register("u02_id_set_difference", duck("""
SELECT problem_instance, repetition, 'left_only' AS kind FROM (SELECT problem_instance, repetition FROM runs WHERE backend = 'cpu' EXCEPT SELECT problem_instance, repetition FROM runs WHERE backend = 'gpu')
UNION ALL SELECT problem_instance, repetition, 'right_only' FROM (SELECT problem_instance, repetition FROM runs WHERE backend = 'gpu' EXCEPT SELECT problem_instance, repetition FROM runs WHERE backend = 'cpu')""", DUCK_RUNS))
def u02(spark, sf_dir):
    df = runs(spark, sf_dir)
    return audit.set_difference(df.where("backend = 'cpu'"), df.where("backend = 'gpu'"), ["problem_instance", "repetition"])


SPLIT = """, split AS (SELECT family_id AS fold_id, problem_instance, CASE WHEN samples = 2 THEN 'test' ELSE 'train' END AS role FROM runs)"""


@register("u03_leakage", duck("""
SELECT fold_id, problem_instance FROM split WHERE role = 'train' INTERSECT SELECT fold_id, problem_instance FROM split WHERE role = 'test'""", DUCK_RUNS + SPLIT))
def u03(spark, sf_dir):
    split = runs(spark, sf_dir).selectExpr(
        "family_id AS fold_id", "problem_instance", "CASE WHEN samples = 2 THEN 'test' ELSE 'train' END AS role")
    return audit.leakage(split, "problem_instance")


@register("u04_record_reuse", duck("""
SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS groups FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1"""))
def u04(spark, sf_dir):
    return audit.reused_members(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


@register("u06_partition_check", duck("""
SELECT k AS o_orderkey, CASE WHEN g > 1 THEN 'reused' WHEN g = 0 THEN 'uncovered' ELSE 'foreign' END AS kind FROM (
 SELECT coalesce(o.o_orderkey, m.o_orderkey) AS k, coalesce(g, 0) AS g, o.o_orderkey IS NULL AS alien FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) o
 FULL JOIN (SELECT l_orderkey AS o_orderkey, count(DISTINCT l_returnflag) AS g FROM lineitem GROUP BY 1) m ON o.o_orderkey = m.o_orderkey) WHERE g <> 1 OR alien"""))
def u06(spark, sf_dir):
    members = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return audit.partition_check(members, load(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0"), "l_returnflag", "o_orderkey")


@register("o05_shortest_median", duck("""
SELECT problem_instance, candidate_name, round(wall_time_s_median, 8) AS wall_time_s_median FROM groups ORDER BY groups.wall_time_s_median, problem_instance, candidate_name LIMIT 1""", GROUPS))
def o05(spark, sf_dir):
    return rounded(grouped(spark, sf_dir).orderBy("wall_time_s_median", "problem_instance", "candidate_name").limit(1).select(
        "problem_instance", "candidate_name", "wall_time_s_median"))


@register("o04_argmin_tie_break", duck("""
SELECT problem_instance, arg_min(candidate_name, (round(wall_time_s_median), candidate_name)) AS chosen FROM groups GROUP BY 1""", GROUPS))
def o04(spark, sf_dir):
    from trialflow.operators.policy import argmin
    return grouped(spark, sf_dir).groupBy("problem_instance").agg(
        argmin(F.round("wall_time_s_median"), F.col("candidate_name")).alias("chosen"))


# -- screens -------------------------------------------------------------------

SCREEN = """, cells AS (SELECT family_id, problem_instance, n_configurations, backend, bit_length, shuffle, concat_ws('/', backend, CAST(bit_length AS STRING), CAST(shuffle AS STRING)) AS candidate_name,
 min(wall_time_s) AS wall_time_s, min(solver_time_s) AS solver_time_s FROM runs WHERE """ + ELIGIBLE + """ GROUP BY ALL),
effects AS (SELECT l.family_id, l.problem_instance, l.n_configurations, f.factor, f.fixed_factors, l.wall_time_s / r.wall_time_s AS wall_ratio, l.solver_time_s / r.solver_time_s AS solver_ratio,
  CASE WHEN l.wall_time_s < r.wall_time_s THEN 'left' WHEN r.wall_time_s < l.wall_time_s THEN 'right' ELSE 'tie' END AS wall_winner,
  CASE WHEN l.solver_time_s < r.solver_time_s THEN 'left' WHEN r.solver_time_s < l.solver_time_s THEN 'right' ELSE 'tie' END AS solver_winner,
  l.candidate_name AS left_candidate, r.candidate_name AS right_candidate, f.left_level, f.right_level
 FROM cells l JOIN cells r ON l.problem_instance = r.problem_instance, LATERAL (
  SELECT 'backend' AS factor, 'cpu' AS left_level, 'gpu' AS right_level, 'bit_length=' || l.bit_length || ',shuffle=' || CAST(l.shuffle AS STRING) AS fixed_factors WHERE l.backend = 'cpu' AND r.backend = 'gpu' AND l.bit_length = r.bit_length AND l.shuffle = r.shuffle
  UNION ALL SELECT 'bit_length', '20', '48', 'backend=' || l.backend || ',shuffle=' || CAST(l.shuffle AS STRING) WHERE l.bit_length = 20 AND r.bit_length = 48 AND l.backend = r.backend AND l.shuffle = r.shuffle
  UNION ALL SELECT 'shuffle', 'false', 'true', 'backend=' || l.backend || ',bit_length=' || l.bit_length WHERE NOT l.shuffle AND r.shuffle AND l.backend = r.backend AND l.bit_length = r.bit_length) f),
ranked AS (SELECT *, rank() OVER (PARTITION BY family_id, problem_instance ORDER BY wall_time_s) AS wall_rank, rank() OVER (PARTITION BY family_id, problem_instance ORDER BY solver_time_s) AS solver_rank FROM cells)"""
SCREENED = DUCK_RUNS + SCREEN


def cells(spark, sf_dir):
    keys = ["family_id", "problem_instance", "n_configurations", "backend", "bit_length", "shuffle"]
    return eligible_runs(spark, sf_dir).groupBy(*keys).agg(
        F.min("wall_time_s").alias("wall_time_s"), F.min("solver_time_s").alias("solver_time_s"),
    ).withColumn("candidate_name", F.concat_ws("/", "backend", F.col("bit_length").cast("string"), F.col("shuffle").cast("string")))


@register("j07_paired_effects", duck("""
SELECT family_id, problem_instance, n_configurations, factor, left_level, right_level, fixed_factors, left_candidate, right_candidate, round(wall_ratio, 8) AS wall_ratio,
 round(solver_ratio, 8) AS solver_ratio, wall_winner, solver_winner FROM effects""", SCREENED))
def j07(spark, sf_dir):
    from trialflow.operators.screen import paired_effects
    return rounded(paired_effects(cells(spark, sf_dir)))


SUMMARY_COLUMNS = """CAST(count(*) AS BIGINT) AS n, round(min(wall_time_s), 8) AS wall_min, round(quantile_cont(wall_time_s, 0.25), 8) AS wall_q1, round(quantile_cont(wall_time_s, 0.5), 8) AS wall_median,
 round(quantile_cont(wall_time_s, 0.75), 8) AS wall_q3, round(max(wall_time_s), 8) AS wall_max, round(quantile_cont(solver_time_s, 0.5), 8) AS solver_median,
 CAST(count(*) FILTER (wall_rank = 1) AS BIGINT) AS wall_wins, CAST(count(*) FILTER (solver_rank = 1) AS BIGINT) AS solver_wins"""


@register("a22_screen_summaries", duck(f"""
SELECT 'all' AS scope, NULL AS family_id, NULL::BIGINT AS n_configurations, candidate_name, {SUMMARY_COLUMNS} FROM ranked GROUP BY candidate_name
UNION ALL SELECT 'family', family_id, NULL, candidate_name, {SUMMARY_COLUMNS} FROM ranked GROUP BY family_id, candidate_name
UNION ALL SELECT 'size', NULL, n_configurations, candidate_name, {SUMMARY_COLUMNS} FROM ranked GROUP BY n_configurations, candidate_name""", SCREENED))
def a22(spark, sf_dir):
    from trialflow.operators.screen import screen
    return rounded(screen(cells(spark, sf_dir))["timing_summary"])


FACTOR_COLUMNS = "factor, left_level, right_level, CAST(count(*) AS BIGINT) AS n, " + ", ".join(
    f"CAST(count(*) FILTER ({m}_winner = '{s}') AS BIGINT) AS {m}_{s}" for m in ("wall", "solver") for s in ("left", "right", "tie")) + ", " + ", ".join(
    f"round(quantile_cont({m}_ratio, {p}), 8) AS {m}_ratio_{q}" for m in ("wall", "solver") for p, q in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))


@register("a23_factor_summaries", duck(f"""
SELECT 'all' AS scope, NULL AS family_id, {FACTOR_COLUMNS} FROM effects GROUP BY factor, left_level, right_level
UNION ALL SELECT 'family', family_id, {FACTOR_COLUMNS} FROM effects GROUP BY family_id, factor, left_level, right_level""", SCREENED))
def a23(spark, sf_dir):
    from trialflow.operators.screen import screen
    return rounded(screen(cells(spark, sf_dir))["factor_summary"])


@register("u05_long_form", duck("""
SELECT 'measurement' AS row_type, problem_instance, candidate_name, NULL AS factor, round(wall_time_s, 8) AS wall_time_s, NULL::DOUBLE AS wall_ratio FROM cells
UNION ALL SELECT 'paired_effect', problem_instance, NULL, factor, NULL, round(wall_ratio, 8) FROM effects""", SCREENED))
def u05(spark, sf_dir):
    from trialflow.operators.screen import long_form, screen
    tables = screen(cells(spark, sf_dir))
    return rounded(long_form({
        "measurement": tables["measurement"].select("problem_instance", "candidate_name", "wall_time_s"),
        "paired_effect": tables["paired_effect"].select("problem_instance", "factor", "wall_ratio")}))


@register("m14_screen_rankings", duck("""
SELECT problem_instance, candidate_name, CAST(wall_rank AS BIGINT) AS wall_rank, CAST(solver_rank AS BIGINT) AS solver_rank, round(wall_time_s / min(wall_time_s) OVER (PARTITION BY family_id, problem_instance), 8) AS wall_over_best,
 wall_rank = 1 AS wall_winner FROM ranked""", SCREENED))
def m14(spark, sf_dir):
    from trialflow.operators.screen import screen
    return rounded(screen(cells(spark, sf_dir))["measurement"].select(
        "problem_instance", "candidate_name", "wall_rank", "solver_rank", "wall_over_best", "wall_winner"))
