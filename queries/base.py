"""Registry and the campaign views over the given tables.

View texts are written once and rendered for both engines; ``@SHA[x]`` is the
SHA-256 hex digest, ``@TS[x]`` a timestamp as ISO text, ``@DIV[a;b]`` integer
division.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _render(text: str, sha: str, ts: str, div: str) -> str:
    def sub(pattern: str, template: str, source: str) -> str:
        previous = None
        while previous != source:
            previous = source
            source = re.sub(pattern, template, source)
        return source

    text = sub(r"@SHA\[([^\[\]]*)\]", sha, text)
    text = sub(r"@TS\[([^\[\]]*)\]", ts, text)
    return sub(r"@DIV\[([^\[\];]*);([^\[\];]*)\]", div, text)


def spark_text(text: str) -> str:
    return _render(
        text, r"sha2(\1, 256)", r"date_format(\1, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", r"((\1) div (\2))"
    )


def duck_text(text: str) -> str:
    return _render(
        text, r"sha256(\1)", r"strftime(\1, '%Y-%m-%d %H:%M:%S.%f')", r"((\1) // (\2))"
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, least: int = 1 << 18, per_core: int = 8 << 20) -> DataFrame:
    """Hand a table out to all cores where its files are too few to feed them.

    One row group is one task. Only inputs above 256 KB and below 8 MB per core are
    shuffled by their first column; anything larger keeps its own splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if least < size < per_core * cores:
        return df.repartition(cores, df.columns[0])
    return df


def parts(table: DataFrame, piece: int = 4 << 20) -> int:
    """How many parts of about ``piece`` bytes the files of a table make; all cores get one if it has 256 KB."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = table.sparkSession.sparkContext.defaultParallelism if size > 1 << 18 else 1
    return max(least, -(-size // piece))


def pieces(spark: SparkSession, sf_dir: str, name: str, *keys: str, piece: int = 4 << 20) -> DataFrame:
    """A table dealt out by ``keys`` in parts of about ``piece`` bytes of its files.

    The number of tasks grows with the table, what one of them holds does not. For steps
    that make many rows of one or hold a split in memory; the shuffle is of plain columns.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(parts(df, piece), *keys)


RUNS_SQL = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',
              CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
              CAST(CAST(round(l_extendedprice * 1e2) AS BIGINT) AS STRING)) AS trial_id,
       @SHA[concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING))] AS logical_trial_id,
       CAST(l_suppkey % 3 AS INT) AS attempt_index,
       CASE WHEN l_suppkey % 50 = 0 THEN 1 WHEN l_suppkey % 2 = 0 THEN 2 ELSE 3 END AS schema_version,
       @TS[l_shipdate] AS timestamp_utc,
       l_shipdate AS started,
       concat('fam-', CAST(l_partkey % 25 AS STRING)) AS family_id,
       concat('mol-', CAST(l_partkey % 25 AS STRING)) AS molecule,
       CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('basis-', CAST(l_partkey % 5 AS STRING)) END AS basis,
       concat('inst-', CAST(l_partkey AS STRING)) AS problem_instance,
       @SHA[concat('inst-', CAST(l_partkey AS STRING))] AS input_sha256,
       (@DIV[l_partkey;25] % 50 + 2) * (@DIV[l_partkey;25] % 50 + 2) AS n_configurations,
       (@DIV[l_partkey;25] % 50 + 2) * 1000 + l_partkey AS estimated_work,
       CASE WHEN l_linestatus = 'O' THEN 'cpu-16' ELSE 'gpu-1' END AS candidate_name,
       CASE WHEN l_linestatus = 'O' THEN 'cpu' ELSE 'gpu' END AS backend,
       CASE WHEN l_linestatus = 'O' THEN 16 ELSE 1 END AS cpu_threads,
       CASE WHEN l_linenumber % 4 = 0 THEN 1 WHEN l_linenumber % 4 = 1 THEN 4
            WHEN l_linenumber % 4 = 2 THEN 8 ELSE 16 END AS pilot_threads,
       CASE WHEN l_returnflag = 'A' THEN 20 ELSE 48 END AS bit_length,
       l_quantity > 25 AS shuffle,
       CASE WHEN (l_linenumber - 1) % 4 = 0 THEN 'warmup' ELSE 'measured' END AS phase,
       CASE WHEN (l_linenumber - 1) % 4 = 0 THEN 0 ELSE (l_linenumber - 1) % 4 - 1 END AS repetition,
       CASE WHEN l_tax >= 8e-2 THEN 'failed' WHEN l_tax >= 7e-2 AND l_quantity <= 4 THEN 'timeout'
            WHEN l_tax >= 7e-2 AND l_quantity <= 8 THEN 'oom' ELSE 'success' END AS status,
       l_tax < 7e-2 OR (l_quantity > 8 AND l_tax < 8e-2) AS process_success,
       l_tax < 7e-2 AS scientific_success,
       CASE WHEN l_discount >= 1e-1 AND l_quantity > 40 THEN NULL ELSE l_discount < 1e-1 END AS correct,
       l_suppkey % 40 = 7 AS project_git_dirty,
       l_suppkey % 37 <> 0 AS correctness_validated,
       TRUE AS validation_required,
       l_suppkey % 41 <> 0 AS validation_valid,
       l_partkey % 97 <> 0 AS unchanged_before_launch,
       l_partkey % 89 <> 0 AS unchanged_after_run,
       CASE WHEN l_orderkey % 101 = 0 THEN 'read failed' END AS rehash_error,
       l_orderkey % 53 <> 0 AS host_complete,
       CAST(l_orderkey % 61 AS INT) AS samples,
       l_orderkey % 59 <> 0 AS gpu_complete,
       l_orderkey % 67 <> 0 AS gpu_process_observed,
       CASE WHEN l_orderkey % 103 = 0 THEN 0e0 ELSE l_extendedprice / 1e3 END AS wall_time_s,
       CASE WHEN l_orderkey % 107 = 0 THEN NULL ELSE (l_extendedprice - l_quantity * 8e0) / 1e3 END AS solver_time_s,
       l_quantity * 16e0 AS peak_host_rss_mb,
       CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_quantity * 8e0 END AS peak_gpu_memory_mb,
       -1e0 * (100 + l_partkey % 7) AS reference_value,
       -1e0 * (100 + l_partkey % 7) - l_discount / 1e8 AS energy,
       CASE WHEN l_suppkey % 11 = 0 THEN 'pilot' WHEN l_suppkey % 11 = 1 THEN 'correctness' ELSE 'final' END AS purpose,
       concat('host-', CAST(l_suppkey % 40 AS STRING)) AS hostname
FROM {lineitem}
"""

#: accepted attempts: the first eligible success per instance, candidate, repetition
ELIGIBLE = (
    "phase = 'measured' AND status = 'success' AND coalesce(correct, FALSE)"
    " AND wall_time_s > 0 AND solver_time_s IS NOT NULL"
)

ACCEPTED_DUCK = """
SELECT * EXCLUDE (rn) FROM (
  SELECT r.*, row_number() OVER (PARTITION BY problem_instance, candidate_name, repetition
                                 ORDER BY timestamp_utc, trial_id) AS rn
  FROM runs r WHERE """ + ELIGIBLE + """) q WHERE rn = 1
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat run rows: a narrow projection of ``lineitem``."""
    return runs_of(load(spark, sf_dir, "lineitem"))


def runs_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.sparkSession.sql(spark_text(RUNS_SQL), lineitem=lineitem)


def instance_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows dealt out by instance and line number.

    Most rows of a group of an instance meet before the group's shuffle; an instance with
    very many rows still lies in several parts.
    """
    return spark.sql(spark_text(RUNS_SQL), lineitem=pieces(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber"))


def eligible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where(ELIGIBLE)


DUCK_RUNS = "runs AS (" + duck_text(RUNS_SQL).replace("{lineitem}", "lineitem") + ")"
DUCK_ACCEPTED = DUCK_RUNS + ", accepted AS (" + ACCEPTED_DUCK + ")"


def duck(body: str, *ctes: str) -> str:
    """A DuckDB query with named common tables in front."""
    head = ",\n".join(duck_text(c) for c in ctes)
    return (f"WITH {head}\n" if head else "") + duck_text(body)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
