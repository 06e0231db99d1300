"""Campaign audits: reconciliation, lookups, constancy, overlap, evidence hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.functions.scaled import keyed_join, previous, running
from trialflow.functions.stats import close, finite, is_true
from trialflow.operators.rules import needs, reasons, rule


def attach_metadata(
    rows: DataFrame, records: DataFrame, agree: Sequence[str], take: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Rows with record columns by trial id, and the fields on which both disagree."""
    right = records.select(
        F.col("trial_id").alias("_id"), *[F.col(c).alias(f"_r_{c}") for c in agree],
        *[F.col(c) for c in take],
    )
    joined = rows.join(right, F.col("trial_id") == F.col("_id"), "left")
    missing = rule("record_missing", F.col("_id").isNull())
    differs = [
        rule(f"{c}_differs", F.col("_id").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_r_{c}")))
        for c in agree
    ]
    marked = joined.withColumn("_bad", reasons([missing, *differs]))
    good = marked.where(F.size("_bad") == 0).select(*rows.columns, *take)
    return good, marked.select("trial_id", F.explode("_bad").alias("rule"))


def reconcile(
    left: DataFrame, right: DataFrame, keys: Sequence[str], compare: Sequence[str]
) -> DataFrame:
    """``keys, kind, field``: rows on one side only and differing fields, null-safe."""
    l = left.select(*[F.col(k).alias(f"_l_{k}") for k in keys],
                    *[F.col(c).alias(f"_l_{c}") for c in compare], F.lit(True).alias("_in_l"))
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[F.col(c).alias(f"_r_{c}") for c in compare], F.lit(True).alias("_in_r"))
    on = None
    for k in keys:
        term = F.col(f"_l_{k}") == F.col(f"_r_{k}")
        on = term if on is None else on & term
    joined = l.join(r, on, "full_outer")
    absent = (
        F.when(F.col("_in_l").isNull(), "missing_left").when(F.col("_in_r").isNull(), "missing_right")
    )
    fields = F.array_compact(F.array(*[
        F.when(~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), F.lit(c)) for c in compare
    ]))
    findings = F.when(
        absent.isNotNull(),
        F.array(F.struct(absent.alias("kind"), F.lit(None).cast("string").alias("field"))),
    ).otherwise(F.transform(
        fields, lambda f: F.struct(F.lit("field_mismatch").alias("kind"), f.alias("field"))
    ))
    return joined.select(
        *[F.coalesce(f"_l_{k}", f"_r_{k}").alias(k) for k in keys], F.explode(findings).alias("_f")
    ).select(*keys, "_f.kind", "_f.field")


def registry_lookup(
    queries: DataFrame, registry: DataFrame, components: Sequence[str]
) -> DataFrame:
    """Outcome of each distinct (instance, hash) against the registry.

    ``match``, ``ambiguous``, ``hash_disagreement`` (either part is known with another
    partner), ``component_disagreement`` or ``unknown``.
    """
    pair = ["problem_instance", "input_sha256"]
    asked = queries.select(*pair, *components).distinct()
    entries = registry.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(f"_e_{c}") for c in components],
        F.max("family_id").alias("family_id"),
    )
    known_name = registry.select("problem_instance").distinct().withColumn("_by_name", F.lit(True))
    known_hash = registry.select("input_sha256").distinct().withColumn("_by_hash", F.lit(True))
    joined = (
        asked.join(entries, pair, "left").join(known_name, "problem_instance", "left")
        .join(known_hash, "input_sha256", "left")
    )
    same = F.lit(True)
    for c in components:
        same = same & F.col(c).eqNullSafe(F.col(f"_e_{c}"))
    outcome = (
        F.when(F.col("_n") > 1, "ambiguous")
        .when((F.col("_n") == 1) & same, "match")
        .when(F.col("_n") == 1, "component_disagreement")
        .when(F.col("_by_name") | F.col("_by_hash"), "hash_disagreement")
        .otherwise("unknown")
    )
    return joined.select(
        *pair, outcome.alias("outcome"),
        F.when(outcome == "match", F.col("family_id")).alias("family_id"),
    )


def backend_pairs(
    rows: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """One row per key with the CPU and GPU columns side by side; other keys are violations.

    A conditional aggregation instead of a self-join: one shuffle, combined map-side.
    """
    payload = F.struct(*columns)
    sides = rows.groupBy(*keys).agg(
        F.count_if(F.col("backend") == "cpu").alias("cpu_rows"),
        F.count_if(F.col("backend") == "gpu").alias("gpu_rows"),
        F.max(F.when(F.col("backend") == "cpu", payload)).alias("_cpu"),
        F.max(F.when(F.col("backend") == "gpu", payload)).alias("_gpu"),
    )
    paired = (F.col("cpu_rows") == 1) & (F.col("gpu_rows") == 1)
    good = sides.where(paired).select(
        *keys, *[F.col(f"_cpu.{c}").alias(f"cpu_{c}") for c in columns],
        *[F.col(f"_gpu.{c}").alias(f"gpu_{c}") for c in columns],
    )
    return good, sides.where(~paired).select(*keys, "cpu_rows", "gpu_rows")


def vector_parity(a: Column, b: Column) -> tuple[Column, Column]:
    """``(L-infinity, L2)`` of the difference; NULL for unequal lengths."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    same = F.size(a) == F.size(b)
    return (
        F.when(same, F.coalesce(F.array_max(diffs), F.lit(0.0))),
        F.when(same, F.sqrt(F.aggregate(diffs, F.lit(0.0), lambda s, d: s + d * d))),
    )


def view_membership(rows: DataFrame, views: DataFrame) -> DataFrame:
    """Sorted names of the registered views each trial is in (bounded by the view list)."""
    names = views.groupBy("trial_id").agg(F.array_sort(F.collect_set("view")).alias("views"))
    return rows.join(names, "trial_id", "left").withColumn(
        "views", F.coalesce("views", F.array().cast("array<string>"))
    )


def validation_evidence(
    trials: DataFrame, validated: DataFrame, artifacts: DataFrame, metadata: Sequence[str] = ()
) -> DataFrame:
    """Errors per trial against the validated inputs and candidate artifacts.

    ``trials`` and ``validated`` carry ``input_sha256, solver_key, reference_value`` and
    the ``metadata`` columns; ``artifacts`` carries ``backend, artifact_sha256`` of the
    registered candidates, few enough to broadcast.

    What is known is looked up once per asked (input, solver); trials are shuffled once.
    """
    by_hash = validated.select("input_sha256").distinct().withColumn("_hash", F.lit(True))
    by_pair = validated.groupBy("input_sha256", "solver_key").agg(
        F.count(F.lit(1)).alias("_n"), F.max("reference_value").alias("_reference"),
        *[F.max(c).alias(f"_v_{c}") for c in metadata],
    )
    known = artifacts.select("backend", "artifact_sha256").distinct().withColumn("_art", F.lit(True))
    pair = ["input_sha256", "solver_key"]
    asked = trials.select(*pair).distinct().join(by_hash, "input_sha256", "left").join(by_pair, pair, "left")
    # null-safe: a trial without a solver key still asks for its input
    joined = keyed_join(trials.join(F.broadcast(known), ["backend", "artifact_sha256"], "left"), asked, pair, "left")
    one = F.coalesce(F.col("_n") == 1, F.lit(False))
    stated = finite(F.col("_reference"))
    errors = reasons([
        rule("input_not_validated", F.col("_hash").isNull()),
        rule("solver_not_validated",
             F.col("_hash").isNotNull() & F.col("_n").isNull()),
        rule("validated_more_than_once",
             F.coalesce(F.col("_n") > 1, F.lit(False))),
        rule("reference_not_finite", one & ~stated),
        rule("workload_without_reference",
             one & stated & F.col("reference_value").isNull()),
        rule("reference_differs",
             one & stated & F.col("reference_value").isNotNull()
             & (F.col("_reference") != F.col("reference_value"))),
        *[rule(f"{c}_differs",
               one & ~F.col(c).eqNullSafe(F.col(f"_v_{c}"))) for c in metadata],
        rule("artifact_unknown", F.col("_art").isNull()),
    ])
    return joined.select(*trials.columns, errors.alias("errors")).withColumn(
        "valid", F.size("errors") == 0
    )


def constant_within(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``by..., field`` for every column with more than one value (NULL counts as a value)."""
    pieces = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        pieces += [F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"), F.count(c).alias(f"_c_{c}")]
    grouped = rows.groupBy(*by).agg(*pieces)
    broken = F.array_compact(F.array(*[
        F.when(
            (F.col(f"_lo_{c}") != F.col(f"_hi_{c}"))
            | ((F.col(f"_c_{c}") > 0) & (F.col(f"_c_{c}") < F.col("_n"))),
            F.lit(c),
        )
        for c in columns
    ]))
    return grouped.select(*by, F.explode(broken).alias("field"))


def counts(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Rows per value of each dimension, in one pass (grouping sets of singletons)."""
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
        for d in dimensions
    ])
    return (
        rows.select(F.explode(entries).alias("e")).groupBy("e.dimension", "e.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def resource_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.max("peak_host_rss_mb").alias("peak_host_rss_mb"),
        F.max("peak_gpu_memory_mb").alias("peak_gpu_memory_mb"),
        F.min("gpu_free_mib").alias("minimum_preflight_free_gpu_mib"),
        F.max("gpu_temperature_c").alias("maximum_preflight_temperature_c"),
        F.max("gpu_guard_bytes").alias("maximum_gpu_guard_bytes"),
    )


def chain_hash(rows: DataFrame, columns: Sequence[str], digits: Sequence[int] = (5, 2)) -> DataFrame:
    """One digest of a whole inventory, independent of row order and partitioning.

    A tree of sorted digests: equal rows collapse to (digest, count) first, then
    leaves are grouped by ever shorter digest prefixes, so no list grows with the
    data. It is not the byte chain over one sorted document.
    """
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    level = rows.select(row.alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = level.agg(F.sum("n")).scalar()
    level = level.select(F.sha2(F.concat_ws("\0", "h", F.col("n").cast("string")), 256).alias("h"))
    for width in digits:
        level = level.groupBy(F.substring("h", 1, width).alias("p")).agg(
            F.array_sort(F.collect_list("h")).alias("hs")
        ).select(
            F.concat(F.substring("p", 1, width), F.sha2(F.concat_ws("", "hs"), 256)).alias("h")
        )
    return level.agg(F.sha2(F.concat_ws("", F.array_sort(F.collect_list("h"))), 256).alias("chain_sha256")).select(
        F.coalesce(total, F.lit(0)).alias("records"), "chain_sha256"
    )


def size_map(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instance to size, and the instances that state more than one size."""
    grouped = rows.groupBy("problem_instance").agg(
        F.min("n_configurations").alias("n_configurations"),
        F.max("n_configurations").alias("_hi"),
    )
    same = F.col("n_configurations") == F.col("_hi")
    bad = grouped.where(~same).select(
        "problem_instance", F.col("n_configurations").alias("lowest"), F.col("_hi").alias("highest")
    )
    return grouped.where(same).drop("_hi"), bad


def workload_entries(rows: DataFrame, constant: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One entry per (family, instance, hash) with member count, and constancy violations.

    Members stay rows (``timing_members``); the entry id hashes the key only.
    """
    by = ["family_id", "problem_instance", "input_sha256"]
    entries = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"), F.min("trial_id").alias("first_member"),
        F.max("trial_id").alias("last_member"), *[F.max(c).alias(c) for c in constant],
    ).withColumn("entry_id", F.sha2(F.concat_ws("\0", *by), 256))
    return entries, constant_within(rows, by, constant)


def rederive_diff(
    stored: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str],
    tolerance: float = 1e-12,
) -> DataFrame:
    """``keys, kind, field`` where a stored aggregate differs from a recomputed one."""
    numeric = {c for c, t in stored.dtypes if t in {"double", "float"}}
    l = stored.select(*[F.col(k).alias(f"_l_{k}") for k in keys],
                      *[F.col(c).alias(f"_l_{c}") for c in columns], F.lit(True).alias("_in_l"))
    r = fresh.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[F.col(c).alias(f"_r_{c}") for c in columns], F.lit(True).alias("_in_r"))
    on = None
    for k in keys:
        term = F.col(f"_l_{k}") == F.col(f"_r_{k}")
        on = term if on is None else on & term

    def equal(c: str) -> Column:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        if c in numeric:
            return a.eqNullSafe(b) | F.coalesce(close(a, b, tolerance, tolerance), F.lit(False))
        return a.eqNullSafe(b)

    labels = F.when(F.col("_in_l").isNull(), F.array(F.lit("not_stored"))).when(
        F.col("_in_r").isNull(), F.array(F.lit("not_derived"))
    ).otherwise(F.array_compact(F.array(*[F.when(~equal(c), F.lit(c)) for c in columns])))
    return l.join(r, on, "full_outer").select(
        *[F.coalesce(f"_l_{k}", f"_r_{k}").alias(k) for k in keys], F.explode(labels).alias("finding")
    )


def overlaps(
    rows: DataFrame, by: Sequence[str], key: str, start: str, finish: str, strong: bool = True
) -> DataFrame:
    """Trials that start before an earlier one on the same host has finished.

    ``strong`` looks at the latest finish of *all* earlier trials, otherwise only the
    direct predecessor counts. Rows are spread by host and minute.
    """
    order, minute = (start, key), [F.date_trunc("minute", F.col(start))]
    if strong:
        latest = {"earlier_finish": F.col(finish)}
        out = running(rows, by, order, minute, "max", latest, inclusive=False)
    else:
        out = previous(rows, by, order, minute, (finish,)).withColumnRenamed(
            f"prev_{finish}", "earlier_finish"
        )
    return out.where(F.col(start) < F.col("earlier_finish")).select(
        *by, key, start, "earlier_finish"
    )


def temporal_summary(rows: DataFrame, by: Sequence[str], start: str, finish: str) -> DataFrame:
    """Span, summed duration and negative intervals per host."""
    def seconds(a: Column, b: Column) -> Column:
        return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)

    s, f = F.col(start).cast("timestamp"), F.col(finish).cast("timestamp")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if(f < s).alias("negative_intervals"),
        seconds(F.max(f), F.min(s)).alias("span_s"),
        F.sum(seconds(f, s)).alias("busy_s"),
    )


# -- sets --------------------------------------------------------------------


def union_campaigns(campaigns: dict[str, DataFrame]) -> DataFrame:
    """Rows of all campaigns in one schema, labelled; absent columns are NULL."""
    out = None
    for name, rows in campaigns.items():
        tagged = rows.withColumn("campaign", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, kind`` for ids on one side only; one aggregation over both sides."""
    both = left.select(*keys, F.lit(1).alias("_s")).unionByName(right.select(*keys, F.lit(2).alias("_s")))
    sides = both.groupBy(*keys).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    return sides.where("_lo = _hi").select(
        *keys, F.when(F.col("_lo") == 1, "left_only").otherwise("right_only").alias("kind")
    )


def inventory_diff(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Files declared but absent, present but undeclared, or with other content."""
    kinds = {"missing_left": "undeclared", "missing_right": "absent", "field_mismatch": "changed"}
    mapping = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return reconcile(declared, observed, ["path"], ["size_bytes", "sha256"]).select(
        "path", mapping[F.col("kind")].alias("kind"), "field"
    )


def leakage(split: DataFrame, member: str, by: Sequence[str] = ("fold_id",)) -> DataFrame:
    """Members that occur in both roles of a fold."""
    sides = split.groupBy(*by, member).agg(
        F.count_if(F.col("role") == "train").alias("_a"), F.count_if(F.col("role") == "test").alias("_b")
    )
    return sides.where("_a > 0 AND _b > 0").select(*by, member)


def reused_members(members: DataFrame, group: str, member: str) -> DataFrame:
    """Members that belong to more than one group, with the number of groups."""
    return (
        members.select(group, member).distinct().groupBy(member)
        .agg(F.count(F.lit(1)).alias("groups")).where("groups > 1")
    )


def partition_check(members: DataFrame, universe: DataFrame, group: str, member: str) -> DataFrame:
    """Why the groups are no partition of the universe: reused, uncovered, foreign."""
    owned = members.select(group, member).distinct().groupBy(member).agg(
        F.count(F.lit(1)).alias("_groups"))
    both = owned.select(member, "_groups", F.lit(0).alias("_u")).unionByName(
        universe.select(member, F.lit(0).cast("bigint").alias("_groups"), F.lit(1).alias("_u"))
    ).groupBy(member).agg(F.sum("_groups").alias("_groups"), F.max("_u").alias("_u"))
    kind = (
        F.when(F.col("_groups") > 1, "reused").when(F.col("_groups") == 0, "uncovered")
        .when(F.col("_u") == 0, "foreign")
    )
    return both.withColumn("kind", kind).where("kind IS NOT NULL").select(member, "kind")


def members(groups: DataFrame, rows: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Groups with a ``record_ids`` list joined to their raw rows."""
    exploded = groups.select(*keys, F.explode("record_ids").alias("trial_id"))
    return exploded.join(rows.select("trial_id", *take), "trial_id", "left")


def overhead_share(latency: DataFrame, run_medians: DataFrame) -> DataFrame:
    """Hot selection median against the shortest run median, both as scalars."""
    shortest = run_medians.agg(F.min("wall_time_s_median")).scalar()
    return latency.withColumn("shortest_run_s", shortest).withColumn(
        "share", F.col("median_us") / F.lit(1e6) / F.col("shortest_run_s")
    )


def calibrate(
    pairs: DataFrame, energy_rtol: float, vector_atol: float
) -> tuple[DataFrame, DataFrame]:
    """Pairs whose energies and vectors agree across backends, and the violations."""
    linf, l2 = vector_parity(F.col("cpu_density"), F.col("gpu_density"))
    larger = F.greatest(F.abs("cpu_energy"), F.abs("gpu_energy"))
    measured = pairs.withColumn(
        "energy_relative_error",
        F.when(larger == 0, 0.0).otherwise(F.abs(F.col("cpu_energy") - F.col("gpu_energy")) / larger),
    ).withColumn("density_linf", linf).withColumn("density_l2", l2)
    failed = reasons([
        needs("density_length_mismatch", F.col("density_linf").isNotNull()),
        needs("energy_out_of_tolerance", F.col("energy_relative_error") <= energy_rtol),
        rule("density_out_of_tolerance", is_true(F.col("density_linf") > vector_atol)),
    ])
    marked = measured.withColumn("_bad", failed)
    keys = [c for c in pairs.columns if not c.startswith(("cpu_", "gpu_"))]
    return (
        marked.where(F.size("_bad") == 0).drop("_bad"),
        marked.select(*keys, F.explode("_bad").alias("rule")),
    )
