"""Contract of the balanced model dataset: feature maps, provenance, re-derived summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialflow.functions.identity import is_digest
from trialflow.operators.policy import ALLOWED_FEATURES, FULL_FEATURES
from trialflow.operators.rules import needs, reasons, rule

# fixed values: fields that say where a row comes from and never feed a model
PROVENANCE = ("family_id", "molecule", "basis", "basis_status")
#: fields that all rows of an instance share and its summary repeats
SHARED = ("family_id", "problem_instance", "input_sha256", "n_configurations", "host_cap_bytes", "gpu_cap_bytes")


def instance_id() -> Column:
    return F.concat_ws("::", "family_id", "problem_instance")


def feature_map(features: Sequence[str] = FULL_FEATURES) -> Column:
    """The named columns as one map, the form in which a dataset row carries its features."""
    return F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])


def dataset_rows(modelled: DataFrame, features: Sequence[str] = FULL_FEATURES) -> DataFrame:
    """Candidate rows of the dataset from balanced rows with their model features."""
    return modelled.select(
        instance_id().alias("instance_id"), *SHARED, "candidate_name", "source_record_ids", feature_map(features).alias("feature_values"))


def feature_violations(rows: DataFrame, features: Sequence[str] = FULL_FEATURES) -> DataFrame:
    """``instance_id, candidate_name, feature, rule`` where a feature map is not the allow-list.

    The map's keys must be the registered features exactly, none of them a field of
    provenance, each value finite; the registered list itself must be allowed. A row
    without a map lacks every feature.
    """
    leaked = sorted(set(features) - ALLOWED_FEATURES)
    if leaked:
        raise ValueError(f"features not known before the run: {leaked}")
    wanted = F.array(*[F.lit(f) for f in features])
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.map_keys("feature_values"), none)
    value = lambda k: F.col("feature_values")[k]
    odd = lambda k: F.isnull(value(k)) | F.isnan(value(k)) | (F.abs(value(k)) == float("inf"))
    known, source = F.array_intersect(keys, wanted), F.array(*[F.lit(p) for p in PROVENANCE])
    named = lambda found, name: F.transform(found, lambda k: F.struct(k.alias("feature"), F.lit(name).alias("rule")))
    found = F.concat(
        named(F.array_except(wanted, keys), "feature_missing"), named(F.array_except(keys, wanted), "feature_not_allowed"),
        named(F.array_intersect(keys, source), "provenance_as_feature"), named(F.filter(known, odd), "feature_not_finite"))
    return rows.select("instance_id", "candidate_name", F.explode(found).alias("f")).select("instance_id", "candidate_name", "f.*")


def _subject(*names: str) -> Column:
    return F.concat_ws("/", *names).alias("subject")


def row_violations(rows: DataFrame, candidates: Sequence[str], repetitions: int = 3) -> DataFrame:
    """``subject, rule`` of candidate rows that break their own contract."""
    found = reasons([
        needs("instance_id_differs", F.col("instance_id") == instance_id()),
        needs("input_not_digest", is_digest(F.col("input_sha256"))),
        needs("candidate_not_registered", F.col("candidate_name").isin(*candidates)),
        needs("source_count_differs", F.size("source_record_ids") == repetitions),
    ])
    return rows.select(_subject("instance_id", "candidate_name"), F.explode(found).alias("rule"))


def source_violations(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``subject, rule`` of records cited by several rows, or cited and listed not alike.

    ``listed`` has the dataset's record ids as trial_id. One aggregate over both sides.
    """
    cited = rows.select(F.explode("source_record_ids").alias("trial_id"), F.lit(1).alias("c"), F.lit(0).alias("l"))
    both = cited.unionByName(listed.select("trial_id", F.lit(0).alias("c"), F.lit(1).alias("l")))
    counts = both.groupBy("trial_id").agg(F.sum("c").alias("c"), F.sum("l").alias("l"))
    found = reasons([
        rule("source_reused", F.col("c") > 1), rule("source_listed_twice", F.col("l") > 1),
        rule("source_not_listed", (F.col("c") > 0) & (F.col("l") == 0)), rule("source_not_cited", (F.col("c") == 0) & (F.col("l") > 0)),
    ])
    return counts.select(F.col("trial_id").alias("subject"), F.explode(found).alias("rule"))


def instance_summaries(rows: DataFrame) -> DataFrame:
    """One row per instance: shared fields, candidate and record counts, and whether its rows agree."""
    alike = [F.min(c).eqNullSafe(F.max(c)) for c in SHARED]
    agreed = alike[0]
    for test in alike[1:]:
        agreed = agreed & test
    return rows.groupBy("instance_id").agg(
        *[F.min(c).alias(c) for c in SHARED], F.count(F.lit(1)).alias("candidate_rows"),
        F.count_distinct("candidate_name").alias("candidates"), F.sum(F.size("source_record_ids")).alias("source_records"), agreed.alias("agreed"))


def family_summaries(rows: DataFrame) -> DataFrame:
    """One row per family: instances, candidate rows and measurement records."""
    return rows.groupBy("family_id").agg(
        F.count_distinct("instance_id").alias("instances"), F.count(F.lit(1)).alias("candidate_rows"),
        F.sum(F.size("source_record_ids")).alias("measurement_records"))


def _compared(derived: DataFrame, stored: DataFrame, key: str, columns: Sequence[str], name: str, extra: Sequence = ()) -> DataFrame:
    old = stored.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    both = derived.withColumn("_here", F.lit(True)).join(old, F.col(key) == F.col("_k"), "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    here, there = F.col("_here").isNotNull(), F.col("_there").isNotNull()
    found = reasons([
        rule(f"{name}_summary_missing", here & ~there), rule(f"{name}_without_rows", there & ~here),
        rule(f"{name}_summary_differs", here & there & ~same), *[rule(n, here & F.coalesce(test, F.lit(False))) for n, test in extra],
    ])
    return both.select(F.coalesce(key, "_k").alias("subject"), F.explode(found).alias("rule"))


def dataset_violations(
    rows: DataFrame, listed: DataFrame, instances: DataFrame, families: DataFrame, candidates: Sequence[str], repetitions: int = 3
) -> DataFrame:
    """``subject, rule`` of everything in which a stored dataset departs from its contract.

    Rows, cited records, and the stored instance and family summaries, which are derived
    again from the rows. Feature maps are judged by :func:`feature_violations`.
    """
    derived = instance_summaries(rows)
    per_instance = _compared(derived, instances, "instance_id", [*SHARED, "source_records"], "instance", [
        ("candidates_incomplete", (F.col("candidates") != len(candidates)) | (F.col("candidate_rows") != len(candidates))),
        ("candidates_disagree", ~F.col("agreed"))])
    per_family = _compared(family_summaries(rows), families, "family_id", ["instances", "candidate_rows", "measurement_records"], "family")
    return row_violations(rows, candidates, repetitions).unionByName(source_violations(rows, listed)).unionByName(per_instance).unionByName(per_family)
