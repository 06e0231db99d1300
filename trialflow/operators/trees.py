"""Runtime trees: exact fits of all folds level by level, node tables, predictions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialflow.functions.scaled import running, value_bucket
from trialflow.operators.policy import ALLOWED_FEATURES, INSTANCE
from trialflow.session import materialized

TARGET = "target_log1p_median_wall_time_s"
#: fold that trains on every row
DEPLOYMENT = "deployment"
#: targets count in integers of this many to one, so sums are exact and equal splits tie
UNITS = 1_000_000_000
#: nodes whose variance is at most this are leaves
PURE = 1e-12

NODE_TABLE = T.StructType([
    T.StructField("fold_id", T.StringType()), T.StructField("feature_set", T.StringType()),
    T.StructField("node_id", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("feature", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.LongType()), T.StructField("right", T.LongType()),
    T.StructField("value", T.DoubleType()), T.StructField("impurity", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
])


def require_allowed(features: Sequence[str]) -> None:
    """Only features known before a run may reach a model."""
    extra = sorted(set(features) - ALLOWED_FEATURES)
    if extra:
        raise ValueError(f"features not known before the run: {extra}")


def _finite(column: str) -> Column:
    value = F.col(column).cast("double")
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(sound, value).otherwise(F.raise_error(F.lit(f"{column} is not a finite number")).cast("double"))


def _sums(*names: str) -> list[Column]:
    return [F.sum(c).cast("bigint" if c == "n" else "decimal(38,0)").alias(c) for c in names]


def _curves(nodes: DataFrame, placed: DataFrame, names: Sequence[str]) -> DataFrame:
    """n and s of every training value below each (fold, region) and feature.

    Rows are summed once per region, family and value; a fold's curve is the region's sum
    less that of its own family. Only these sums are taken once per fold.
    """
    entries = F.posexplode(F.col("x")).alias("feature", "value")
    own = placed.select("region", "family", "n", "s", entries).groupBy("region", "family", "feature", "value").agg(*_sums("n", "s"))
    own = materialized(own)
    whole = own.groupBy("region", "feature", "value").agg(*_sums("n", "s"))
    wanted = nodes.select("fold_id", "region", F.explode("features").alias("feature")).distinct()
    left_out = own.select("region", F.col("family").alias("fold_id"), "feature", "value", F.col("n").alias("n0"), F.col("s").alias("s0"))
    rows = wanted.join(whole, ["region", "feature"]).join(left_out, ["region", "fold_id", "feature", "value"], "left")
    return rows.select(
        "fold_id", "region", "feature", "value", (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"),
        (F.col("s") - F.coalesce("s0", F.lit(0))).cast("decimal(38,0)").alias("s")).where("n > 0")


def _best_cuts(nodes: DataFrame, curves: DataFrame, min_leaf: int) -> DataFrame:
    """The cut of each (fold, region, feature) that leaves the least squared error.

    Cuts lie midway between neighbouring training values. Ties go to the lower cut.
    """
    keys = ["fold_id", "region", "feature"]
    steps = running(
        curves, keys, ["value"], [value_bucket(F.col("value"), 64)], {"ln": "sum", "ls": "sum", "below": "max"},
        {"ln": F.col("n"), "ls": F.col("s"), "below": F.col("value")}, inclusive=False, null_keys=False)
    totals = nodes.select("fold_id", "region", F.col("n").alias("all_n"), F.col("s").alias("all_s")).distinct()
    cuts = steps.join(totals, ["fold_id", "region"]).withColumn("rn", F.col("all_n") - F.col("ln"))
    left, right = F.col("ls").cast("double"), (F.col("all_s") - F.col("ls")).cast("decimal(38,0)").cast("double")
    gain = left * left / F.col("ln") + right * right / F.col("rn")
    cuts = cuts.where((F.col("ln") >= min_leaf) & (F.col("rn") >= min_leaf))
    return cuts.groupBy(*keys).agg(F.min(F.struct((-gain).alias("loss"), "value", ((F.col("below") + F.col("value")) / 2).alias("threshold"))).alias("cut"))


def grow_trees(
    rows: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    fold_column: str = "family_id",
    max_depth: int = 3,
    min_leaf: int = 2,
    deployment: bool = False,
    held_out: bool = True,
) -> DataFrame:
    """Node tables of least-squares trees: one per feature set and complement fold.

    A fold trains on the rows of all other values of ``fold_column``; ``deployment`` adds
    the fold of that name, which trains on every row, and ``held_out=False`` leaves only it.
    All folds and feature sets grow together, one level at a time. Folds that split alike
    share a region of the data, so rows are multiplied by different splits, not by folds,
    and the level's job is one aggregate of rows and one pass over its sums. Rows with equal
    features of one fold always go together, so they are counted and summed before the first level.

    A node splits while its variance is above ``PURE``, at the cut with the least squared
    error that leaves ``min_leaf`` rows on both sides; ties go to the earlier feature, then
    to the lower cut. Targets are rounded to 1e-9. Nodes are numbered in preorder. A
    feature or target that is null or not finite is an error; rows of a null fold train
    every fold; without rows there is no tree.
    """
    names = list(dict.fromkeys(f for features in feature_sets.values() for f in features))
    require_allowed(names)
    unit = F.round(_finite(TARGET) * UNITS).cast("decimal(19,0)")
    square = (F.col("y") * F.col("y")).cast("decimal(38,0)")
    placed = materialized(rows.select(
        F.col(fold_column).cast("string").alias("family"), F.array(*[_finite(f) for f in names]).alias("x"), unit.alias("y")
    ).groupBy("family", "x").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("decimal(38,0)").alias("s"), F.sum(square).cast("decimal(38,0)").alias("q")
    ).withColumn("region", F.lit("")))
    folds = placed.where("family IS NOT NULL").select(F.col("family").alias("fold_id")).distinct() if held_out else placed.select(F.lit(DEPLOYMENT).alias("fold_id")).limit(0)
    if deployment or not held_out:
        folds = folds.union(placed.select(F.lit(DEPLOYMENT).alias("fold_id")).limit(1))
    sets = F.array(*[F.struct(F.lit(k).alias("feature_set"), F.array(*[F.lit(names.index(f)) for f in fs]).alias("features")) for k, fs in feature_sets.items()])
    nodes = folds.select("fold_id", F.explode(sets).alias("_s")).select("fold_id", "_s.*", F.lit("").alias("path"), F.lit("").alias("region"))
    levels = []
    for depth in range(max_depth + 1):
        own = placed.groupBy("region", "family").agg(*_sums(*"nsq"))
        whole = own.groupBy("region").agg(*_sums(*"nsq"))
        left_out = own.select("region", F.col("family").alias("fold_id"), *[F.col(c).alias(f"{c}0") for c in "nsq"])
        known = nodes.join(whole, "region").join(left_out, ["region", "fold_id"], "left").select(
            *nodes.columns, *[(F.col(c) - F.coalesce(f"{c}0", F.lit(0))).cast("bigint" if c == "n" else "decimal(38,0)").alias(c) for c in "nsq"]).where("n > 0")
        mean = F.col("s").cast("double") / F.col("n")
        known = materialized(known.select(
            "*", (mean / UNITS).alias("value"), (F.greatest(F.col("q").cast("double") / F.col("n") - mean * mean, F.lit(0.0)) / UNITS / UNITS).alias("impurity")))
        if depth == max_depth:
            levels.append(known.select("*", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold")))
            break
        open_ = known.where((F.col("impurity") > PURE) & (F.col("n") >= 2 * min_leaf))
        cuts = _best_cuts(open_, _curves(open_, placed, names), min_leaf)
        asked = open_.select("fold_id", "feature_set", "path", "region", F.posexplode("features").alias("rank", "feature"))
        best = asked.join(cuts, ["fold_id", "region", "feature"]).groupBy("fold_id", "feature_set", "path").agg(
            F.min(F.struct("cut.loss", "rank", "cut.value", "feature", "cut.threshold")).alias("b"))
        split = materialized(known.join(best, ["fold_id", "feature_set", "path"], "left").select(*known.columns, "b.feature", "b.threshold"))
        levels.append(split)
        parents = split.where("feature IS NOT NULL")
        # the same split of the same region is one pair of regions for all folds
        rule = F.concat("region", F.lit("/"), F.col("feature").cast("string"), F.lit(":"), F.col("threshold").cast("string"))
        side = F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side")
        nodes = parents.select("fold_id", "feature_set", "features", "path", rule.alias("rule"), side).select(
            "fold_id", "feature_set", "features", F.concat("path", "side").alias("path"), F.concat("rule", "side").alias("region"))
        splits = parents.select("region", "feature", "threshold", rule.alias("rule")).distinct()
        goes = F.when(F.col("x")[F.col("feature")] <= F.col("threshold"), "L").otherwise("R")
        placed = materialized(placed.join(splits, "region").select("family", "x", *"nsq", F.concat("rule", goes).alias("region")))
    table = levels[0]
    for level in levels[1:]:
        table = table.unionByName(level)
    # preorder is the order of the paths; a tree has at most 2 ** (depth + 1) - 1 of them
    paths = table.groupBy("fold_id", "feature_set").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    at = lambda p: (F.array_position("paths", p) - 1).cast("bigint")
    inner, labels = F.col("feature").isNotNull(), F.array(*[F.lit(n) for n in names])
    return table.join(paths, ["fold_id", "feature_set"]).select(
        "fold_id", "feature_set", at(F.col("path")).alias("node_id"), F.when(inner, "split").otherwise("leaf").alias("type"),
        F.when(inner, labels[F.coalesce("feature", F.lit(0))]).alias("feature"), "threshold",
        F.when(inner, at(F.concat("path", F.lit("L")))).alias("left"), F.when(inner, at(F.concat("path", F.lit("R")))).alias("right"),
        "value", "impurity", F.col("n").alias("sample_count"))


def fit_tree(train: DataFrame, features: Sequence[str], max_depth: int = 3, min_leaf: int = 2) -> list[dict]:
    """One tree on the log runtime, as a node list; its size is bounded by the depth."""
    nodes = grow_trees(train.withColumn("_fold", F.lit(None).cast("string")), {"one": features}, "_fold", max_depth, min_leaf, held_out=False)
    return [{k: v for k, v in r.asDict().items() if v is not None and k not in ("fold_id", "feature_set")} for r in nodes.orderBy("node_id").collect()]


def node_table(spark, models: dict[tuple[str, str], list[dict]]) -> DataFrame:
    """Long node table of node lists."""
    names = NODE_TABLE.names[2:]
    rows = [(fold, name, *[n.get(k) for k in names]) for (fold, name), nodes in sorted(models.items()) for n in nodes]
    return spark.createDataFrame(rows, NODE_TABLE)


def without_deployment(models: DataFrame) -> DataFrame:
    """Held-out metrics never use the model fitted on all rows."""
    return models.where(F.col("fold_id") != DEPLOYMENT)


def tree_violations(models: DataFrame) -> DataFrame:
    """fold_id, feature_set and rule of node tables that no row may be scored with."""
    parents = models.where("type = 'split'").select("fold_id", "feature_set", F.explode(F.array("left", "right")).alias("node_id"))
    seen = parents.groupBy("fold_id", "feature_set", "node_id").agg(F.count(F.lit(1)).alias("parents"))
    own = models.groupBy("fold_id", "feature_set", "node_id").agg(
        F.count(F.lit(1)).alias("copies"), F.max("type").alias("type"), F.max("feature").alias("feature"), F.max("threshold").alias("threshold"), F.max("value").alias("value"))
    both = own.join(seen, ["fold_id", "feature_set", "node_id"], "full")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    allowed = F.col("feature").isin(*sorted(ALLOWED_FEATURES))
    found = F.array_compact(F.array(
        F.when(F.col("copies") > 1, "node_repeated"), F.when(F.col("copies").isNull(), "node_missing"),
        F.when(F.coalesce("parents", F.lit(0)) != F.when(F.col("node_id") == 0, 0).otherwise(1), "not_a_tree"),
        F.when(~F.coalesce(F.col("type").isin("split", "leaf"), F.lit(False)) & F.col("copies").isNotNull(), "unknown_type"),
        F.when((F.col("type") == "split") & ~F.coalesce(allowed, F.lit(False)), "feature_not_allowed"),
        F.when((F.col("type") == "split") & ~finite("threshold"), "threshold_not_finite"),
        F.when((F.col("type") == "leaf") & ~finite("value"), "value_not_finite")))
    return both.select("fold_id", "feature_set", "node_id", F.explode(found).alias("rule"))


def predicted_by_fold(rows: DataFrame, models: DataFrame, fold_column: str, depth: int = 3) -> DataFrame:
    """``rows`` with feature_set and predicted: every row scored by the trees of its own fold.

    A tree travels as one array of at most 2 ** (depth + 1) - 1 nodes, joined on the fold;
    a row steps from node to node inside it. At or below a threshold goes left.
    """
    features = sorted({c for c in rows.columns} & ALLOWED_FEATURES)
    cell = F.struct("node_id", F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature")).cast("int").alias("f"), "threshold", "left", "right", "value")
    trees = models.groupBy(F.col("fold_id").alias("_fold"), "feature_set").agg(F.sort_array(F.collect_list(cell)).alias("_nodes"))
    values = F.array(*[F.col(f).cast("double") for f in features])
    scored = rows.withColumn("_x", values).join(trees, rows[fold_column] == F.col("_fold"))

    def step(node):
        goes_left = F.element_at(F.col("_x"), node["f"]) <= node["threshold"]
        return F.when(node["left"].isNull(), node).otherwise(F.element_at(F.col("_nodes"), (F.when(goes_left, node["left"]).otherwise(node["right"]) + 1).cast("int")))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.element_at("_nodes", 1), lambda node, _: step(node))
    return scored.select(*rows.columns, "feature_set", last["value"].alias("predicted"))


def tree_column(nodes: Sequence[dict]) -> Column:
    """One nested CASE expression: at or below a threshold goes left.

    Cycles, missing nodes and non-finite numbers are rejected while compiling.
    """
    by_id: dict[int, dict] = {}
    for node in nodes:
        if node["node_id"] in by_id:
            raise ValueError(f"duplicate node {node['node_id']}")
        by_id[node["node_id"]] = node

    def build(index: int, seen: frozenset) -> Column:
        if index in seen:
            raise ValueError("tree contains a cycle")
        node = by_id.get(index)
        if node is None:
            raise ValueError(f"tree references missing node {index}")
        if node["type"] == "leaf":
            if not math.isfinite(node["value"]):
                raise ValueError("leaf value is not finite")
            return F.lit(float(node["value"]))
        if node["type"] != "split":
            raise ValueError(f"node {index} has an unknown type")
        if not math.isfinite(node["threshold"]):
            raise ValueError("threshold is not finite")
        path = seen | {index}
        return F.when(
            F.col(node["feature"]) <= F.lit(float(node["threshold"])), build(node["left"], path)
        ).otherwise(build(node["right"], path))

    return build(0, frozenset())


def select_by_tree(candidates: DataFrame, predicted: Column, is_feasible: Column) -> DataFrame:
    """Drop infeasible candidates, predict, take the least prediction per instance."""
    scored = candidates.select(
        *INSTANCE, "candidate_name", is_feasible.alias("_ok"), predicted.alias("predicted")
    )
    ok = F.coalesce(F.col("_ok"), F.lit(False))
    chosen = scored.groupBy(*INSTANCE).agg(
        F.min(F.when(ok, F.struct("predicted", "candidate_name"))).alias("_s"),
    )
    return chosen.select(
        *INSTANCE, F.col("_s.candidate_name").alias("selected_candidate_name"),
        F.col("_s.predicted").alias("predicted"),
        F.when(F.col("_s").isNull(), "no_feasible_candidates").alias("invalid_reason"),
    )


def tree_shapes(nodes: DataFrame) -> DataFrame:
    """Nodes, leaves, depth and least sample count of every tree."""
    keys = ["fold_id", "feature_set"]
    own = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node_id", "left", "right", "type", "sample_count"))).alias("n"))
    # preorder: a node stands behind its parent, so one pass over the bounded list knows all depths
    parent = lambda i: F.filter("n", lambda p: (p["left"] == i) | (p["right"] == i))
    grown = F.aggregate("n", F.array().cast("array<int>"), lambda depths, x: F.concat(depths, F.array(
        F.when(x["node_id"] == 0, 0).otherwise(F.element_at(depths, (parent(x["node_id"])[0]["node_id"] + 1).cast("int")) + 1))))
    return own.select(
        *keys, F.size("n").cast("bigint").alias("nodes"), F.size(F.filter("n", lambda x: x["type"] == "leaf")).cast("bigint").alias("leaves"),
        F.array_max(grown).cast("bigint").alias("depth"), F.array_min(F.transform("n", lambda x: x["sample_count"])).alias("least"))


def picked_by_fold(candidates: DataFrame, models: DataFrame, is_feasible: Column, names: dict[str, str], fold_column: str = "family_id") -> DataFrame:
    """One row per instance: the feasible candidate with the least prediction of each feature set's tree.

    ``names`` maps feature sets to output columns; without a feasible candidate they are NULL.
    ``<column>_predictions`` has the predictions of the candidates by name.
    """
    scored = predicted_by_fold(candidates.withColumn("_ok", F.coalesce(is_feasible, F.lit(False))), models, fold_column)
    return scored.groupBy(*INSTANCE).agg(*[
        F.min(F.when(F.col("_ok") & (F.col("feature_set") == k), F.struct("predicted", "candidate_name")))["candidate_name"].alias(v) for k, v in names.items()], *[
        # an instance has its registered candidates only
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("feature_set") == k, F.struct("candidate_name", "predicted"))))).alias(f"{v}_predictions")
        for k, v in names.items()])
