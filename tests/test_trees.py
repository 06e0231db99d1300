"""Exact trees against a plain recursive fit, fold scoring, node-table rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trialflow.operators import policy as P
from trialflow.operators import trees

NAMES = list(P.FULL_FEATURES)


def plain(rows, features, depth, leaf):
    """Preorder nodes of one tree on (x, y) rows, y in units of 1e-9."""
    nodes = []

    def visit(part, level):
        at, n, s = len(nodes), len(part), sum(y for _, y in part)
        mean = s / n
        spread = max(sum(y * y for _, y in part) / n - mean * mean, 0) / 1e9 / 1e9
        node = {"node_id": at, "type": "leaf", "value": mean / 1e9, "sample_count": n}
        nodes.append(node)
        if level == depth or spread <= trees.PURE:
            return at
        best = None
        for rank, f in enumerate(features):
            values = sorted({x[f] for x, _ in part})
            for u, v in zip(values, values[1:]):
                left = [y for x, y in part if x[f] < v]
                ln, rn, ls = len(left), n - len(left), sum(left)
                if ln >= leaf and rn >= leaf:
                    cut = (-(float(ls) * ls / ln + float(s - ls) * (s - ls) / rn), rank, v, f, (u + v) / 2)
                    best = cut if best is None or cut < best else best
        if best:
            *_, f, threshold = best
            node.update(type="split", feature=NAMES[f], threshold=threshold)
            node["left"] = visit([r for r in part if r[0][f] <= threshold], level + 1)
            node["right"] = visit([r for r in part if r[0][f] > threshold], level + 1)
        return at

    visit(rows, 0)
    return nodes


def data(seed, n, families, kinds=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [float(rng.randint(0, kinds)) if k < 5 else rng.random() for k in range(len(NAMES))]
        y = round(math.log1p(abs(x[0] * 2 - x[1]) + (x[5] > 0.5) + rng.choice([0, 0, 1])) * 1e9)
        # a third of the rows belong to one family
        out.append((f"f{0 if rng.random() < 0.4 else rng.randrange(families)}", x, y))
    return out


def frame(spark, rows):
    schema = "family_id string, problem_instance string, candidate_name string, " + ", ".join(f"{n} double" for n in NAMES) + f", {trees.TARGET} double, n int, s string"
    return spark.createDataFrame([(f, f"i{k // 2}", ("cpu-16", "gpu-1")[k % 2], *x, y / 1e9, 1, "clash") for k, (f, x, y) in enumerate(rows)], schema)


def found(table):
    out = {}
    for r in table.orderBy("fold_id", "feature_set", "node_id").collect():
        node = {k: v for k, v in r.asDict().items() if v is not None and k not in ("fold_id", "feature_set", "impurity")}
        out.setdefault((r["fold_id"], r["feature_set"]), []).append(node)
    return out


@pytest.mark.parametrize("seed, depth, leaf", [(1, 3, 2), (2, 2, 1), (3, 1, 30)])
def test_all_folds_equal_a_plain_fit(spark, seed, depth, leaf):
    rows = data(seed, 160, 4)
    sets = {"size_only": P.SIZE_FEATURES, "full": P.FULL_FEATURES}
    got = found(trees.grow_trees(frame(spark, rows), sets, max_depth=depth, min_leaf=leaf, deployment=True))
    want = {}
    for fold in [*sorted({f for f, _, _ in rows}), trees.DEPLOYMENT]:
        train = [(x, y) for f, x, y in rows if f != fold]
        for name, features in sets.items():
            want[fold, name] = plain(train, [NAMES.index(f) for f in features], depth, leaf)
    assert got == want


def test_more_values_than_bins_keep_exact_midpoints(spark):
    rows = [("a", [float(i), *[0.0] * 9], 1_000_000_000 if i <= 1233 else 2_000_000_000) for i in range(3000)] + [("b", [0.0] * 10, 1_000_000_000)]
    got = found(trees.grow_trees(frame(spark, rows), {"size_only": P.SIZE_FEATURES}, deployment=True))
    assert got["deployment", "size_only"][0]["threshold"] == 1233.5 and len(got["deployment", "size_only"]) == 3
    assert got["a", "size_only"] == [{"node_id": 0, "type": "leaf", "value": 1.0, "sample_count": 1}]


def test_rows_without_a_fold_train_every_fold_and_empty_input_has_no_tree(spark):
    rows = [(None, [1.0] * 10, 5), ("a", [2.0] * 10, 7), ("a", [2.0] * 10, 7)]
    got = found(trees.grow_trees(frame(spark, rows), {"full": P.FULL_FEATURES}, deployment=True))
    assert got["a", "full"][0]["sample_count"] == 1 and got["deployment", "full"][0]["sample_count"] == 3
    assert trees.grow_trees(frame(spark, rows).limit(0), {"full": P.FULL_FEATURES}, deployment=True).count() == 0
    # a family without other rows has nothing to train on
    assert trees.grow_trees(frame(spark, rows[1:]), {"full": P.FULL_FEATURES}).count() == 0


@pytest.mark.parametrize("value", [None, float("nan"), float("inf")])
def test_features_and_targets_must_be_finite(spark, value):
    for column in (trees.TARGET, "cpu_threads"):
        bad = frame(spark, data(1, 6, 2)).withColumn(column, F.lit(value).cast("double"))
        with pytest.raises(Exception, match="not a finite number"):
            trees.grow_trees(bad, {"full": P.FULL_FEATURES}).count()


def test_rows_are_scored_by_the_trees_of_their_own_fold(spark):
    rows = data(4, 120, 3)
    df = frame(spark, rows)
    sets = {"size_only": P.SIZE_FEATURES, "full": P.FULL_FEATURES}
    models = trees.grow_trees(df, sets)
    lists = found(models)
    got = {(r["problem_instance"], r["candidate_name"], r["feature_set"]): r["predicted"]
           for r in trees.predicted_by_fold(df, models, "family_id").collect()}
    assert len(got) == 2 * len(rows)
    for (fold, name), nodes in lists.items():
        for r in df.where(F.col("family_id") == fold).withColumn("p", trees.tree_column(nodes)).collect():
            assert got[r["problem_instance"], r["candidate_name"], name] == r["p"]
    shapes = {(r["fold_id"], r["feature_set"]): r for r in trees.tree_shapes(models).collect()}
    for key, nodes in lists.items():
        depths = {0: 0}
        for n in nodes:
            if n["type"] == "split":
                depths |= {n["left"]: depths[n["node_id"]] + 1, n["right"]: depths[n["node_id"]] + 1}
        assert tuple(shapes[key])[2:] == (len(nodes), sum(n["type"] == "leaf" for n in nodes), max(depths.values()), min(n["sample_count"] for n in nodes))


def test_broken_node_tables_are_reported(spark):
    split = {"type": "split", "feature": "cpu_threads", "threshold": 1.0, "value": 0.0}
    tables = {
        ("ok", "s"): [{"node_id": 0, **split, "left": 1, "right": 2}, {"node_id": 1, "type": "leaf", "value": 1.0}, {"node_id": 2, "type": "leaf", "value": 2.0}],
        ("loop", "s"): [{"node_id": 0, **split, "left": 0, "right": 1}, {"node_id": 1, "type": "leaf", "value": 1.0}],
        ("gap", "s"): [{"node_id": 0, **split, "left": 1, "right": 2}, {"node_id": 1, "type": "leaf", "value": float("nan")}],
        ("twice", "s"): [{"node_id": 0, "type": "leaf", "value": 1.0}, {"node_id": 0, "type": "leaf", "value": 1.0}],
        ("leak", "s"): [{"node_id": 0, **split, "feature": "wall_time_s", "threshold": None, "left": 1, "right": 2}, {"node_id": 1, "type": "odd", "value": 1.0}, {"node_id": 2, "type": "leaf", "value": 1.0}],
    }
    bad = {(r["fold_id"], r["node_id"], r["rule"]) for r in trees.tree_violations(trees.node_table(spark, tables)).collect()}
    assert bad == {("loop", 0, "not_a_tree"), ("gap", 1, "value_not_finite"), ("gap", 2, "node_missing"), ("twice", 0, "node_repeated"),
                   ("leak", 0, "feature_not_allowed"), ("leak", 0, "threshold_not_finite"), ("leak", 1, "unknown_type")}
