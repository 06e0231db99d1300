"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

The tree is fitted on a bounded sample and broadcast; every row goes to one leaf. A query
walks the tree with a priority queue that holds the nearest unopened branches, and visits
leaves in that order. How many leaves is calibrated: brute force answers a bounded set of
queries, and visits widen until the share of true neighbours found reaches the target.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialflow.llm.topk import arrays, ranked_rows, usable
from trialflow.session import materialized

#: most rows that a fit of the tree sees, and most queries that calibrate it
SAMPLE, CALIBRATION = 20_000, 128
BRANCHES, LEAF_ROWS = 12, 60
RECALL = 0.97
ROW_BLOCK = 1024
#: neighbours that a task holds before it merges them
MERGED = 1 << 19


@dataclass
class Tree:
    centres: np.ndarray
    #: first child and number of children of each node; leaves have none
    first: np.ndarray
    count: np.ndarray

    def leaves(self) -> int:
        return int((self.count == 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        at = np.zeros(len(x), int)
        while (inner := self.count[at] > 0).any():
            for node in np.unique(at[inner]):
                rows = at == node
                kids = slice(self.first[node], self.first[node] + self.count[node])
                at[rows] = self.first[node] + _distances(x[rows], self.centres[kids]).argmin(axis=1)
        return at

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves of one query, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                out.append(node)
                continue
            kids = range(self.first[node], self.first[node] + self.count[node])
            for d, k in zip(_distances(q[None, :], self.centres[kids.start : kids.stop])[0], kids, strict=True):
                heapq.heappush(queue, (float(d), k))
        return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else centres[j] for j in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return centres, _distances(x, centres).argmin(axis=1)


def grow(x: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 4) -> Tree:
    """A tree whose leaves hold at most ``leaf_rows`` sampled rows, or equal rows."""
    rng = np.random.default_rng(seed)
    centres, first, count = [x.mean(axis=0)], [0], [0]
    todo = [(0, x)]
    while todo:
        node, rows = todo.pop(0)
        distinct = np.unique(rows, axis=0)
        if len(rows) <= leaf_rows or len(distinct) < 2:
            continue
        mids, near = _kmeans(distinct, min(branches, len(distinct)), rng)
        owner = _distances(rows, mids).argmin(axis=1)
        live = [j for j in range(len(mids)) if (owner == j).any()]
        if len(live) < 2:
            continue
        first[node], count[node] = len(centres), len(live)
        for j in live:
            todo.append((len(centres), rows[owner == j]))
            centres.append(mids[j])
            first.append(0)
            count.append(0)
    return Tree(np.array(centres), np.array(first), np.array(count))


def _nearest(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, cv: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and candidates and their distances: the k nearest of each query.

    A matrix product finds what can be among them, with room for its rounding; distances
    and ties are judged on the differences themselves. A row is no candidate for its own id.
    """
    near = qi[:, None] != ci[None, :]
    with np.errstate(all="ignore"):
        rough = _distances(q, cv)
        if len(ci) > k and np.isfinite(rough).all():
            rough[~near] = np.inf
            room = 1e-10 * ((q * q).sum(axis=1) + (cv * cv).sum(axis=1).max())
            near &= rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + room)[:, None]
    a, b = np.nonzero(near)
    d = np.empty(len(a))
    for i in range(0, len(a), 1 << 15):
        part = slice(i, i + (1 << 15))
        d[part] = np.sqrt(((cv[b[part]] - q[a[part]]) ** 2).sum(axis=1))
    order = np.lexsort((ci[b], d, a))
    a, b, d = a[order], b[order], d[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < k
    return a[keep], b[keep], d[keep]


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest rows found.

    Vectors null, empty, zero or holding null or non-finite components take no part, nor do
    null ids; vectors of each length are searched among themselves, one tree per length.
    A row never answers the query with its own id; repeated rows are candidates each and a
    repeated query counts once. A query goes on past the calibrated number of leaves until
    they hold k other rows, so it has fewer than k neighbours only where there are fewer
    candidates; at most ``LEAF_ROWS`` rows make one leaf, which is a full search. Empty
    tables give an empty result.
    """
    spark = table.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    whole = lambda df: usable(df, key, vector).where(F.exists("v", lambda x: x != 0))
    rows = whole(table)
    asked = whole(queries).groupBy("id", F.size("v").alias("d")).agg(F.min("v").alias("v"), F.count("*").alias("own"))
    out = None
    for size in sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()):
        found = _of_length(rows.where(F.size("v") == size), asked.where(F.col("d") == size).drop("d"), k, recall, sample)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _of_length(rows: DataFrame, asked: DataFrame, k: int, recall: float, sample: int) -> DataFrame:
    """The search among vectors of one length; ``asked`` has id, v and the number of its own rows."""
    spark = rows.sparkSession
    rows, asked = materialized(rows), materialized(asked)
    n = rows.count()
    picked = rows.orderBy(F.xxhash64(F.lit(4), "id"), "id").limit(sample).select("v").toPandas()["v"]
    # leaves stay of one size in rows of the whole table as long as the sample allows it
    tree = grow(np.stack(picked.to_numpy()).astype(float), max(8, round(LEAF_ROWS * len(picked) / n)))
    held = spark.sparkContext.broadcast(tree)

    def placed(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(float)
                yield pd.DataFrame({"leaf": held.value.assign(x).astype("int32"), "id": pdf["id"].to_numpy(), "v": [r.tobytes() for r in x]})

    leaves = materialized(rows.mapInPandas(placed, "leaf int, id bigint, v binary"))

    def packed(pdf):
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "ids": [pdf["id"].to_numpy("int64").tobytes()], "vs": [b"".join(pdf["v"])]})

    # a leaf of many rows is several blocks
    per = leaves.groupBy("leaf").count()
    # as many numbers as the tree has nodes, which the sample bounds
    filled = np.zeros(len(tree.count), np.int64)
    for r in per.collect():
        filled[r["leaf"]] = r["count"]
    split = leaves.join(per, "leaf").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / ROW_BLOCK)).cast("int"))
    blocks = materialized(split.select("leaf", "part", "id", "v").groupBy("leaf", "part").applyInPandas(packed, "leaf int, ids binary, vs binary"))

    # calibration: brute force for a bounded set of queries, and the rank of each true neighbour's leaf
    few = asked.orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(CALIBRATION).collect()
    probe = spark.sparkContext.broadcast([(r["id"], np.array(r["v"])) for r in few])

    def brute(batches):
        # k rows for each query and task
        if not probe.value:
            return
        qi, q = np.array([x[0] for x in probe.value]), np.stack([x[1] for x in probe.value])
        best = pd.DataFrame({"at": [], "score": [], "vec_id": [], "leaf": []})
        for pdf in batches:
            for i in range(0, len(pdf), 16):
                part = pdf.iloc[i : i + 16]
                ids, vs = zip(*[arrays(*x) for x in zip(part["ids"], part["vs"], strict=True)], strict=True)
                leaf, ci = np.repeat(part["leaf"].to_numpy(), [len(x) for x in ids]), np.concatenate(ids)
                a, b, d = _nearest(qi, q, ci, np.concatenate(vs), k)
                found = pd.DataFrame({"at": a, "score": d, "vec_id": ci[b], "leaf": leaf[b]})
                both = pd.concat([best, found]) if len(best) else found
                best = both.sort_values(["at", "score", "vec_id"]).groupby("at").head(k)
        if len(best):
            yield best.assign(query_id=qi[best["at"]])[["query_id", "score", "vec_id", "leaf"]]

    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    true = blocks.mapInPandas(brute, "query_id bigint, score double, vec_id bigint, leaf int").withColumn("place", F.row_number().over(first)).where(
        F.col("place") <= k).groupBy("query_id").agg(F.collect_list("leaf").alias("leaf")).collect() if few else []
    order = {qid: {leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves()))} for qid, q in probe.value}
    needed = np.sort([order[r["query_id"]][leaf] + 1 for r in true for leaf in r["leaf"]])
    wide, total = 1, tree.leaves()
    while len(needed) and np.searchsorted(needed, wide, "right") < recall * len(needed) and wide < total:
        wide = min(total, max(wide + 1, int(wide * 1.25)))
    least = min(total, max(wide, 2))

    def enough(q, rows_wanted):
        leaves, seen = least, held.value.visits(q, least)
        while leaves < total and filled[seen].sum() < rows_wanted:
            leaves = min(total, 2 * leaves)
            seen = held.value.visits(q, leaves)
        return seen

    def walks(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 16):
                part = pdf.iloc[i : i + 16]
                vs = [np.array(v, float) for v in part["v"]]
                seen = [enough(q, k + own) for q, own in zip(vs, part["own"], strict=True)]
                times = [len(x) for x in seen]
                yield pd.DataFrame({"leaf": np.concatenate(seen).astype("int32"), "query_id": np.repeat(part["id"].to_numpy(), times),
                                    "q": [b for q, n in zip(vs, times, strict=True) for b in [q.tobytes()] * n]})

    def first_k(found):
        query, other, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((other, d, query))
        query, other, d = query[order], other[order], d[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[keep], other[keep], d[keep]

    def opened(batches):
        # the k best of each query over all leaves that a task opens, merged as they grow
        found, size = [], 0
        for pdf in batches:
            for row in pdf.itertuples():
                ci, cv = arrays(row.ids, row.vs)
                qi, q = arrays(row.q_ids, row.qs)
                a, b, d = _nearest(qi, q, ci, cv, k)
                found.append((qi[a], ci[b], d))
                size += len(a)
                if size > MERGED:
                    found = [first_k(found)]
                    size = len(found[0][0])
                    if size > MERGED // 2:
                        yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found[0], strict=True)))
                        found, size = [], 0
        if found:
            yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), first_k(found), strict=True)))

    def grouped(pdf):
        return pd.DataFrame({"leaf": [pdf["leaf"].iloc[0]], "q_ids": [pdf["query_id"].to_numpy("int64").tobytes()], "qs": [b"".join(pdf["q"])]})

    asks = asked.mapInPandas(walks, "leaf int, query_id bigint, q binary")
    # the queries of one leaf in groups, so that a leaf everybody visits is many rows
    groups = asks.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(max(1, asked.count() // 256)))).groupBy("leaf", "part").applyInPandas(
        grouped, "leaf int, q_ids binary, qs binary")
    # a group holds a vector for each of its queries: never the side that is broadcast
    found = groups.hint("merge").join(blocks, "leaf").mapInPandas(opened, "query_id bigint, vec_id bigint, score double")
    return ranked_rows(found, k, "score, vec_id")
