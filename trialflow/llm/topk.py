"""Exact top-k inner products by distributed histogram selection.

Queries and candidates are packed into blocks; every query block meets every candidate
block. Each pass scores everything and counts scores in a histogram per query inside the
interval that holds the k-th value; a few passes narrow it to one integer. A last pass
keeps the scores that reach it, and ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.session import materialized

QUERY_BLOCK, ROW_BLOCK, BINS = 512, 2048, 256
#: groups of candidate blocks; a query block is copied to each, so it meets them in as many tasks
GROUPS = 32
#: float64 products are exact below the first, 64-bit ones below the second
FLOATS, LONGS = 1 << 53, (1 << 63) - 1


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """``id`` and ``v`` (array<double>) of the rows whose vector is whole and finite."""
    rows = table.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(~bad)


def whole_number(x: Column) -> Column:
    """floor of a double as a double; from 2**52 on a double has no fraction."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def packed(rows: DataFrame, block: int, count: int, name: str) -> DataFrame:
    """Blocks of about ``block`` rows: ``name``, ids and the vectors as one binary each."""
    blocks = max(1, -(-count // block))

    def pack(pdf):
        pdf = pdf.sort_values("id", kind="stable")
        return pd.DataFrame({name: [pdf[name].iloc[0]], "ids": [pdf["id"].to_numpy("int64").tobytes()], "vs": [np.stack(pdf["v"].to_numpy()).astype("float64").tobytes()]})

    return rows.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).groupBy(name).applyInPandas(pack, f"{name} int, ids binary, vs binary")


def grid(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Query blocks, and candidate blocks repeated for each query block (column qb)."""
    qs = materialized(packed(queries, QUERY_BLOCK, n_queries, "qb"))
    cs = materialized(packed(rows, ROW_BLOCK, n_rows, "cb"))
    return qs, cs.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n_queries // QUERY_BLOCK)) - 1))))


def arrays(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vs, np.float64).reshape(len(i), -1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each query.

    Components become floor(scale * x). ``queries`` are rows of the same form; a row never
    answers the query with its own id. Vectors null, empty or holding null or non-finite
    components take no part, nor do null ids; vectors of another length than a query's are
    no candidates for it. Repeated rows are candidates each, a repeated query counts once
    (with its smallest vector). Fewer candidates than k give all; empty tables an empty result.
    Products are exact: in float64 while they stay below 2**53, in 64-bit integers while they
    fit those, else in unbounded integers; a score beyond a long counts as the largest or
    smallest one.
    """
    whole = lambda df: usable(df, key, vector).select("id", F.transform("v", lambda x: whole_number(x * scale)).alias("v"))
    rows = materialized(whole(table))
    asked = materialized(whole(queries).groupBy("id").agg(F.min("v").alias("v")))
    n, m = rows.count(), asked.count()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n or not m:
        return table.sparkSession.createDataFrame([], schema)
    sizes = [r[0] for r in rows.select(F.size("v")).union(asked.select(F.size("v"))).distinct().collect()]
    parts = [_one_length(rows.where(F.size("v") == d), asked.where(F.size("v") == d), n, m, k) for d in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _one_length(rows: DataFrame, asked: DataFrame, n: int, m: int, k: int) -> DataFrame:
    # |inner product| <= largest query norm * largest row norm, with room for their rounding
    norm = lambda df: df.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    most = (norm(asked) or 0) ** 0.5 * (norm(rows) or 0) ** 0.5 * (1 + 1e-9)
    exact = int(most) + 2 if np.isfinite(most) else 2 * LONGS
    bound = min(exact, LONGS)
    qs, cs = grid(asked, rows, m, n)
    groups = F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))).alias("g")
    cs, qs = cs.withColumn("g", F.col("cb") % GROUPS), qs.select("*", groups)
    span = 2 * bound + 1
    width = max(1, -(-span // BINS))
    spans = materialized(asked.select(F.col("id").alias("query_id"), F.lit(-bound).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("above")).dropDuplicates(["query_id"]))

    def with_spans(spans):
        per = spans.join(asked.select(F.col("id").alias("query_id"), F.pmod(F.xxhash64("id", "v"), F.lit(max(1, -(-m // QUERY_BLOCK)))).cast("int").alias("qb")), "query_id")

        def pack(pdf):
            pdf = pdf.sort_values("query_id")
            return pd.DataFrame({"qb": [pdf["qb"].iloc[0]], "keys": [pdf["query_id"].to_numpy("int64").tobytes()], "los": [pdf["lo"].to_numpy("int64").tobytes()]})

        los = per.groupBy("qb").applyInPandas(pack, "qb int, keys binary, los binary").select("*", groups)
        asks = qs.select("qb", "g", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")).join(los, ["qb", "g"])
        return cs.join(asks, ["qb", "g"])

    def scored(row):
        qi, qv = arrays(row.q_ids, row.q_vs)
        ci, cv = arrays(row.ids, row.vs)
        lo = np.frombuffer(row.los, np.int64)[np.searchsorted(np.frombuffer(row.keys, np.int64), qi)]
        if exact < FLOATS:
            return qi, ci, lo, (qv @ cv.T).astype(np.int64)
        if exact <= LONGS:
            # sums may wrap on the way, the result fits
            return qi, ci, lo, qv.astype(np.int64) @ cv.T.astype(np.int64)
        whole = np.array([[int(x) for x in v] for v in qv], object) @ np.array([[int(x) for x in v] for v in cv], object).T
        return qi, ci, lo, np.clip(whole, -LONGS, LONGS).astype(np.int64)

    def histogram(width, span):
        def run(batches):
            for pdf in batches:
                for row in pdf.itertuples():
                    qi, ci, lo, s = scored(row)
                    # the distance of two longs fits 64 bits without a sign
                    past = s.astype(np.uint64) - lo.astype(np.uint64)[:, None]
                    bin_ = (past // np.uint64(width)).astype(np.int64)
                    ok = (s >= lo[:, None]) & (past <= np.uint64(span - 1)) & (ci[None, :] != qi[:, None])
                    q, c = np.nonzero(ok)
                    n = np.bincount(q * BINS + bin_[q, c], minlength=len(qi) * BINS)
                    at = np.flatnonzero(n)
                    yield pd.DataFrame({"query_id": qi[at // BINS], "bin": (at % BINS).astype("int32"), "n": n[at]})

        return run

    while True:
        counts = with_spans(spans).mapInPandas(histogram(width, span), "query_id bigint, bin int, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        ranked = counts.withColumn("upto", F.sum("n").over(down)).join(spans, "query_id")
        # the highest bin whose scores, with those above, reach k; else the lowest of all
        found = ranked.where(F.col("upto") + F.col("above") >= k).groupBy("query_id").agg(
            F.max_by(F.struct((F.col("lo") + F.col("bin").cast("decimal(20,0)") * F.lit(width).cast("decimal(20,0)")).cast("bigint").alias("lo"), (F.col("above") + F.col("upto") - F.col("n")).alias("above")), "bin").alias("x"))
        spans = materialized(spans.join(found, "query_id", "left").select(
            "query_id", F.coalesce("x.lo", "lo").alias("lo"), F.coalesce("x.above", "above").alias("above")))
        if width == 1:
            break
        span, width = width, max(1, -(-width // BINS))

    def chosen(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                qi, ci, lo, s = scored(row)
                out = []
                for i in range(len(qi)):
                    at = np.flatnonzero((s[i] >= lo[i]) & (ci != qi[i]))
                    at = at[best(s[i][at], ci[at], k)]
                    out.append(pd.DataFrame({"query_id": np.full(len(at), qi[i]), "vec_id": ci[at], "score": s[i][at]}))
                yield pd.concat(out)

    return ranked_rows(with_spans(spans).mapInPandas(chosen, "query_id bigint, vec_id bigint, score bigint"), k, "score DESC, vec_id")


def ranked_rows(found: DataFrame, k: int, order: str) -> DataFrame:
    """The first k rows of each query, numbered."""
    by = [F.expr(o.removesuffix(" DESC")).desc() if o.endswith(" DESC") else F.expr(o) for o in order.split(", ")]
    window = Window.partitionBy("query_id").orderBy(*by)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
