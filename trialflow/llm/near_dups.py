"""MinHash near-duplicates: universal hash minima, banding, verification, star components.

Documents with equal shingle sets collapse to one class first, so groups of copies cost
one row. Classes meet in bands of equal minima, and buckets that share documents form
clusters. Within a cluster, parts of bounded size are compared with each other, first by
signature, then on the full sets; only links that connect something leave a task. Clusters
too large for that are compared bucket by bucket. Components, of clusters and of links,
come from alternating large-star and small-star over written tables.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialflow.llm.text import chunks, encoded, mixed, shingle_sets
from trialflow.session import materialized

BANDS, ROWS = 28, 5
MINIMA = BANDS * ROWS
#: a pair at the threshold that agrees on fewer minima than 4 standard errors below is let go
SLACK = 4.0
#: most documents, and bytes of their sets, that one task compares with as many others
CHUNK, CHUNK_BYTES = 512, 32 << 20
#: clusters of more parts than this are compared bucket by bucket
MOST_PARTS = 32
_RNG = np.random.default_rng(9)
_A = _RNG.integers(0, 2**31, MINIMA, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, MINIMA, dtype=np.uint32)[:, None]


def minima(values: np.ndarray) -> np.ndarray:
    """The least value of each universal hash ``a * x + b`` over a set of 64-bit hashes."""
    x = (values >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.full(MINIMA, 2**32 - 1, np.uint32)
    for i in range(0, x.shape[1], 512):
        np.minimum(best, (_A * x[:, i : i + 512] + _B).min(axis=1), out=best)
    return best


def bands(signatures: np.ndarray) -> np.ndarray:
    """64-bit bucket keys, one per row and band; the band's number is part of the key."""
    rows = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the whole set) and the minima of each document."""

    def run(batches):
        for pdf in batches:
            raw = encoded(pdf["text"])
            out = []
            for i, j in chunks(raw):
                for s in shingle_sets(raw[i:j]):
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), minima(s).tobytes()) if len(s) else (0, None, None))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": [o[0] for o in out], "set_key": [o[1] for o in out], "sig": [o[2] for o in out]})

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInPandas(
        run, "doc_id bigint, n_shingles bigint, set_key binary, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per id: alternating large-star and small-star until nothing moves.

    ``edges`` has the columns ``u`` and ``v``; the result ``id`` and ``root`` holds the ids
    that are not their own root. No edges give an empty result.
    """
    now = materialized(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialized(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("v", "m").union(least.select("u", "m"))
        now = materialized(small.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _links(left, right, num: int, den: int):
    """Positions of the linked pairs between two lists of (signature, set): signatures first, then the full sets."""
    p = num / den
    least = np.ceil((p - SLACK * math.sqrt(p * (1 - p) / MINIMA)) * MINIMA)
    sig_l, sig_r = (np.frombuffer(b"".join(s for s, _ in x), np.uint32).reshape(-1, MINIMA) for x in (left, right))
    agree = np.zeros((len(left), len(right)), np.uint8)
    for k in range(MINIMA):
        agree += sig_l[:, k][:, None] == sig_r[:, k][None, :]
    near = agree >= least
    rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(rows):
        return rows, rows
    sets = [np.frombuffer(left[i][1], np.uint64) for i in rows] + [np.frombuffer(right[i][1], np.uint64) for i in cols]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(term)[term] > 1
    owner, term = owner[shared], np.unique(term[shared], return_inverse=True)[1]
    order = np.argsort(term, kind="stable")
    owner, term = owner[order], term[order]
    both = np.zeros((len(rows), len(cols)), np.float32)
    last = int(term[-1]) + 1 if len(term) else 0
    for start in range(0, last, 4096):
        i, j = np.searchsorted(term, (start, start + 4096))
        table = np.zeros((len(sets), min(4096, last - start)), np.float32)
        table[owner[i:j], term[i:j] - start] = 1
        both += table[: len(rows)] @ table[len(rows) :].T
    union = sizes[: len(rows), None] + sizes[None, len(rows) :] - both
    i, j = np.nonzero((den * both >= num * union) & near[np.ix_(rows, cols)])
    return rows[i], cols[j]


def _compared(groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) inside groups of (g, id, sig, set, parts), enough to connect what is linked.

    A group of several parts is compared part against part, each pair of parts in a task
    of its own; a task returns no link that its other links imply.
    """

    def run(pdf):
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        ids, part = pdf["id"].to_numpy(), pdf["part"].to_numpy()
        items = list(zip(pdf["sig"], pdf["set"], strict=True))
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        rows, cols = _links([items[i] for i in left], [items[i] for i in right], num, den)
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        out = []
        for x, y in zip(ids[left[rows]], ids[right[cols]], strict=True):
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, y))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    dealt = groups.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    met = met.select("g", "id", "sig", "set", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    return met.groupBy("g", "lo", "hi").applyInPandas(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100) -> DataFrame:
    """Component of each document under ``den * intersection >= num * union`` of 5-word shingles.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and kept. Texts
    that are null or without words have no shingles and are linked with nothing; equal
    texts are one class; rows without doc_id keep component_id null and kept true; rows
    that repeat a doc_id are judged each by its own text. Other columns are ignored.
    """
    base = materialized(signatures(docs))
    rows = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialized(rows.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")))

    def banded(batches):
        for pdf in batches:
            if len(pdf):
                keys = bands(np.frombuffer(b"".join(pdf["sig"]), np.uint32).reshape(-1, MINIMA))
                yield pd.DataFrame({"bucket": keys.ravel(), "id": np.repeat(pdf["id"].to_numpy(), BANDS)})

    keyed = classes.select("id", "sig").mapInPandas(banded, "bucket bigint, id bigint")
    lead = keyed.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last")
    members = materialized(keyed.join(lead.select("bucket", "leader"), "bucket"))

    # which documents can be linked at all: components of the buckets, by one link from each
    # document to its first leader and one from there to each of its other leaders
    leaders = members.groupBy("id").agg(F.collect_set("leader").alias("all")).select("id", "all", F.array_min("all").alias("first"))
    met = leaders.select(F.col("id").alias("u"), F.col("first").alias("v")).union(leaders.select(F.explode("all").alias("u"), "first"))
    clusters = components(met.where("u <> v").distinct())
    busy = materialized(members.select("id").distinct().join(clusters, "id", "left").select("id", F.coalesce("root", "id").alias("cluster")))

    def whole(batches):
        for pdf in batches:
            raw = encoded(pdf["text"])
            sets = [s.tobytes() for i, j in chunks(raw) for s in shingle_sets(raw[i:j])]
            yield pd.DataFrame({"id": pdf["id"], "cluster": pdf["cluster"], "set": sets})

    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    sets = texts.join(busy, "id").mapInPandas(whole, "id bigint, cluster bigint, set binary").dropDuplicates(["id"])
    items = materialized(sets.join(classes.groupBy("id").agg(F.min("sig").alias("sig")), "id"))
    parts = F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.length("set") + 4 * MINIMA) / CHUNK_BYTES)).alias("parts")
    sized = items.join(items.groupBy("cluster").agg(F.count("*").alias("size"), parts).where("size > 1"), "cluster")
    edges = _compared(sized.where(F.col("parts") <= MOST_PARTS).select(F.col("cluster").alias("g"), "id", "sig", "set", "parts"), num, den)
    # what hangs together more loosely is compared bucket by bucket
    loose = sized.where(F.col("parts") > MOST_PARTS).select("id", "sig", "set").join(members.select("id", "bucket"), "id")
    per = loose.groupBy("bucket").agg(F.count("*").alias("size"), parts).where("size > 1")
    edges = edges.union(_compared(loose.join(per, "bucket").select(F.col("bucket").alias("g"), "id", "sig", "set", "parts"), num, den))
    roots = components(edges)
    named = classes.select("set_key", "id").join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    out = base.join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("root"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns of ``docs``.

    Texts without words and rows without id belong to no group and stay.
    """
    found = near_duplicates(docs, num, den).where("NOT kept").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].cast("bigint") == found["doc_id"], "left_anti")
