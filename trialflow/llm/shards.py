"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters the records over memory-sized buckets by seeded hashes: the shard by
rendezvous hashing of the key (one more shard takes rows only into itself), the bucket
inside it by a second hash. Pass two shuffles each bucket with Spark's ``shuffle`` (a
Fisher-Yates permutation) and writes it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.session import shared_folder

BUCKET_BYTES = 4 << 20
#: buckets whose starts (24 bytes each) are broadcast to the written rows; beyond it both
#: meet in a shuffle
BROADCAST_BUCKETS = 1 << 21


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard with the largest seeded hash of the key."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*scores) if shards > 1 else scores[0])["s"]


def sharded(docs: DataFrame, shards: int = 8, seed: int = 10, key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES,
            path: str | None = None) -> DataFrame:
    """Write ``docs`` into shuffled shards below ``path`` and return what was written.

    Adds shard_id, grown_shard_id (with one more shard) and slot (gapless from 0 in each
    shard). All columns are kept; those three names are replaced. Null keys count as one
    key value, null texts have no bytes; rows equal in every column may swap places. The
    buckets hold ``bucket_bytes`` on average (a longer text has its bucket for itself and
    a few others). An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard_id", "grown_shard_id", "slot")
    names = docs.columns
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + F.lit(64)).alias("n")).first()[0] or 0
    per_shard = max(1, math.ceil(total / bucket_bytes / shards))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.select(
        rendezvous(F.col(key), shards, seed).alias("shard_id"), rendezvous(F.col(key), shards + 1, seed).alias("grown_shard_id"),
        F.pmod(F.xxhash64(F.lit(seed + 1), *hashed), F.lit(per_shard)).cast("int").alias("bucket"), F.struct(*names).alias("row"))
    place = F.struct(F.xxhash64(F.lit(seed + 2), *[F.col(f"row.`{c}`") for c in hashed]).alias("at"), "grown_shard_id", "row")
    parts = max(1, min(per_shard * shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (64 << 20)))))
    # hash order first, so that a task that runs again shuffles the same array
    packed = rows.select("shard_id", "bucket", place.alias("p")).repartition(parts, "shard_id", "bucket").groupBy("shard_id", "bucket").agg(
        F.collect_list("p").alias("all")).sortWithinPartitions("shard_id", "bucket")
    in_order = F.array_sort("all", lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))
    dealt = packed.select("shard_id", "bucket", F.posexplode(F.shuffle(in_order, F.lit(seed))).alias("place", "p")).select(
        "shard_id", "bucket", "place", "p.grown_shard_id", "p.row.*")
    path = path or f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    dealt.write.parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    sizes = written.groupBy("shard_id", "bucket").count()
    before = Window.partitionBy("shard_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard_id", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    starts = F.broadcast(starts) if per_shard * shards <= BROADCAST_BUCKETS else starts
    return written.join(starts, ["shard_id", "bucket"]).select(
        *names, "shard_id", "grown_shard_id", (F.col("start") + F.col("place")).cast("bigint").alias("slot"))
