"""Mixing sources to target weights by Pfair scheduling of source blocks.

Weights are rounded to whole shares of a period of slots. Within a period each block of a
source has a release time and a deadline from its weight, and earliest deadline first
gives every slot one block, so no source is ever a whole block away from its target. The
schedule repeats, so any block's slot follows from its number alone.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialflow.session import materialized

PERIOD = 4096
BLOCK_ROWS = 64
#: rows numbered together in one window
BUCKET_ROWS = 20_000


def shares(weights: dict, period: int = PERIOD) -> dict:
    """Whole slots per source that sum to the period; every positive weight gets one at least."""
    weights = {k: float(v) for k, v in weights.items() if v is not None and v > 0 and math.isfinite(v)}
    if not weights:
        return {}
    period = max(period, len(weights))
    free, total = period - len(weights), sum(weights.values())
    exact = {k: v / total * free for k, v in weights.items()}
    out = {k: 1 + int(e) for k, e in exact.items()}
    rest = period - sum(out.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))[:rest]:
        out[k] += 1
    return out


def schedule(slots: dict) -> list[tuple]:
    """(source, block, slot) of one period: earliest deadline first among released blocks."""
    period = sum(slots.values())
    waiting = [(0, -(-period // n), str(k), k, 0) for k, n in slots.items()]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, deadline, name, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, name, k, j))
        deadline, name, k, j = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        out.append((k, j, slot))
        if j + 1 < slots[k]:
            heapq.heappush(waiting, ((j + 1) * period // slots[k], -(-(j + 2) * period // slots[k]), name, k, j + 1))
    return out


def smoothed(docs: DataFrame, power: float = 0.5) -> dict:
    """Target weights: each source's count to a power below one, which lifts small sources."""
    return {r[0]: r[1] ** power for r in docs.groupBy(F.col("source").cast("string")).count().collect()}


def mixed(docs: DataFrame, weights: dict | None = None, seed: int = 6, block_rows: int = BLOCK_ROWS, period: int = PERIOD,
          key: Column | None = None) -> DataFrame:
    """``docs`` with mix_block, mix_slot and mix_position (gapless from 0), no row lost.

    ``weights`` maps sources to targets (default: ``smoothed``); the list of sources is
    small by definition and the schedule has ``period`` entries, which bounds the
    broadcast. A null source is a source of its own. Sources without a positive weight, and
    what is left of the others once weights can no longer be met, keep to their deadlines
    and thus come last. Within a source rows stand in seeded hash order of ``key``
    (default: doc_id and text); rows equal in all of it are in any order among themselves.
    An empty table gives an empty result. Columns named ``mix_*`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    source = F.col("source").cast("string")
    counts = {r[0]: r[1] for r in docs.groupBy(source.alias("s")).count().collect()}
    weights = smoothed(docs) if weights is None else weights
    slots = shares({k: weights.get(k) for k in counts}, period)
    table = [(k, slots[k], j, slot) for k, j, slot in schedule(slots)]
    tail = sorted((k for k in counts if k not in slots), key=str)
    period = max(1, sum(slots.values()))
    plan = spark.createDataFrame(table, "p_source string, p_share int, p_turn int, p_slot int")
    share = spark.createDataFrame([(k, slots.get(k, 0), tail.index(k) if k in tail else -1) for k in counts], "s_source string, s_share int, s_tail int")

    # number the rows of each source: inside hash buckets, then offsets of whole buckets
    buckets = max(1, math.ceil(sum(counts.values()) / BUCKET_ROWS) * 4)
    order = F.xxhash64(F.lit(seed), key if key is not None else F.struct("doc_id", "text"))
    rows = docs.withColumn("mix_h", order).withColumn("mix_b", F.shiftrightunsigned(F.col("mix_h"), 33) * buckets / F.lit(2.0**31))
    rows = rows.withColumn("mix_b", F.floor("mix_b").cast("int"))
    sizes = materialized(rows.groupBy(source.alias("o_source"), F.col("mix_b").alias("o_b")).count())
    sizes = sizes.withColumn("o_offset", F.sum("count").over(Window.partitionBy("o_source").orderBy("o_b").rowsBetween(Window.unboundedPreceding, -1)))
    inner = Window.partitionBy("mix_s", "mix_b").orderBy("mix_h", F.col("doc_id"))
    rows = rows.withColumn("mix_s", source).withColumn("mix_n", F.row_number().over(inner) - 1)
    rows = rows.join(sizes, F.col("mix_s").eqNullSafe(F.col("o_source")) & (F.col("mix_b") == F.col("o_b")))
    rows = rows.withColumn("mix_n", F.col("mix_n") + F.coalesce("o_offset", F.lit(0)))
    rows = rows.withColumn("mix_block", F.floor(F.col("mix_n") / block_rows).cast("bigint"))

    # the slot of every block of every source, and the rows that stand before it
    held = spark.createDataFrame([(k, v) for k, v in counts.items()], "b_source string, b_rows bigint")
    blocks = held.withColumn("b_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("b_rows") - 1) / block_rows).cast("bigint"))))
    blocks = blocks.join(F.broadcast(share), F.col("b_source").eqNullSafe(F.col("s_source")))
    blocks = blocks.withColumn("turn", F.when(F.col("s_share") > 0, F.col("b_block") % F.col("s_share")))
    blocks = blocks.join(F.broadcast(plan), F.col("b_source").eqNullSafe(F.col("p_source")) & (F.col("turn") == F.col("p_turn")), "left")
    end = max([math.ceil(math.ceil(counts[k] / block_rows) / n) * period for k, n in slots.items()], default=0)
    longest = max([math.ceil(counts[k] / block_rows) for k in tail], default=0)
    slot = F.when(F.col("p_slot").isNotNull(), F.floor(F.col("b_block") / F.col("s_share")) * period + F.col("p_slot")).otherwise(
        F.lit(end) + F.col("s_tail") * longest + F.col("b_block"))
    blocks = blocks.select("b_source", "b_block", slot.cast("bigint").alias("mix_slot"),
                           F.least(F.lit(block_rows), F.col("b_rows") - F.col("b_block") * block_rows).alias("size"))
    blocks = materialized(blocks.withColumn("super", F.floor(F.col("mix_slot") / period)))
    before = Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = blocks.groupBy("super").agg(F.sum("size").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("super").orderBy("mix_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.join(supers, "super").withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    starts = starts.select("b_source", "b_block", "mix_slot", "start")
    out = rows.join(starts, F.col("mix_s").eqNullSafe(F.col("b_source")) & (F.col("mix_block") == F.col("b_block")))
    position = (F.col("start") + F.col("mix_n") - F.col("mix_block") * block_rows).cast("bigint")
    return out.select(*docs.columns, "mix_block", "mix_slot", position.alias("mix_position"))


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs``, laid out in the order of the mix (range-partitioned files)."""
    out = mixed(docs, **options)
    return out.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*docs.columns)
