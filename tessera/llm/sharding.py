"""Shards of nearly equal bytes by sampled splitters.

Rows are ordered by (hash of the text, id), so equal texts lie side by side;
`_order.positions` finds splitters from a size-weighted sample, subdivides
overfull ranges and gives exact positions. Rows larger than an eighth of a
shard (a few hundred at most, as their sizes add up) are dealt first, largest
to the emptiest; the rest fills the shards in order up to one common level.

Null texts have no bytes, null ids sort first, ids that aren't whole numbers
sort by their hash, repeated rows are placed one by one, other columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm._common import run_dir, text_of, written
from tessera.llm._order import positioned

#: Bytes that a record takes besides its text.
OVERHEAD = 16
#: A row over 1 / (HEAVY * shards) of all bytes is placed by itself.
HEAVY = 8


def levels(heavy: list[int], light: int) -> list[float]:
    """How many light bytes each shard takes so that the fullest is as low as can be."""
    order = sorted(heavy)
    below, level = 0, 0.0
    for i, h in enumerate(order):
        below += h
        level = (light + below) / (i + 1)
        if i + 1 == len(order) or level <= order[i + 1]:
            break
    return [max(0.0, level - h) for h in heavy]


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row."""
    spark = docs.sparkSession
    t = text_of(text)
    number = F.col(id_col).cast("long") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    slim = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(t) + OVERHEAD).cast("long").alias("_w"),
            F.crc32(t).alias("crc"),
            # 16 hex digits of the hash, of the id, and of the row's place, so that a range of equal rows can be cut
            F.concat(F.lpad(F.hex(F.xxhash64(t)), 16, "0"), F.coalesce(F.lpad(F.hex(number), 16, "0"), F.lit("-" * 16)), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")).alias("_key"),
        ),
        run_dir(spark, "shard-sizes"),
    )
    total = slim.agg(F.sum("_w")).first()[0] or 0
    heavy_from = max(total // (HEAVY * shards), 1) if total else 1
    # at most HEAVY * shards rows, as each has more than that share of the bytes
    heavy = sorted(slim.where(F.col("_w") > heavy_from).select("_w", "_key").collect(), key=lambda r: (-r[0], r[1]))
    filled = [(0, s) for s in range(shards)]
    heapq.heapify(filled)
    placed = []
    for w, key in heavy:
        have, s = heapq.heappop(filled)
        placed.append((key, s))
        heapq.heappush(filled, (have + w, s))
    held = [have for have, _ in sorted(filled, key=lambda x: x[1])]
    light = total - sum(held)
    ends, at = [], 0.0
    for room in levels(held, light):
        at += room
        ends.append(at)
    lights = positioned(slim.where(F.col("_w") <= heavy_from), "shard-order", 4 * shards)
    mid = F.col("_before") + F.col("_w") / 2
    cut = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends[:-1]]), lambda e: e <= mid)) if shards > 1 else F.lit(0)
    lights = lights.withColumn("shard", cut.cast("int"))
    # one row for each shard
    first = {r[0]: (r[1], r[2]) for r in lights.groupBy("shard").agg(F.min("_rank"), F.count("*")).collect()}
    firsts = spark.createDataFrame([(s, int(a)) for s, (a, _) in first.items()], "shard int, _first long")
    light_rows = lights.join(F.broadcast(firsts), "shard").select("id", "_w", "crc", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))
    # each heavy row by its key; equal keys (repeated rows) are told apart by their number
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_w"))
    slots = {s: n for s, (_, n) in first.items()}
    deal, seen = [], {}
    for key, s in placed:
        seen[key] = seen.get(key, 0) + 1
        deal.append((key, seen[key], s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
    dealt = spark.createDataFrame(deal, "_key string, _n int, shard int, slot long")
    heavy_rows = slim.where(F.col("_w") > heavy_from).withColumn("_n", number).join(F.broadcast(dealt), ["_key", "_n"]).select("id", "_w", "crc", "shard", "slot")
    return light_rows.unionByName(heavy_rows).select(F.col("id").alias(id_col), F.col("_w").alias("size"), F.col("crc").alias("text_crc32"), "shard", "slot")
