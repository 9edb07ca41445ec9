"""Exact positions in a total order, by sampled splitters.

Keys are sampled in proportion to weight; quantiles of the sample cut the
key's domain into ranges; ranges that turn out overfull are sampled again
and subdivided; a window in each range and the sums of the ranges before
give every row its rank and the weight before it. Only splitters and sums by
range reach the driver, at most MAX_RANGES of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import run_dir, written

#: Rows of a range, ranges at most, sampled keys for a range, rounds of subdivision.
ROWS, MAX_RANGES, OVERSAMPLE, ROUNDS = 200_000, 16_384, 32, 3
#: A range is overfull beyond this many times its share.
OVERFULL = 1.5


def sampled_keys(df: DataFrame, n: float, total: float, seed: int) -> list[str]:
    """About n keys, each row drawn with a probability in proportion to its weight; the draw hangs on key and seed alone."""
    u = F.shiftrightunsigned(F.xxhash64("_key", F.lit(seed)), 11) / float(1 << 53)
    return sorted(r[0] for r in df.where(u < F.col("_w") * (n / max(total, 1e-9))).select("_key").collect())


def quantiles(keys: list[str], parts: int) -> list[str]:
    return [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []


def with_range(df: DataFrame, splitters: list[str]) -> DataFrame:
    """Adds `_range`: how many splitters are at or below the key."""

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cuts = np.array([s.encode() for s in splitters], dtype=object)
        for b in batches:
            keys = np.array([k.encode() for k in b.column("_key").to_pylist()], dtype=object)
            at = np.searchsorted(cuts, keys, side="right") if len(cuts) and len(keys) else np.zeros(len(keys), int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "_range"])

    return df.mapInArrow(assign, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, _range int")


def positions(df: DataFrame, ranges: int = 0, seed: int = 42) -> DataFrame:
    """`df` (a written table with a string `_key` and a non-negative long `_w`) with `_rank` and `_before`, the rows and the weight ahead of each row."""
    spark = df.sparkSession
    n, total = df.agg(F.count("*"), F.sum("_w")).first()
    n, total = n or 0, total or 0
    parts = int(min(MAX_RANGES // 4, max(ranges, -(-n // ROWS), 1)))
    cuts = sorted(set(quantiles(sampled_keys(df, parts * OVERSAMPLE, total, seed), parts))) if parts > 1 and total else []
    share = max(total / parts, 1)
    for again in range(ROUNDS + 1):
        ranged = with_range(df, cuts)
        sums = {r[0]: (r[1], r[2]) for r in ranged.groupBy("_range").agg(F.count("*"), F.sum("_w")).collect()}
        over = {k: w for k, (c, w) in sums.items() if c > 1 and (w > OVERFULL * share or c > 4 * ROWS)}
        if not over or again == ROUNDS or parts == 1:
            break
        kept = ranged.where(F.col("_range").isin([int(k) for k in over]))
        more: dict[int, list[str]] = {}
        for key in sampled_keys(kept, OVERSAMPLE * 2 * sum(over.values()) / share, sum(over.values()), seed + again + 1):
            more.setdefault(int(np.searchsorted(np.array(cuts, dtype=object), key, side="right")) if cuts else 0, []).append(key)
        new = {c for k, keys in more.items() for c in quantiles(keys, int(np.ceil(2 * over.get(k, 0) / share)) or 1)} - set(cuts)
        if not new or len(cuts) + len(new) >= MAX_RANGES:
            break
        cuts = sorted({*cuts, *new})
    rank = weight = 0
    starts = []
    for k in sorted(sums):
        starts.append((int(k), rank, weight))
        rank, weight = rank + sums[k][0], weight + sums[k][1]
    # at most MAX_RANGES rows of three numbers
    base = F.broadcast(spark.createDataFrame(starts, "_range int, _r0 long, _w0 long"))
    here = Window.partitionBy("_range").orderBy("_key")
    return (
        ranged.withColumn("_rank", F.row_number().over(here) - 1)
        .withColumn("_before", F.sum("_w").over(here.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w"))
        .join(base, "_range")
        .withColumn("_rank", F.col("_rank").cast("long") + F.col("_r0"))
        .withColumn("_before", F.col("_before") + F.col("_w0"))
        .drop("_r0", "_w0")
    )


def positioned(df: DataFrame, name: str, ranges: int = 0, seed: int = 42) -> DataFrame:
    """`positions`, written to the shared folder, so that ties are settled once."""
    return written(positions(df, ranges, seed), run_dir(df.sparkSession, name))
