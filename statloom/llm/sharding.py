"""A reproducible global shuffle into shards by a Feistel permutation of row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

ROUNDS = 6
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser with a key (two multiply-xorshift steps)."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed * 1000003 + i], np.uint64), 0x5BF03635)[0]) for i in range(ROUNDS)]


def _walk(x: np.ndarray, n: int, keys: list[int], back: bool) -> np.ndarray:
    """The permutation of [0, n): rounds on the smallest even power of two >= n, repeated while a value lies outside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    x = x.astype(np.uint64)
    out = np.ones(len(x), bool)
    while out.any():
        y = x[out]
        left, right = y >> shift, y & mask
        for k in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        x[out] = (left << shift) | right
        out = x >= np.uint64(n)
    return x.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The place in the shuffled order of each row number in [0, n)."""
    return _walk(np.asarray(rows), n, _keys(seed), False)


def unpermute(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row number at each place: the inverse of :func:`permute`."""
    return _walk(np.asarray(places), n, _keys(seed), True)


def row_numbers(df: DataFrame, order: list[str]) -> DataFrame:
    """(row, row_number): the rows, each as a struct, numbered from 0 in the order of the given columns, without a single-task sort.

    A range shuffle sorts the rows; each partition numbers its own, and the partitions' counts (one small row for
    each partition) give the offsets. The sorted rows are written once, because the bounds of a range shuffle may
    differ when it is computed again. Equal keys are dealt out by their first place, so a hot key splits.
    """
    # the caller's columns travel inside one, so that their names meet no others
    own = F.struct(*[F.col(c) for c in df.columns]).alias("row") if df.columns else F.struct(F.lit(0).alias("_")).alias("row")
    keyed = df.select(own, *[F.col(c).alias(f"key_{i}") for i, c in enumerate(order)]).withColumn("at", F.monotonically_increasing_id())
    keys = [*(f"key_{i}" for i in range(len(order))), "at"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("row", F.monotonically_increasing_id().alias("_row"))
    held = stage(sorted_, "rows")
    part = F.shiftright("_row", 33)
    counts = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).count().withColumnRenamed("count", "n").collect()}  # one row a partition
    starts, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(at)
        at += counts.get(p, 0)
    offsets = F.array(*[F.lit(x) for x in starts]) if starts else F.array(F.lit(0))
    return held.select("row", "_row").withColumn("row_number", F.element_at(offsets.cast("array<bigint>"), part.cast("int") + 1) + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row")


def shard_rows(df: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Add row_number, shard (int) and slot (long) to every row; columns of these names that it has are replaced.

    Rows are numbered in the order of the columns ``order`` (nulls first; rows equal in them are interchangeable),
    the Feistel network permutes the numbers, and the place p goes to shard ``p % shards``, slot ``p // shards``:
    shard sizes differ by one at most and slots have no gaps. Any row's shard and slot follow from its number, n and
    the seed; :func:`unpermute` finds the row of a shard's slot. Groups of equal rows are not kept together. Carry
    only the columns you need: those given are shuffled once. An empty table gives an empty result.
    """
    keep = [c for c in df.columns if c not in ("row_number", "shard", "slot")]
    numbered = row_numbers(df, order)
    n = numbered.count()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*b.schema.names, "shard", "slot"])

    out = numbered.mapInArrow(place, numbered.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "row_number", "shard", "slot")


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows with shard and slot as one folder a shard, each sorted by slot."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
