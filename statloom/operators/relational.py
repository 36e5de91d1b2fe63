"""Joins and per-entity selections that recur in the rating jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task takes of a table which is dealt by key before it is grouped and joined.
SHARE = 500_000


def shares(df: DataFrame) -> int:
    """In how many partitions to deal a table: by its rows (which Parquet's footers tell), so that a task's memory does not grow with it, and at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SHARE))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def latest_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each entity in the given order, with their number ``rn``. The bound reaches the window:
    each task keeps n rows an entity before the shuffle. Give a unique last order column; ties are arbitrary otherwise."""
    return numbered(df, by, order).where(F.col("rn") <= n)


def natural_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all shared columns where null equals null (and NaN equals NaN)."""
    shared = [c for c in a.columns if c in b.columns]
    on = reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in shared])
    return a.join(b, on).select(*[a[c] for c in a.columns], *[b[c] for c in b.columns if c not in shared])


def first_match(df: DataFrame, lookup: DataFrame, on: str, order: list[Column], values: list[str]) -> DataFrame:
    """Left join to the first lookup row of each key, so that no row multiplies."""
    one = numbered(lookup, [on], order).where("rn = 1").select(on, *values)
    return df.join(one, on, "left")


def self_pairs(games: DataFrame, game: str, side: str, columns: list[str]) -> DataFrame:
    """Ordered pairs of different sides of a game; columns come as a_<name> and b_<name>."""
    a = games.select(F.col(game), *[F.col(c).alias(f"a_{c}") for c in [side, *columns]])
    b = games.select(F.col(game), *[F.col(c).alias(f"b_{c}") for c in [side, *columns]])
    return a.join(b, game).where(F.col(f"a_{side}") != F.col(f"b_{side}"))


def last_row(df: DataFrame, by: list[str], order: Column, columns: list[str]) -> DataFrame:
    """The row with the greatest order of each entity, as an aggregate (no sort). Nulls in the order never win."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*by, "r.*")


def topped_up(current: DataFrame, previous: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each entity from ``current``, filled up from ``previous`` where there are fewer."""
    both = current.withColumn("source_rank", F.lit(0)).unionByName(previous.withColumn("source_rank", F.lit(1)))
    return latest_n(both, by, [F.col("source_rank"), *order], n)


def open_band(c: Column, low: float | None, high: float | None) -> Column:
    """Strictly between the bounds; a bound itself lies outside."""
    parts = [c > low] if low is not None else []
    parts += [c < high] if high is not None else []
    return reduce(lambda x, y: x & y, parts)


def missing_keys(df: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Keys that a lookup lacks."""
    return df.select(on).distinct().join(dim, on, "left_anti")


def listed(df: DataFrame, ids: DataFrame, on: str, position: str) -> DataFrame:
    """The rows whose key is in a list, with its ``position`` there: sorting by it gives the list's order. A key that is listed twice counts once, at its first place."""
    first = ids.groupBy(on).agg(F.min(position).alias(position))
    return df.join(first, on)


def shared_columns(a: DataFrame, b: DataFrame, except_for: tuple[str, ...] = ()) -> list[str]:
    """Columns of b that a has too (merge hygiene), in b's order."""
    return [c for c in b.columns if c in a.columns and c not in except_for]
