"""Table changes as pure functions of the old table and the new rows, and the writes that apply them.

Parquet tables cannot be changed in place: each function returns the whole new table, to be written elsewhere and
swapped in, or (date-scoped, on partitioned tables) only the partitions that change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose reference is set but has no parent."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_column).alias(column)).distinct(), column, "left_anti")


def upsert(target: DataFrame, stage: DataFrame, key: list[str], update: list[str] | None = None, check: bool = True) -> DataFrame:
    """Rows of the stage replace those of the target with the same key, or are added; by name, not position.

    ``update``: only these columns change on a conflict, the others keep their old value. A key that the stage
    holds twice is an error (as it is in databases that merge on conflict).
    """
    if check and not duplicates(stage, key).isEmpty():
        raise ValueError(f"the stage holds a key of {key} more than once")
    if update is None:
        return target.join(stage.select(*key), key, "left_anti").unionByName(stage.select(*target.columns))
    t, s = target.withColumn("_t", F.lit(True)), stage.select(*target.columns).withColumn("_s", F.lit(True))
    both = t.alias("t").join(s.alias("s"), key, "full_outer")
    pick = {c: F.when(F.col("_s").isNotNull() & (F.col("_t").isNull() | F.lit(c in update)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) for c in target.columns if c not in key}
    return both.select(*[F.col(c) if c in key else pick[c].alias(c) for c in target.columns])


def replace_since(old: DataFrame, new: DataFrame, date: str, cutoff: Column) -> DataFrame:
    """Old rows from the cutoff on go, and all new rows are added; old rows before it or without a date stay.

    As a delete by date and an append: new rows are expected to lie from the cutoff on, but none is dropped.
    """
    return old.where(~F.coalesce(F.col(date) >= cutoff, F.lit(False))).unionByName(new.select(*old.columns))


def replace_since_by_key(old: DataFrame, new: DataFrame, key: list[str], date: str, cutoff: Column) -> DataFrame:
    """As :func:`replace_since`, but only for entities that the new rows hold; one pass for all of them."""
    fresh = new.where(F.col(date) >= cutoff)
    recent = old.where(F.col(date) >= cutoff).join(fresh.select(*key).distinct(), key, "left_anti")
    return old.where(~F.coalesce(F.col(date) >= cutoff, F.lit(False))).unionByName(recent).unionByName(fresh.select(*old.columns))


def backfill(df: DataFrame, lookup: DataFrame, on: list[str], columns: list[str], overwrite: bool = False) -> DataFrame:
    """Fill columns from a lookup with unique keys; values that are set stay, unless ``overwrite``."""
    new = lookup.select(*on, *[F.col(c).alias(f"_{c}") for c in columns])
    out = df.join(new, on, "left")
    pick = (lambda c: F.coalesce(f"_{c}", c)) if overwrite else (lambda c: F.coalesce(c, f"_{c}"))
    return out.select(*[pick(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def fix_list(df: DataFrame, fixes: DataFrame, roster: DataFrame, on: str, column: str) -> DataFrame:
    """For the listed keys take the column from the roster; a key the roster lacks keeps its value."""
    return backfill(df, roster.join(fixes.select(on).distinct(), on, "left_semi"), [on], [column], overwrite=True)


def overwrite(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replace a table, or of a partitioned one those partitions that the rows hold."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition else "static")
    (w.partitionBy(partition) if partition else w).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the table's file system, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_partition(spark: SparkSession, path: str, partition: str, value: object) -> None:
    """Delete the files of one value of a partitioned table."""
    rows = spark.read.parquet(path).where(F.col(partition).eqNullSafe(F.lit(value))).select("_metadata.file_path").distinct()
    for folder in {r[0].rsplit("/", 1)[0] for r in rows.collect()}:
        drop_folder(spark, folder)


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of delimited files with a header."""
    df.write.mode("overwrite").csv(path, header=True)
