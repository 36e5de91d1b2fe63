"""Tables that change as a whole: written aside, checked, and published by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from statloom.operators import mutate

#: The file that names the folder of a table's present version.
POINTER = "CURRENT"


class Refused(ValueError):
    """What was written breaks the table's key or references; the old version stands."""


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The present version of a table; None where nothing has been published."""
    try:
        folder = spark.read.text(f"{path}/{POINTER}").first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{path}/{folder}")


def _point(spark: SparkSession, path: str, folder: str) -> None:
    """Put the pointer in place by a rename that replaces it, which file systems with renames do as one change."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, aside = (jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (POINTER, f"{POINTER}-{folder}"))
    out = aside.getFileSystem(conf).create(aside)
    out.writeBytes(folder)
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(aside, to, options)


def publish(df: DataFrame, path: str, key: list[str], references: dict[str, tuple[DataFrame, str]] | None = None) -> None:
    """Make ``df`` the table's next version, or leave the old one and raise.

    The rows are written to a folder of their own, keys and references are checked on what was written, and only then
    is the version pointed to. A reader or a failure at any moment meets one whole version. ``df`` may read the present
    version. The last version but one stays for readers that began with it; :func:`clean` drops it.
    """
    spark, folder = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    written = spark.read.schema(df.schema).parquet(f"{path}/{folder}")
    try:
        if not mutate.duplicates(written, key).isEmpty():
            raise Refused(f"a key of {key} is there more than once")
        for c, (parent, parent_column) in (references or {}).items():
            if not mutate.orphans(written, c, parent, parent_column).isEmpty():
                raise Refused(f"{c} holds values that {parent_column} lacks")
    except Refused:
        mutate.drop_folder(spark, f"{path}/{folder}")
        raise
    _point(spark, path, folder)


def clean(spark: SparkSession, path: str) -> None:
    """Delete all versions but the present one, and what broken-off writes have left."""
    now = spark.read.text(f"{path}/{POINTER}").first()[0]
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    for s in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top):
        if (name := s.getPath().getName()) not in (now, POINTER):
            mutate.drop_folder(spark, f"{path}/{name}")


def upsert_bucketed(target: str, stage: DataFrame, key: str, into: str, buckets: int) -> None:
    """Merge ``stage`` into a table that is bucketed and sorted by ``key``, as a new table ``into`` of the same layout.

    The target is neither shuffled nor sorted again: only the stage is dealt to its buckets, and a full outer merge join
    writes each bucket as one file. Rows of the stage win; a key that the stage holds twice is an error.
    """
    if not mutate.duplicates(stage, [key]).isEmpty():
        raise ValueError(f"the stage holds a key of {key} more than once")
    from pyspark.sql import functions as F

    spark = stage.sparkSession
    old = spark.table(target)
    t, s = old.withColumn("_t", F.lit(True)).alias("t"), stage.select(*old.columns).withColumn("_s", F.lit(True)).alias("s").hint("merge")
    both = t.join(s, key, "full_outer")
    pick = lambda c: F.when(F.col("_s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    both.select(*[F.col(c) if c == key else pick(c) for c in old.columns]).write.bucketBy(buckets, key).sortBy(key).saveAsTable(into)
