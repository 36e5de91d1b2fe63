"""Readers of landed files: Parquet, delimited text, nested JSON, HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import Table


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder; with columns, only those (the scan reads no others)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def season_table(spark: SparkSession, path: str, season: str) -> DataFrame:
    """One season of a table that is partitioned by season: the scan reads that partition alone."""
    return spark.read.parquet(path).where(F.col("season") == season)


def delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """A delimited file with a header; padding around values goes, empty cells are null."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="")


def land(df: DataFrame, t: Table, path: str) -> None:
    """Write rows as a logical table's landing files: all its columns in order, those that the rows lack null."""
    df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema]).write.mode("overwrite").csv(path, header=True)


def landed(spark: SparkSession, t: Table, path: str) -> DataFrame:
    """Landing files by a logical table's schema; a file whose header has other names is an error."""
    return spark.read.csv(path, schema=t.schema, header=True, enforceSchema=False, nullValue="")


def titled_json(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """Documents with an array of maps title -> attributes, attributes differing: one row a (title, attribute).

    A file is one document, or without ``whole`` each of its lines, which several tasks can read.

    Inference would make a column of every title; here maps keep the titles as data. Numbers arrive as text.
    """
    text = spark.read.text(path, wholetext=whole)
    maps = text.select(F.explode(F.from_json("value", "array<map<string,map<string,string>>>")).alias("m"))
    titles = maps.select(F.explode("m").alias("title", "attributes"))
    return titles.select("title", F.explode_outer("attributes").alias("attribute", "value"))


def generations(spark: SparkSession, path: str, t: Table) -> DataFrame:
    """A table whose files were written under several schemas, by the present one.

    A column takes its present name or, in files from before, a former one of ``t.renamed``; columns that files lack
    are null, those that the schema no longer has are left out. Names that differ by case alone are one name to Spark.
    """
    every = spark.read.option("mergeSchema", "true").parquet(path)
    have = {c.lower() for c in every.columns}

    def column(name: str) -> Column:
        there = [F.col(f"`{c}`") for c in (name, *(old for old, new in t.renamed.items() if new == name)) if c.lower() in have]
        return F.coalesce(*there) if there else F.lit(None)

    return every.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in t.schema])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """HTML files of a folder: (path, html), a file a row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame], **args) -> DataFrame:
    """A SQL statement with named parameters over the given frames; values are bound, never spliced into the text."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)
