"""Landed responses of statistics services: documents of result sets, each a list of headers and of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import Table

_SHAPE = "struct<resource:string,resultSets:array<struct<name:string,headers:array<string>,rowSet:array<array<string>>>>>"


def _documents(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """file, resource and the parsed document (null if it is none); a line holds a document, or with ``whole`` a file."""
    text = spark.read.text(path, wholetext=whole)
    kept = text.select(F.col("_metadata.file_path").alias("file"), "value").where("length(trim(value)) > 0")
    return kept.withColumn("doc", F.from_json("value", _SHAPE)).select("file", F.col("doc.resource").alias("resource"), F.col("doc.resultSets").alias("sets"))


def _sets(spark: SparkSession, path: str, t: Table, name: str, whole: bool) -> DataFrame:
    """One row a document: file, resource, headers and rows of its set ``name``, and what is wrong with it (else null)."""
    docs = _documents(spark, path, whole)
    one = docs.select("file", "resource", "sets", F.filter("sets", lambda s: s["name"] == name).alias("named")).select("file", "resource", "sets", F.get("named", F.lit(0)).alias("s"))
    headers, rows = F.col("s.headers"), F.col("s.rowSet")
    key = F.array(*map(F.lit, t.key))
    problem = (
        F.when(F.col("sets").isNull(), "no document of result sets")
        .when(F.col("s").isNull(), "no such set")
        .when(headers.isNull() | rows.isNull(), "no headers or rows")
        .when(F.size(F.array_distinct(headers)) < F.size(headers), "a header twice")
        .when(F.size(F.array_except(key, headers)) > 0, "a key column missing")
        .when(F.exists(rows, lambda r: r.isNull() | (F.size(r) != F.size(headers))), "rows of other length than headers")
    )
    return one.select("file", "resource", headers.alias("headers"), rows.alias("rows"), problem.alias("problem"))


def result_sets(spark: SparkSession, path: str, t: Table, name: str, whole: bool = False) -> DataFrame:
    """The rows of all sets ``name`` below ``path``, by the logical table's schema; sets with a problem are left out (see :func:`problems`).

    Headers are zipped to rows as they come, in any order; columns that the table lacks are left out, those that a set
    lacks are null. Values that do not fit a column's type are null, and counted by :func:`problems`. Spark reads and
    parses the documents, so they may lie in any store that it reads; a document is one row until it is exploded.
    """
    good = _sets(spark, path, t, name, whole).where("problem is null").select("headers", F.explode("rows").alias("r"))
    named = good.select(F.map_from_arrays("headers", "r").alias("m"))
    return named.select(*[F.try_element_at("m", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in t.schema])


def problems(spark: SparkSession, path: str, t: Table, name: str, whole: bool = False) -> DataFrame:
    """file, resource, problem and n_rows: a row for each set that :func:`result_sets` leaves out, and for each with values of another type."""
    sets = _sets(spark, path, t, name, whole)
    out = sets.where("problem is not null").select("file", "resource", "problem", F.greatest(F.size(F.coalesce("rows", F.array())), F.lit(0)).cast("long").alias("n_rows"))
    typed = sets.where("problem is null").select("file", "resource", F.filter("rows", lambda r: _misfit(t, F.col("headers"), r)).alias("bad")).where(F.size("bad") > 0)
    return out.unionByName(typed.select("file", "resource", F.lit("values of another type").alias("problem"), F.size("bad").cast("long").alias("n_rows")))


def _misfit(t: Table, headers, r):
    m, out = F.map_from_arrays(headers, r), F.lit(False)
    for f in t.schema:
        v = F.try_element_at(m, F.lit(f.name))
        out = out | (v.isNotNull() & v.try_cast(f.dataType).isNull())
        if f.name in t.key:
            out = out | v.isNull()
    return out
