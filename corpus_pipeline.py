"""A corpus pipeline: quality rules, near duplicates, repeated passages, benchmark decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import stage
from statloom.llm.decontamination import contaminated, decontaminate
from statloom.llm.jaccard_join import jaccard_components
from statloom.llm.packing import pack_documents
from statloom.llm.quality_rules import quality_rules, without_lines
from statloom.llm.substring_dedup import substring_dedup

#: The columns of ``documents``, which all stages but the last return; any others are dropped.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number each, by which they are judged: ids may be null or repeated. They are written, so that every reader sees the same numbers."""
    return stage(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Drop the rows with the given numbers. These are written first: Spark then sees their size and shuffles the texts only if it is large."""
    return rows.join(stage(gone.select("row_id").distinct(), "gone"), "row_id", "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go, each by its own text: null ids too, and no row for the sake of its namesake.

    The boilerplate lines of the others are removed from their texts, and ``n_chars`` counts what is left. A text with a
    benchmark passage stays as it is, since a cut could part the passage and hide it from the stage that looks for it.
    Null and empty texts are rejected (they have too few words); an empty table gives an empty one.
    """
    rows = _numbered(docs)
    verdict = quality_rules(rows, "row_id")
    touched = stage(verdict.where("not kept or size(cut_lines) > 0").select("row_id", "kept", "cut_lines"), "touched")
    found = decontaminate(rows.join(touched.where("kept").select("row_id"), "row_id", "left_semi"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row_id")
    whole = stage(found.where("n_hit > 0").select("row_id", F.lit(True).alias("whole")), "whole")
    left = rows.join(touched, "row_id", "left").where("coalesce(kept, true)").join(whole, "row_id", "left")
    cut = F.when(F.col("whole").isNull(), F.col("cut_lines"))
    n_chars = F.when(F.size("cut") > 0, F.length("clean")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])
    return left.withColumn("cut", cut).withColumn("clean", without_lines("text", "cut")).select("doc_id", F.col("clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links connect the one with the smallest id stays.

    A null id comes after all others, and among equal ids the text's hash decides, so one row of a group stays whether
    ids are null or repeated. Texts stay as they are.
    """
    rows = _numbered(docs)
    member = stage(rows.select("row_id", "doc_id", F.xxhash64("text").alias("print")).join(jaccard_components(rows, "row_id").select("row_id", "component_id"), "row_id"), "members")
    best = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "print", "row_id")).alias("m"))
    return _without(rows, member.join(best.select("m.row_id"), "row_id", "left_anti")).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out of the text; the row stays, even with an empty text.

    A benchmark passage that is cut here stands whole in the earliest document that has it, for the next stage to judge.
    Rows with a null id have no earlier document and stay whole; null texts come out empty.
    """
    out = substring_dedup(docs, keep=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with benchmark passages go, each by its own text: null ids too, and no row for the sake of its namesake. Null and empty texts stay."""
    rows = _numbered(docs)
    found = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row_id")
    return _without(rows, found.where(contaminated(F.col("n_hit"), F.col("n_words")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 4096; null and empty texts are their end token alone, repeated and null ids keep a row each."""
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality_rules", keep_quality),
    ("jaccard_join", one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Similarity groups and packing are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
