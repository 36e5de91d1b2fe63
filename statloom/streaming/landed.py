"""Refresh jobs over landing folders: each run takes what has landed since the last one, and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from statloom.functions import html
from statloom.streaming.refresh import refresh


def late_refresh(spark: SparkSession, folder: str, schema: StructType | str, path: str, checkpoint: str, key: list[str], ts: str, version: str, partition: str, late: str = "20 days") -> StreamingQuery:
    """Upsert what has landed into a partitioned table; rows up to ``late`` behind the newest time seen are still taken.

    The watermark is state that outlives a run. A row behind it is dropped; one that is delivered again (same key and
    version) within it is dropped as well, by state that goes when the watermark has passed; a later version of a row
    replaces it. The watermark that judges a run is that of the rows before it. State has four partitions a core, at most
    as many as the session shuffles into.
    """
    landed = spark.readStream.schema(schema).parquet(folder)
    once = landed.withWatermark(ts, late).dropDuplicatesWithinWatermark([*key, version])
    return refresh(once, path, key, checkpoint, partition, version, stores=4 * spark.sparkContext.defaultParallelism)


def crawl(spark: SparkSession, folder: str, schema: StructType | str, path: str, checkpoint: str, text: str = "html", keep: tuple[str, ...] = ("page_id",)) -> StreamingQuery:
    """Parse the pages of files that no run has read before, and append title, links, comments and tables.

    Which files were read is kept with the checkpoint, and the sink's own log makes a batch that is run again after a
    failure count once. Null pages give null titles and no links.
    """
    page = F.col(text)
    parsed = (
        spark.readStream.schema(schema)
        .parquet(folder)
        .select(
            *keep,
            html.title(page).alias("title"),
            F.coalesce(F.size(html.links(page)), F.lit(0)).alias("n_links"),
            F.array_join(F.transform(html.comments(page), lambda c: F.trim(c)), "|").alias("comments"),
            F.coalesce(F.size(html.table_ids(page)), F.lit(0)).alias("n_tables"),
        )
    )
    return parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
