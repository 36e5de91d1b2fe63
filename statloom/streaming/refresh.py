"""Refresh jobs as streams: micro-batches merged into a table, and five-day windows with a watermark (extensions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statloom.operators import mutate


def refresh(stream: DataFrame, path: str, key: list[str], checkpoint: str, partition: str, version: str | None = None, stores: int | None = None) -> StreamingQuery:
    """Upsert each micro-batch into a partitioned table; only the partitions that the batch touches are rewritten.

    Touched are the partitions of the batch's rows and those where their keys stood before, so a key that changes its
    partition leaves no old row behind. Of rows with one key in a batch the one with the greatest ``version`` stays
    (then the greatest of all columns, in order), so a batch that is run again after a failure gives the same table.

    ``stores``: in how many partitions a new checkpoint keeps the stream's state, where the session shuffles into more;
    each of them is loaded and written in every batch, whatever it holds. A checkpoint keeps its number for good.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rank = F.struct(*([F.col(version)] if version else []), *[F.col(c) for c in batch.columns])
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), rank).alias("r")).select("r.*").persist()
        try:
            if last.isEmpty():
                return
            try:
                table = spark.read.parquet(path)
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                table = last.limit(0)
            stood = table.join(last.select(*key), key, "left_semi").select(partition)
            touched = [r[0] for r in last.select(partition).union(stood).distinct().collect()]  # a batch touches few partitions
            here = F.col(partition).isin([x for x in touched if x is not None]) | (F.lit(None in touched) & F.col(partition).isNull())
            new = mutate.upsert(table.where(here).select(*last.columns), last, key, check=False)
            staged = f"{path.rstrip('/')}_staged_{number}"
            new.write.mode("overwrite").parquet(staged)  # the table is read above, so it is not overwritten in the same job
            done = spark.read.schema(last.schema).parquet(staged)
            left = {r[0] for r in done.select(partition).distinct().collect()}
            mutate.overwrite(done, path, partition)
            for x in set(touched) - left:  # a partition that lost all its rows is not overwritten by none
                mutate.drop_partition(spark, path, partition, x)
            mutate.drop_folder(spark, staged)
        finally:
            last.unpersist()

    conf, name = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    usual = conf.get(name)
    try:
        conf.set(name, min(stores or int(usual), int(usual)))  # a stream takes its session's settings along when it starts
        return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, usual)


def windowed(stream: DataFrame, ts: str, by: list[str], aggs: list[Column], days: int = 5, late: str = "20 days", start: str | None = None) -> DataFrame:
    """Tumbling windows of some days with a watermark; works on batch frames alike."""
    window = F.window(ts, f"{days} days", startTime=start) if start else F.window(ts, f"{days} days")
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[F.col(n) for n in _names(stream, aggs)])


def _names(df: DataFrame, aggs: list[Column]) -> list[str]:
    return [c for c in df.groupBy().agg(*aggs).columns]
