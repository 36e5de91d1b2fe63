"""Values as of a date, calendars of date ranges, and joins of dates with ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_date: str, right_date: str, columns: list[str], ties: list[str] | None = None, inclusive: bool = False, slices: str | None = None) -> DataFrame:
    """Each left row with ``columns`` of the last right row of its key before its date (``inclusive``: up to it); nulls where there is none.

    The tables are united, dealt by key once and put in order of date, and the last right row's values are carried
    forward, so that no row meets more than one other. Of right rows of one day the greatest by ``ties`` counts. A key
    or date that is null meets nothing; every left row stays once, repeated rows too.

    ``slices`` (a unit of ``date_trunc``, such as "month") deals by key and slice of time instead, where a few keys hold
    much of the rows: what stands at the start of a slice comes from one aggregated row a key and slice.
    """
    known = right.where(" and ".join(f"`{c}` is not null" for c in [*by, right_date]))
    a = left.select(*by, F.col(left_date).alias("_day"), F.lit(2 if inclusive else 0).alias("_kind"), F.struct(*left.columns).alias("_left"))
    b = known.select(*by, F.col(right_date).alias("_day"), F.lit(1).alias("_kind"), F.struct(*(ties or [])).alias("_tie") if ties else F.lit(0).alias("_tie"), F.struct(*columns).alias("_right"))
    both, keys = a.unionByName(b, allowMissingColumns=True), list(by)
    if slices:
        both, keys = both.withColumn("_slice", F.date_trunc(slices, "_day")), [*by, "_slice"]
        place = F.when(F.col("_right").isNotNull(), F.struct("_day", "_tie"))
        last = both.groupBy(*keys).agg(F.max_by("_right", place).alias("_last"))
        earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        seeds = last.select(*keys, F.lit(-1).alias("_kind"), F.last("_last", ignorenulls=True).over(earlier).alias("_right"))
        both = both.unionByName(seeds.where("_right is not null"), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_day"), "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    return seen.select("_left.*", *[F.col(f"_seen.{c}").alias(c) for c in columns])


def buckets(first: Column, last: Column, days: int = 5) -> Column:
    """The calendar from ``first`` to ``last`` as an array of (bucket, date_from, date_to).

    Bucket 0 starts on ``first``; each has ``days`` days, both ends included, and the last starts on ``last`` at the latest.
    """
    starts = F.sequence(first, last, F.make_dt_interval(F.lit(days)).cast("interval day"))
    return F.transform(starts, lambda d, i: F.struct(i.alias("bucket"), d.alias("date_from"), F.date_add(d, days - 1).alias("date_to")))


def _slot(date: Column, width: int) -> Column:
    return F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / width)


def in_range(rows: DataFrame, date: str, spans: DataFrame, low: str, high: str, width: int, on: list[str] | None = None) -> DataFrame:
    """Rows with each span that holds their date, both ends included (and that equals them in ``on``).

    The range join is an equi-join on slots of ``width`` days, which should be about a span's length: a span lies in as
    many rows as slots it touches, a date in one, so each pair is met once. Spans that are empty or have a null end, and
    rows without a date, meet nothing.
    """
    there = spans.where(F.col(low) <= F.col(high)).withColumn("_slot", F.explode(F.sequence(_slot(F.col(low), width), _slot(F.col(high), width))))
    met = rows.withColumn("_slot", _slot(F.col(date), width)).join(there, [*(on or []), "_slot"])
    return met.where(F.col(date).between(F.col(low), F.col(high))).drop("_slot")
