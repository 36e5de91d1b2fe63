"""As-of joins, calendars and range joins against plain versions."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from statloom.operators import timed
from statloom.plans import history

from .oracle import SF
from .test_plans import _plan

DAY = date(2024, 1, 1)


def tables(seed, n=120, keys=(1, 2, 3, None)):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, *[DAY + timedelta(rng.randrange(120)) for _ in range(8)]])
    key = lambda: rng.choice([1, 1, 1, 1, *keys])
    return [(i % 100, key(), day()) for i in range(n)], [(key(), day(), rng.randrange(5), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("slices", [None, "month", "year"])
@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_equals_a_search(spark, slices, inclusive):
    left, right = tables(7)
    right = list({(k, d, t): (k, d, t, v) for k, d, t, v in right}.values())  # one row a key, day and tie
    a = spark.createDataFrame(left, "id int, k int, day date").withColumn("_x", F.lit(1)).repartition(3)
    b = spark.createDataFrame(right, "k int, seen date, tie int, v int").repartition(4)
    got = sorted(((r.id, r.k, r.day, r.v, r.seen) for r in timed.as_of(a, b, ["k"], "day", "seen", ["v", "seen"], ties=["tie"], inclusive=inclusive, slices=slices).collect()), key=str)
    want = []
    for i, k, d in left:
        met = [r for r in right if k is not None and r[0] == k and d is not None and r[1] is not None and (r[1] <= d if inclusive else r[1] < d)]
        last = max(met, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        want.append((i, k, d, last[3], last[1]))
    assert got == sorted(want, key=str)


def test_as_of_with_empty_sides_and_clashing_names(spark):
    a, b = spark.createDataFrame([(1, DAY, 5)], "k int, day date, v int"), spark.createDataFrame([], "k int, day date, v int")
    assert timed.as_of(a, b.withColumnRenamed("v", "w"), ["k"], "day", "day", ["w"]).collect() == [(1, DAY, 5, None)]
    assert timed.as_of(b, a.withColumnRenamed("v", "w"), ["k"], "day", "day", ["w"]).count() == 0


def test_as_of_is_one_shuffle_of_each_side(spark):
    a = spark.createDataFrame([(1, DAY)], "k int, day date")
    b = spark.createDataFrame([(1, DAY, 2)], "k int, day date, v int")
    plan = _plan(timed.as_of(a, b, ["k"], "day", "day", ["v"]))
    tree = plan[: plan.index("\n\n")]
    assert tree.count("Exchange") == 1 and "Join" not in tree


def test_buckets_hold_both_ends_and_the_opening_day(spark):
    one = lambda first, last: [tuple(r) for r in spark.range(1).select(F.inline(timed.buckets(F.lit(first).cast("date"), F.lit(last).cast("date")))).collect()]
    assert one("2024-10-22", "2024-11-01") == [(k, date(2024, 10, 22) + timedelta(5 * k), date(2024, 10, 26) + timedelta(5 * k)) for k in range(3)]
    assert one("2024-10-22", "2024-10-26") == [(0, date(2024, 10, 22), date(2024, 10, 26))]
    assert len(one("2024-10-22", "2024-10-22")) == 1


@pytest.mark.parametrize("width", [1, 5, 40])
def test_range_join_equals_comparing_all(spark, width):
    rng = random.Random(width)
    rows = [(i, rng.choice([None, DAY + timedelta(rng.randrange(-50, 50))])) for i in range(80)]
    spans = [(j, DAY + timedelta(x := rng.randrange(-50, 50)), rng.choice([None, DAY + timedelta(x + rng.randrange(-2, 12))])) for j in range(30)]
    df = timed.in_range(spark.createDataFrame(rows, "i int, day date"), "day", spark.createDataFrame(spans, "j int, low date, high date"), "low", "high", width)
    assert sorted((r.i, r.j) for r in df.collect()) == sorted((i, j) for i, d in rows for j, lo, hi in spans if d and hi and lo <= d <= hi)
    assert not any(x in _plan(df) for x in ("Cartesian", "NestedLoop"))


def test_calendar_has_empty_buckets_and_leaves_the_opening_one_out(spark):
    rows = history.bucket_calendar(spark, SF).collect()
    assert any(r.n_games == 0 and r.mean_min is None for r in rows)
    assert {r.date_from.month for r in rows if r.bucket == 0} == {10} and {r.date_from.day for r in rows if r.bucket == 0} == {22}
    by = {}
    for r in sorted(rows, key=lambda r: (r.team_id, r.season, r.bucket)):
        seen = by.setdefault((r.team_id, r.season), [])
        assert (r.mean_of_means is None) == (not seen) and (not seen or abs(r.mean_of_means - sum(seen) / len(seen)) < 2e-6)
        if r.bucket and r.mean_min is not None:
            seen.append(r.mean_min)
    last = {k: max(r.bucket for r in rows if (r.team_id, r.season) == k) for k in by}
    assert all(last[k] == (35 if (int(k[1][:4]) + 1) % 4 == 0 else 34) for k in by)  # after 29 February one more starts on the last day
