"""Hand-computed cases of the rating formulas, and the edges of their operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statloom.functions import dates, text
from statloom.functions import metrics as m
from statloom.operators import relational as rel
from statloom.plans import model, scores

GAME = "player_id long, game_id long, game_date date, pts double, pm double, min double, fga double, fta double, tov double, oreb double"
TEAM = "team_id long, game_id long, game_date date, season string, wl string, net double, efg double, tov double, oreb double, dreb double, ft double"


def _day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


def _games(spark):
    new, old = (30.0, 6.0, 36.0, 20.0, 5.0, 2.0, 1.0), (20.0, -2.0, 30.0, 15.0, 5.0, 3.0, 1.0)
    return spark.createDataFrame([(1, i, _day(i), *(new if i >= 5 else old)) for i in range(10)], GAME)


@pytest.mark.parametrize("compat,five,recent", [(False, 1.431376, 1.036409), (True, 1.363257, 1.009162)])
def test_recent_form(spark, compat, five, recent):
    r = scores.recent_form(_games(spark), compat).first()
    assert (r.n_games, round(r.form_10, 6), round(r.form_5, 6), round(r.recent, 6)) == (10, 0.773098, five, recent)


def test_recent_form_ignores_partitions_and_older_games(spark):
    g = _games(spark)
    older = spark.createDataFrame([(1, -1, _day(-9), *[99.0] * 7)], GAME)
    assert scores.recent_form(g.union(older).repartition(7)).first() == scores.recent_form(g).first()


def test_few_games_and_no_attempts(spark):
    g = spark.createDataFrame([(1, 1, _day(1), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], GAME)
    r = scores.recent_form(g).first()
    assert r.n_games == 1 and r.recent is None


PLAYER = "player_id long, name string, gp long, min double, pie double, usg double, net double, ts double, tov double"
CLUTCH = "player_id long, clutch_score_pct double, clutch_usage_rate double, clutch_net_rating double"


def test_contribution(spark):
    p = spark.createDataFrame([(1, "a", 27, 32.0, 0.15, 0.25, 8.0, 0.6, 10.0), (2, "b", 27, 32.0, 0.15, 0.25, 8.0, 0.6, 10.0), *[(k, "x", 1, mn, 0.0, 0.0, 0.0, 0.0, 0.0) for k, mn in ((3, 25.0), (4, 15.0), (5, 25.1), (6, 15.1))]], PLAYER)
    c = spark.createDataFrame([(1, 0.5, 0.9, 2.0), (2, float("nan"), 0.9, 2.0)], CLUTCH)
    out = {r.player_id: r for r in scores.contributions(p, c, scores.recent_form(_games(spark)).union(scores.recent_form(_games(spark)).withColumn("player_id", F.lit(2).cast("long")))).collect()}
    assert [round(x, 6) for x in (out[1].primary, out[1].secondary, out[1].clutch, out[1].score)] == [0.533183, 5.375, 0.579738, 3.335295]
    assert round(out[2].score, 6) == 3.161373
    assert {k: r.category for k, r in out.items()} == {1: "Star", 2: "Star", 5: "Star", 6: "Rotation"}


def test_team_form_and_four_factors(spark):
    five = (6.0, 0.58, 12.0, 0.28, 0.72, 0.80)
    rest = tuple(2 * a - b for a, b in zip((2.0, 0.55, 13.0, 0.27, 0.71, 0.78), five))
    g = spark.createDataFrame([(1, i, _day(i), "2024-25", "W", *(five if i >= 5 else rest)) for i in range(10)], TEAM)
    assert round(scores.team_form(g).first().score, 6) == 2.830675
    assert round(scores.season_four(g).first().four, 6) == -2.705
    assert scores.team_form(g, F.lit(_day(4)), inclusive=True).first().n_games == 5
    assert scores.team_form(g, F.lit(_day(4)), inclusive=False).first().n_games == 4


@pytest.mark.parametrize("diffs,weighted,plain", [([10.0, -2.0, 4.0], 3.0, 4.0), ([-2.0, 4.0], 1.333333, 0.666667), ([50.0, 10.0, -2.0, 4.0], 3.0, 4.0)])
def test_head_to_head(spark, diffs, weighted, plain):
    rows = [(t, i, _day(i), "2024-25", "W", v, *[0.0] * 5) for i, d in enumerate(diffs) for t, v in ((1, d), (2, 0.0))]
    r = scores.head_to_head(spark.createDataFrame(rows, TEAM), ["net"]).where("a_team_id = 1").first()
    assert (round(r.net_weighted, 6), round(r.net_plain, 6)) == (weighted, plain)


def test_natural_merge_matches_nulls(spark):
    a = spark.createDataFrame([(1, None, 5.0), (2, 0.5, 6.0), (3, 1.0, 7.0)], "id long, c double, x double")
    b = spark.createDataFrame([(1, None, 8.0), (2, 0.5, 9.0), (3, 2.0, 9.0)], "id long, c double, y double")
    assert sorted((r.id, r.x, r.y) for r in rel.natural_merge(a, b).collect()) == [(1, 5.0, 8.0), (2, 6.0, 9.0)]


def test_first_match_never_multiplies(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    b = spark.createDataFrame([("x", 9), ("x", 3)], "k string, w long")
    assert sorted((r.k, r.w) for r in rel.first_match(a, b, "k", [F.asc("w")], ["w"]).collect()) == [("x", 3), ("y", None)]


def test_topped_up(spark):
    now = spark.createDataFrame([(1, 10), (2, 1), (2, 2), (2, 3), (2, 4)], "e long, g long")
    old = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (3, 1)], "e long, g long")
    got = sorted((r.e, r.g) for r in rel.topped_up(now, old, ["e"], [F.desc("g")], 3).collect())
    assert got == [(1, 6), (1, 7), (1, 10), (2, 2), (2, 3), (2, 4), (3, 1)]


def test_dates(spark):
    shown = ["2025-1-20", "03/05/2025", "APR 05, 2025", "apr 5, 2025", "13-02-2025", "02-13-2025", "nonsense", "", None]
    df = spark.createDataFrame([(s,) for s in shown], "s string")
    got = [r.d for r in df.select(dates.parse_date(F.col("s")).alias("d")).collect()]
    assert got == [dt.date(2025, 1, 20), dt.date(2025, 3, 5), dt.date(2025, 4, 5), dt.date(2025, 4, 5), dt.date(2025, 2, 13), dt.date(2025, 2, 13), None, None, None]
    df = spark.createDataFrame([(dt.date(2024, 9, 30),), (dt.date(2024, 10, 1),), (dt.date(1999, 12, 1),), (None,)], "d date")
    assert [r[0] for r in df.select(dates.season_of(F.col("d"))).collect()] == ["2023-24", "2024-25", "1999-00", None]
    assert [r[0] for r in df.limit(2).select(dates.bucket(F.col("d"), dates.season_start(F.col("d")))).collect()] == [73, 0]


def test_text(spark):
    df = spark.createDataFrame([("PHI vs. HOU",), ("PHI @ HOU",)], "m string")
    rows = df.select(text.matchup_team(F.col("m")), text.matchup_team(F.col("m"), own=False), text.is_home(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [("PHI", "PHI", True), ("PHI", "HOU", False)]
    df = spark.createDataFrame([(" Dennis Schröder",), ("Bojan Bogdanović",), ("D'Angelo Russell ",), ("Straße ø",), (None,)], "n string")
    assert [r[0] for r in df.select(text.plain_name("n")).collect()] == ["dennis schroder", "bojan bogdanovic", "d'angelo russell", "strae", None]
    df = spark.createDataFrame([("$453,173",), ("54",), ("n/a",), (None,)], "s string")
    assert [r[0] for r in df.select(text.money(F.col("s"))).collect()] == [453173.0, 54.0, None, None]


def test_clutch_metrics_without_attempts(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0)], "fgm double, fga double, fta double, tov double, min double, pm double, gp long")
    r = df.select(*[v.alias(k) for k, v in m.clutch_metrics(*[F.col(c) for c in df.columns]).items()]).first()
    assert (r.clutch_score_pct, r.clutch_usage_rate, r.clutch_net_rating) == (0.0, None, None)


def test_ridge_equals_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ [2.0, -1.0] + rng.normal(size=60)
    df = spark.createDataFrame([(float(a), float(b), float(v), float(i)) for i, ((a, b), v) in enumerate(zip(x, y))] + [(None, 1.0, 5.0, 99.0)], "a double, b double, y double, min double")
    intercept, beta = model.ridge_fit(df, ["a", "b"], "y", 0.5)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(2), xc.T @ yc)
    assert [beta["a"], beta["b"]] == pytest.approx(want.tolist())
    assert intercept == pytest.approx(y.mean() - want @ x.mean(0))
    xc, yc = x[10:] - x[10:].mean(0), y[10:] - y[10:].mean()
    want = np.linalg.solve(xc.T @ xc + 0.5 * np.eye(2), xc.T @ yc)
    intercept = y[10:].mean() - want @ x[10:].mean(0)
    out = {r.min: r.e for r in model.ridge_blend(df, ["a", "b"], "y", "min", "e").collect()}
    assert out[20.0] == pytest.approx(y[20]) and out[0.0] == pytest.approx(intercept + x[0] @ want)
