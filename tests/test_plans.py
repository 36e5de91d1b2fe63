"""The plans are the wanted ones: bounded windows, pruned scans, pushed filters."""

import re

from pyspark.sql import functions as F

from statloom.operators import relational as rel
from statloom.plans import games, history, oracle, queries, scores
from statloom.sources.files import table

from .oracle import SF, connect, same


def _plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_latest_n_is_bounded_before_the_shuffle(spark):
    plan = _plan(queries.latest_n(spark, SF))
    assert plan.count("WindowGroupLimit") >= 2


def test_scans_read_only_what_is_used(spark):
    plan = _plan(queries.open_band(spark, SF))
    assert "GreaterThan(l_quantity,15.0)" in plan and "LessThan(l_quantity,25.0)" in plan
    (schema,) = set(re.findall(r"ReadSchema: (\S+)", plan))
    assert schema == "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>"


def test_games_are_added_up_before_the_join(spark):
    plan = _plan(games.player_games(spark, SF))
    tree = plan[: plan.index("\n\n")]
    assert tree.index("Join") < tree.index("Aggregate")  # the tree prints parents first
    assert "l_tax" not in plan


def test_top_k_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in _plan(queries.multi_sort_topk(spark, SF))


def test_last_row_is_an_aggregate(spark):
    plan = _plan(rel.last_row(table(spark, SF, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey"]))
    assert "Window" not in plan


def test_team_games_are_dealt_once_in_bounded_shares(spark, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(rel, "SHARE", lines // 40)
    g = games.team_games(spark, SF)
    assert g.rdd.getNumPartitions() >= 40  # was: as many as the session shuffles into, however many rows
    pairs = _plan(rel.self_pairs(games.team_games(spark, SF).hint("merge"), "game_id", "team_id", ["net"]))
    assert "REPARTITION_BY_NUM" in pairs and "ENSURE_REQUIREMENTS" not in pairs  # lines and orders are dealt once for all that goes by game
    same(queries.queries()["n_plus_one_lookup"](spark, SF), oracle.oracle_sql()["n_plus_one_lookup"], connect())


def test_head_to_head_deals_each_meeting_once(spark):
    day = "1998-01-01"
    rows = [(t, g, d, "s", v) for g, d, sides in [(1, day, [(1, 2.0), (2, 5.0), (3, None)]), (2, day, [(2, 1.0), (1, 1.5), (None, 1.0)]), (3, None, [(1, 0.1), (2, 0.3)])] for t, v in sides]
    g = spark.createDataFrame(rows, "team_id long, game_id long, game_date string, season string, net double")
    out = scores.head_to_head(g, ["net"])
    assert re.search(r"a_team_id#\d+L < b_team_id#\d+L", _plan(out))  # both orders of each pair were shuffled
    got = sorted((r.a_team_id, r.b_team_id, r.meetings, r.net_weighted, r.net_plain) for r in out.collect())
    w, p = (3 * 0.5 + 2 * -3.0 + (0.1 - 0.3)) / 6, (0.5 - 3.0 + (0.1 - 0.3)) / 3
    assert [x[:3] for x in got] == [(1, 2, 3), (1, 3, 1), (2, 1, 3), (2, 3, 1), (3, 1, 1), (3, 2, 1)]
    assert abs(got[0][3] - w) + abs(got[0][4] - p) < 1e-12 and got[2][3:] == (-got[0][3], -got[0][4])
    assert {x[3:] for x in got if 3 in x[:2]} == {(None, None)}


def test_games_as_of_reads_and_orders_the_games_once_a_side(spark):
    plan = _plan(history.games_as_of(spark, SF))
    assert "Union" not in plan  # games and history were united and ordered once more


def test_distinct_join_deals_bounded_shares(spark, monkeypatch):
    n = lambda: queries.distinct_join(spark, SF).rdd.getNumPartitions()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(rel, "SHARE", lines // 40)
    assert n() >= 40  # was: as many as the session shuffles into, however many rows
