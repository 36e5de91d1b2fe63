"""The driver's order tables read as games: orders are games, customers players, suppliers teams.

An order's lines make a player's game; the lines of one supplier in an order make a team's game. Money is summed in
whole hundredths, so results do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import dates
from statloom.functions import metrics as m
from statloom.operators.relational import shares
from statloom.sources.files import table


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("double")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _hundredths(x: Column) -> Column:
    """A value above 0 with two decimals in whole hundredths; rounding by ``floor`` stays in plain arithmetic, where ``round`` makes a decimal of every value."""
    return F.floor(x * 100 + 0.5)


def _box() -> list[Column]:
    price = _hundredths(F.col("l_extendedprice"))
    pts = F.sum(price * _hundredths(1 - F.col("l_discount"))) / F.lit(1e7)
    gross = F.sum(price) / F.lit(1e5)
    return [pts.alias("pts"), (pts - 0.95 * gross).alias("pm"), F.sum("l_quantity").alias("min"), F.count("*").cast("double").alias("fga"), _count(F.col("l_linestatus") == "F").alias("fta"), _count(F.col("l_returnflag") == "R").alias("tov"), _count(F.col("l_returnflag") == "A").alias("oreb")]


def player_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player_id, game_id, game_date, season, wl and the box score: pts, pm, min, fga, fta, tov, oreb.

    Lines are added up by order before the join, so the join moves one row a game.
    """
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    box = lines.groupBy("l_orderkey").agg(*_box())
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    day = F.col("o_orderdate").cast("date")
    return orders.join(box, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("player_id"), F.col("o_orderkey").alias("game_id"), day.alias("game_date"), dates.season_of(day).alias("season"), F.col("o_orderstatus").alias("wl"), "pts", "pm", "min", "fga", "fta", "tov", "oreb")


def team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """team_id, game_id, game_date, season, wl and a team's ratings in the game: net, efg, tov, oreb, dreb, ft.

    Few lines share an order and a supplier, so adding them up before a shuffle would keep nearly every line in a task's
    memory. Lines and orders are dealt by order once, in shares of bounded size; all later steps by game stay there.
    """
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    n = shares(lines)
    lines = lines.repartition(n, "l_orderkey")
    box = lines.groupBy("l_orderkey", "l_suppkey").agg(*_box(), _count(F.col("l_returnflag") == "N").alias("dreb"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").repartition(n, "o_orderkey")
    day = F.col("o_orderdate").cast("date")
    g = orders.join(box, F.col("o_orderkey") == F.col("l_orderkey"))
    share = lambda c: F.col(c) / F.col("fga")
    return g.select(F.col("l_suppkey").alias("team_id"), F.col("o_orderkey").alias("game_id"), day.alias("game_date"), dates.season_of(day).alias("season"), F.col("o_orderstatus").alias("wl"), (F.col("pm") / F.col("fga")).alias("net"), m.true_shooting(F.col("pts"), F.col("fga"), F.col("fta")).alias("efg"), (100 * share("tov")).alias("tov"), share("oreb").alias("oreb"), share("dreb").alias("dreb"), share("fta").alias("ft"))


def clutch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close-game numbers of the players that have events: gp, min, fgm, fga, fta, tov, pm."""
    e = table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value")
    value = F.sum(_cents("value")) / F.lit(100.0)
    signed = F.sum(F.when(F.col("event_type") == "error", -_cents("value")).otherwise(_cents("value"))) / F.lit(1e4)
    kind = F.col("event_type")
    return e.groupBy(F.col("user_id").alias("player_id")).agg(F.countDistinct(F.col("ts").cast("date")).alias("gp"), value.alias("min"), _count(kind == "purchase").alias("fgm"), _count(kind.isin("purchase", "click")).alias("fga"), _count(kind == "signup").alias("fta"), _count(kind == "error").alias("tov"), signed.alias("pm"))
