"""Scores of players and teams, each as one DataFrame plan over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions import metrics as m
from statloom.operators.relational import latest_n, self_pairs, topped_up

_BOX = ("pts", "pm", "min", "fga", "fta", "tov", "oreb")
_TEAM = ("net", "efg", "tov", "oreb", "dreb", "ft")


def recent_form(games: DataFrame, compat: bool = False) -> DataFrame:
    """player_id, n_games, form_10, form_5, recent: form over a player's latest ten and five games.

    One window keeps ten games a player, one aggregation makes both averages. ``compat``: the five-game form uses
    the ten-game net rating.
    """
    last = latest_n(games, ["player_id"], [F.desc("game_date"), F.desc("game_id")], 10)
    five = F.col("rn") <= 5
    a = last.groupBy("player_id").agg(F.count("*").cast("double").alias("n10"), F.sum(F.when(five, 1.0)).alias("n5"), *[F.avg(c).alias(f"{c}10") for c in _BOX], *[F.avg(F.when(five, F.col(c))).alias(f"{c}5") for c in _BOX])
    ten, few = ({**{c: F.col(f"{c}{n}") for c in _BOX}, "n": F.col(f"n{n}")} for n in (10, 5))
    net = m.net_rating(ten["pm"], m.possessions(ten["fga"], ten["fta"], ten["oreb"], ten["tov"])) if compat else None
    out = a.select("player_id", F.col("n10").cast("long").alias("n_games"), m.form(ten).alias("form_10"), m.form(few, net).alias("form_5"))
    return out.withColumn("recent", m.blend(F.col("form_10"), F.col("form_5")))


def contributions(players: DataFrame, clutch: DataFrame, recent: DataFrame, team_games: str | None = None, others: str | None = None) -> DataFrame:
    """Contribution of each player: players has player_id, name, gp, min, pie, usg, net, ts, tov; clutch and recent are left-joined.

    Players outside both minute bands (more than 25; between 15 and 25) drop out, or stay with the category
    ``others``; a player without clutch rows scores 0 there. ``team_games``: a column with the games of the player's
    team, of which the games factor is then a share (else of a fixed number).
    """
    p = players.withColumn("category", m.category(F.col("min")) if others is None else F.coalesce(m.category(F.col("min")), F.lit(others))).where(F.col("category").isNotNull())
    p = p.join(clutch.select("player_id", "clutch_score_pct", "clutch_usage_rate", "clutch_net_rating"), "player_id", "left").join(recent.select("player_id", "recent"), "player_id", "left")
    factor = m.games_factor(F.col("gp"), F.col(team_games).cast("double")) if team_games else m.games_factor(F.col("gp"))
    first = m.primary(F.col("pie"), F.col("usg"), F.col("net"), factor)
    second = m.secondary(F.col("ts"), F.col("tov"), F.col("min"))
    close = m.clutch(F.col("clutch_score_pct"), F.col("clutch_usage_rate"), F.col("clutch_net_rating"), factor)
    out = p.select("player_id", "name", first.alias("primary"), second.alias("secondary"), close.alias("clutch"), F.col("recent"), "category")
    return out.withColumn("score", m.contribution(F.col("primary"), F.col("secondary"), F.col("clutch"), F.col("recent")))


def team_form(games: DataFrame, before: Column | None = None, inclusive: bool = True) -> DataFrame:
    """team_id, n_games and score from a team's latest ten and five games up to a date; divisors are 10 and 5 always."""
    if before is not None:
        games = games.where(F.col("game_date") <= before if inclusive else F.col("game_date") < before)
    last = latest_n(games, ["team_id"], [F.desc("game_date"), F.desc("game_id")], 10)
    blended = {c: 0.6 * F.sum(c) / 10 + 0.4 * F.coalesce(F.sum(F.when(F.col("rn") <= 5, F.col(c))), F.lit(0.0)) / 5 for c in _TEAM}
    a = last.groupBy("team_id").agg(F.count("*").alias("n_games"), *[v.alias(c) for c, v in blended.items()])
    four = m.four_factors(F.col("efg"), F.col("tov") / 100, F.col("oreb"), F.col("dreb"), F.col("ft"))
    return a.select("team_id", "n_games", "net", four.alias("four"), m.team_score(F.col("net"), four).alias("score"))


def season_four(games: DataFrame) -> DataFrame:
    """Net rating and four factors of each team and season; turnovers are not divided by 100 here."""
    a = games.groupBy("team_id", "season").agg(*[F.avg(c).alias(c) for c in _TEAM])
    return a.select("team_id", "season", "net", m.four_factors(F.col("efg"), F.col("tov"), F.col("oreb"), F.col("dreb"), F.col("ft")).alias("four"))


def head_to_head(games: DataFrame, metrics: list[str], before: Column | None = None, n: int = 3, seasons: tuple[str, str] | None = None) -> DataFrame:
    """Weighted (n..1, newest first) and plain mean differences of two teams' latest n meetings; divisors are fixed.

    ``seasons``: meetings of the first season count, and where there are fewer than n, the latest of the second top them up.
    Each meeting is dealt once, with its differences alone: seen from the other team they have the opposite sign.
    """
    if before is not None:
        games = games.where(F.col("game_date") < before)
    if seasons:
        games = games.where(F.col("season").isin(*seasons))
    pairs = self_pairs(games, "game_id", "team_id", ["game_date", "season", *metrics]).where("a_team_id < b_team_id")
    pairs = pairs.select("a_team_id", "b_team_id", "game_id", "a_game_date", *(["a_season"] if seasons else []), *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in metrics])
    order = [F.desc("a_game_date"), F.desc("game_id")]
    if seasons:
        last = topped_up(*[pairs.where(F.col("a_season") == s) for s in seasons], ["a_team_id", "b_team_id"], order, n)
    else:
        last = latest_n(pairs, ["a_team_id", "b_team_id"], order, n)
    weight = F.lit(n + 1) - F.col("rn")
    aggs = [F.count("*").alias("meetings")]
    for c in metrics:
        aggs += [(F.sum(weight * F.col(c)) / (n * (n + 1) / 2)).alias(f"{c}_weighted"), (F.sum(c) / n).alias(f"{c}_plain")]
    one = last.groupBy("a_team_id", "b_team_id").agg(*aggs)
    values = [f"{c}_{k}" for c in metrics for k in ("weighted", "plain")]
    seen = F.array(*[F.struct(F.col(x).alias("a_team_id"), F.col(y).alias("b_team_id"), "meetings", *[(F.lit(0.0) + f * F.col(v)).alias(v) for v in values]) for x, y, f in (("a_team_id", "b_team_id", 1), ("b_team_id", "a_team_id", -1))])
    return one.select(F.inline(seen))


def strength_of_schedule(games: DataFrame, before: Column | None = None) -> DataFrame:
    """team_id, mean win rate and mean net rating of the opponents met, an opponent counted once a meeting."""
    if before is not None:
        games = games.where(F.col("game_date") < before)
    own = games.groupBy("team_id").agg(F.avg(F.when(F.col("wl") == "F", 1.0).otherwise(0.0)).alias("win_rate"), F.avg("net").alias("net_rating"))
    met = self_pairs(games, "game_id", "team_id", []).select(F.col("a_team_id").alias("team"), F.col("b_team_id").alias("team_id"))
    return met.join(own, "team_id").groupBy(F.col("team").alias("team_id")).agg(F.count("*").alias("meetings"), F.avg("win_rate").alias("opponent_win_rate"), F.avg("net_rating").alias("opponent_net"))


def sliding_form(games: DataFrame, column: str, games_back: int = 10) -> DataFrame:
    """Mean and sample deviation of a player's last games, at each game (an extension)."""
    w = Window.partitionBy("player_id").orderBy("game_date", "game_id").rowsBetween(1 - games_back, 0)
    return games.select("player_id", "game_id", "game_date", F.avg(column).over(w).alias("mean"), F.stddev_samp(column).over(w).alias("deviation"))
