"""Queries over time: features as of each game, calendars, ratings by season, and tables that grow, arrive late or change shape."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom.functions import metrics as m
from statloom.operators import mutate, publish, timed
from statloom.operators import relational as rel
from statloom.plans import games, landing, model
from statloom.sources import files, result_sets
from statloom.sources.files import table
from statloom.sources.schemas import TABLES, Table
from statloom.streaming import landed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(f):
    QUERIES[f.__name__] = f
    return f


def _millionths(x: Column) -> Column:
    """A value in whole millionths, whose sums do not depend on their order."""
    return F.floor(x * 1e6 + 0.5)


def _sure(x: Column, name: str) -> Column:
    return m.settled(x).alias(name)


# ------------------------------------------------------------------ as of each game


def team_history(spark: SparkSession, d: str) -> DataFrame:
    """team_id, game_date and what stands after that day's last game: form over ten games, games and wins of the season."""
    g = games.team_games(spark, d).select("team_id", "game_id", "game_date", "season", (F.col("wl") == "F").cast("long").alias("won"), _millionths(F.col("net")).alias("net"))
    g = g.repartition(rel.shares(table(spark, d, "lineitem", "l_orderkey")), "team_id")
    by_team = Window.partitionBy("team_id").orderBy("game_date", "game_id")
    ten, of_season = by_team.rowsBetween(-9, 0), Window.partitionBy("team_id", "season").orderBy("game_date", "game_id").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("team_id", "game_id", "game_date", "season", (F.sum("net").over(ten) / F.count("*").over(ten)).alias("form"), F.count("*").over(of_season).alias("played"), F.sum("won").over(of_season).alias("won"))


@_register
def games_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of sides of each game, with both sides' form and record before its day; a record of another season counts as none."""
    of_team = Window.partitionBy("team_id").orderBy(F.datediff("game_date", F.lit("1970-01-01").cast("date")))
    place = F.when(F.col("game_date").isNotNull(), F.struct("game_date", "game_id"))
    earlier = F.max_by(F.struct("form", "played", "won", "season"), place).over(of_team.rangeBetween(Window.unboundedPreceding, -1))
    known = team_history(spark, d).withColumn("known", F.when(F.col("game_date").isNotNull(), earlier))
    same = F.col("known.season") == F.col("season")
    record = known.select("team_id", "game_id", "game_date", (F.col("known.form") / 1e6).alias("form"), *[F.coalesce(F.when(same, F.col(f"known.{c}")), F.lit(0)).alias(c) for c in ("played", "won")])
    pairs = rel.self_pairs(record, "game_id", "team_id", ["game_date", "form", "played", "won"]).where("a_team_id < b_team_id")
    return pairs.select("game_id", F.col("a_game_date").alias("game_date"), F.col("a_team_id").alias("team_1"), F.col("b_team_id").alias("team_2"), *[_sure(F.col(f"{s}_form"), f"form_{k}") for k, s in ((1, "a"), (2, "b"))], *[F.col(f"{s}_{c}").alias(f"{c}_{k}") for k, s in ((1, "a"), (2, "b")) for c in ("played", "won")])


@_register
def orders_as_of_sliced(spark: SparkSession, d: str) -> DataFrame:
    """The customer's latest earlier or same-day urgent order at each order, by slices of a quarter (for customers with very many)."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderdate").alias("urgent_date"), F.col("o_orderkey").alias("urgent_key"))
    return timed.as_of(o.select("o_orderkey", "o_custkey", "o_orderdate"), urgent, ["o_custkey"], "o_orderdate", "urgent_date", ["urgent_key", "urgent_date"], ties=["urgent_key"], inclusive=True, slices="quarter")


# ------------------------------------------------------------------ calendar


@_register
def bucket_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Every five-day bucket of a team's seasons (22 October to 14 April, both included), empty ones too, with the mean of bucket means up to it.

    Buckets that start on the season's first day, and empty ones, stay out of that mean, as do those that end later.
    """
    g = games.player_games(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team_id")), "player_id")
    g = g.select("team_id", "season", "game_date", F.col("min").cast("long").alias("min"))
    year = F.left("season", F.lit(4)).cast("int")
    first, last = F.make_date(year, F.lit(10), F.lit(22)), F.make_date(year + 1, F.lit(4), F.lit(14))
    spine = g.select("team_id", "season").distinct().select("team_id", "season", F.inline(timed.buckets(first, last)))
    held = timed.in_range(g, "game_date", spine, "date_from", "date_to", 5, on=["team_id", "season"])
    per = held.groupBy("team_id", "season", "bucket").agg(F.count("*").alias("n_games"), F.sum("min").alias("total"))
    every = spine.join(per, ["team_id", "season", "bucket"], "left")
    mean = F.floor(F.col("total") * 1e6 / F.col("n_games") + 0.5)
    before = Window.partitionBy("team_id", "season").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("bucket") > 0, mean)
    so_far = F.sum(counted).over(before) / F.count(counted).over(before)
    return every.select("team_id", "season", F.col("bucket").cast("long").alias("bucket"), "date_from", "date_to", F.coalesce("n_games", F.lit(0)).alias("n_games"), _sure(mean / 1e6, "mean_min"), _sure(so_far / 1e6, "mean_of_means"))


# ------------------------------------------------------------------ ratings


def season_roster(spark: SparkSession, d: str) -> DataFrame:
    """Players of each season with their ratings over it."""
    a = games.player_games(spark, d).groupBy("season", "player_id").agg(F.count("*").alias("gp"), F.sum(F.when(F.col("wl") == "F", 1).otherwise(0)).alias("wins"), *[F.avg(c).alias(c) for c in ("min", "pts", "pm", "fga", "fta", "tov", "oreb")])
    poss = m.possessions(F.col("fga"), F.col("fta"), F.col("oreb"), F.col("tov"))
    rated = {"off": m.ratio(F.col("pts"), poss), "def": m.ratio(F.col("pts") - F.col("pm"), poss), "usg": m.usage(F.col("fga"), F.col("fta"), F.col("tov"), F.col("min")), "ts": m.true_shooting(F.col("pts"), F.col("fga"), F.col("fta")), "pie": m.ratio(F.col("fta"), F.col("fga")), "tov": m.turnover_rate(F.col("fga"), F.col("fta"), F.col("tov"))}
    return a.select("season", "player_id", "gp", "wins", (F.col("min") / 4).alias("min"), *[v.alias(k) for k, v in rated.items()])


@_register
def season_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Estimated ratings of each season's players, from regressions of that season; one aggregation for all of them."""
    out = model.ratings_by_group(season_roster(spark, d), ["season"], (["usg", "ts", "pie"], "off"), (["pie", "tov", "usg"], "def"), "min", least=20.0)
    return out.select("season", "player_id", *[_sure(F.col(c), c) for c in ("e_off", "e_def", "e_net")])


def final_scores(spark: SparkSession, d: str) -> DataFrame:
    """Players with win-share score, clutch score, availability and the final score made of them.

    Wins are a player's won games, shared between offence and defence as the points scored and allowed are.
    """
    g = games.player_games(spark, d)
    ranked = rel.numbered(g, ["player_id"], [F.desc("game_date"), F.desc("game_id")])
    recent = F.count(F.when((F.col("rn") <= 10) & (F.col("min") > 0), 1))
    a = ranked.groupBy("player_id").agg(F.count("*").alias("gp"), F.sum(F.when(F.col("wl") == "F", 1).otherwise(0)).alias("wins"), F.sum("min").alias("min"), F.sum(_millionths(F.col("pts"))).alias("pts"), F.sum(_millionths(F.col("pts") - F.col("pm"))).alias("allowed"), recent.alias("last"))
    ows = m.known(m.ratio(F.col("wins") * F.col("pts").cast("double"), F.col("pts") + F.col("allowed")))
    wins = m.win_share_score(m.known(m.ratio(48.0 * F.col("wins"), F.col("min"))), ows, F.col("wins") - ows)
    c = games.clutch(spark, d)
    close = m.clutch_score(m.ratio(F.col("pm"), F.col("gp")), m.ratio(2 * F.col("fgm") + F.col("fta"), F.col("gp").cast("double")), m.ratio(F.col("fgm"), F.col("fga")), m.ratio(F.col("pm"), F.col("min")))
    out = a.select("player_id", wins.alias("win_shares"), m.availability(F.col("gp"), 82.0, F.col("last")).alias("available")).join(c.select("player_id", close.alias("clutch")), "player_id", "left")
    out = out.withColumn("clutch", F.coalesce("clutch", F.lit(0.0)))
    return out.withColumn("score", m.final_score(F.col("win_shares"), F.col("clutch"), F.col("available")))


@_register
def final_ranking(spark: SparkSession, d: str) -> DataFrame:
    return final_scores(spark, d).select("player_id", *[_sure(F.col(c), c) for c in ("win_shares", "clutch", "available", "score")])


@_register
def team_decision(spark: SparkSession, d: str) -> DataFrame:
    """Teams by their own net rating and the mean final score of their eight best players."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team_id"))
    scores = final_scores(spark, d).select("player_id", _millionths(F.col("score")).alias("score")).join(c, "player_id")
    best = rel.latest_n(scores, ["team_id"], [F.desc("score"), F.asc("player_id")], 8).groupBy("team_id").agg((F.sum("score") / F.count("*") / 1e6).alias("players"))
    own = games.player_games(spark, d).join(c, "player_id").groupBy("team_id").agg((F.sum(_millionths(F.col("pm"))) / F.sum("fga") / 1e6).alias("team"))
    return own.join(best, "team_id").select("team_id", _sure(F.col("team"), "team"), _sure(F.col("players"), "players"), _sure(m.decision(F.col("team"), F.col("players")), "decision"))


@_register
def listed_games(spark: SparkSession, d: str) -> DataFrame:
    """Games in the order of a list of ids (here by falling price), with their place in it."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    ids = o.where("o_custkey % 10 = 3").select("o_orderkey", (-F.floor(F.col("o_totalprice") * 100 + 0.5)).cast("long").alias("place"))
    return rel.listed(o, ids.unionByName(ids.withColumn("place", F.col("place") + 7)), "o_orderkey", "place").orderBy("place", "o_orderkey").select("o_orderkey", "o_custkey", "place")


# ------------------------------------------------------------------ landed result sets


def _land_sets(spark: SparkSession, d: str, path: str) -> None:
    """Players as landed responses of at most 500 rows: most as they should be, some broken in each known way."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    page, kind = F.col("page"), F.col("page") % 11
    row = F.array(F.col("c_name"), F.col("c_custkey").cast("string"), F.when((kind == 5) & (F.col("c_custkey") % 2 == 0), "n/a").otherwise(F.col("c_nationkey").cast("string")), F.format_string("%.2f", "c_acctbal"), F.lit("x"))
    row = F.when((kind == 4) & (F.col("c_custkey") % 500 == 7), F.slice(row, 1, 3)).otherwise(row)
    names = ["PLAYER_NAME", "PLAYER_ID", "TEAM_ID", "PTS", "OTHER"]
    headers = F.when(kind == 2, F.array(*map(F.lit, ["PLAYER_NAME", "ID", *names[2:]]))).when(kind == 3, F.array(*map(F.lit, [*names[:4], "PTS"]))).otherwise(F.array(*map(F.lit, names)))
    sets = c.withColumn("page", F.floor(F.col("c_custkey") / 37).cast("int")).withColumn("row", row).groupBy("page").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    other = F.struct(F.lit("Totals").alias("name"), F.array(F.lit("N")).alias("headers"), F.array(F.array(F.lit("1"))).alias("rowSet"))
    mine = F.struct(F.when(kind == 6, "Player").otherwise("Players").alias("name"), headers.alias("headers"), F.when(kind != 7, F.col("rows")).alias("rowSet"))
    doc = F.to_json(F.struct(F.concat(F.lit("players/"), page.cast("string")).alias("resource"), F.array(other, mine).alias("resultSets")))
    sets.select(F.when(kind == 1, F.lit("<html>502</html>")).otherwise(doc).alias("value")).write.text(path)


@_register
def landed_result_sets(spark: SparkSession, d: str) -> DataFrame:
    path = landing._place(spark, "sets")
    _land_sets(spark, d, path)
    return result_sets.result_sets(spark, path, TABLES["players_misc"], "Players").select("PLAYER_ID", "PLAYER_NAME", "TEAM_ID", "PTS", "GP")


@_register
def result_set_problems(spark: SparkSession, d: str) -> DataFrame:
    path = landing._place(spark, "sets")
    _land_sets(spark, d, path)
    return result_sets.problems(spark, path, TABLES["players_misc"], "Players").select("resource", "problem", "n_rows", F.contains("file", F.lit("/landing/sets-")).alias("names_file"))


# ------------------------------------------------------------------ late rows, new pages

#: Deliveries of the events, days that each spans, and the lookback.
DELIVERIES, SPAN, LATE = 6, 5, "8 days"


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Events with the delivery in which each arrives; by the last digit of their number some come late, again, or corrected."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.least(F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / SPAN), F.lit(DELIVERIES - 1)).cast("int")
    digit, later = F.col("event_id") % 10, F.col("own") + 1
    e = e.withColumn("own", own).withColumn("version", F.lit(1)).withColumn("bucket", own)
    arrives = (
        F.when((digit == 9) & (F.col("own") < 2), F.array(F.col("own") + 4))  # behind the watermark by then
        .when((digit == 6) & (later < DELIVERIES), F.array(later))  # late, within the lookback
        .when(digit.isin(7, 8) & (later < DELIVERIES), F.array(F.col("own"), later))  # corrected, or delivered again
        .otherwise(F.array(F.col("own")))
    )
    out = e.withColumn("delivery", F.explode(arrives))
    corrected = (digit == 7) & (F.col("delivery") > F.col("own"))
    return out.select("event_id", "ts", "user_id", F.when(corrected, F.col("value") + 1).otherwise(F.col("value")).alias("value"), F.when(corrected, 2).otherwise(1).alias("version"), "bucket", "delivery")


@_register
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Six deliveries of events, each absorbed by a run of its own: late rows within the lookback count, rows behind it do not."""
    place = landing._place(spark, "late")
    every = deliveries(spark, d)
    schema = every.drop("delivery").schema
    for k in range(DELIVERIES):
        every.where(F.col("delivery") == k).drop("delivery").write.parquet(f"{place}/landed/delivery={k}")
        landed.late_refresh(spark, f"{place}/landed/*", schema, f"{place}/events", f"{place}/state", ["event_id"], "ts", "version", "bucket", LATE).awaitTermination()
    return spark.read.schema(schema).parquet(f"{place}/events").select("event_id", "user_id", F.round("value", 6).alias("value"), F.col("version").cast("long").alias("version"), F.col("bucket").cast("long").alias("bucket"))


@_register
def crawled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that land in two parts; each run parses only what is new."""
    place = landing._place(spark, "crawl")
    p = table(spark, d, "pages", "page_id", "url", "html")
    for k in range(2):
        p.where(F.pmod("page_id", F.lit(2)) == k).write.parquet(f"{place}/landed/part={k}")
        landed.crawl(spark, f"{place}/landed/*", p.schema, f"{place}/parsed", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/parsed")


# ------------------------------------------------------------------ tables that change


@_register
def bucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A merge into a bucketed table: only the changed rows are shuffled."""
    from statloom.plans.queries import _stage

    old, changed = _stage(spark, d)
    names = [f"bucketed_{uuid.uuid4().hex}" for _ in range(2)]
    old.write.bucketBy(8, "c_custkey").sortBy("c_custkey").saveAsTable(names[0])
    publish.upsert_bucketed(names[0], changed, "c_custkey", names[1], 8)
    spark.sql(f"DROP TABLE {names[0]}")
    return spark.table(names[1]).select("c_custkey", "c_name", F.round("c_acctbal", 6).alias("c_acctbal"))


#: A table that was written under two schemas: one column got another name, one came later, one went.
GROWN = Table("grown", "c_custkey BIGINT, c_name STRING, balance DOUBLE, TEAM_ID BIGINT", ("c_custkey",), renamed={"c_acctbal": "balance"})


@_register
def evolved_columns(spark: SparkSession, d: str) -> DataFrame:
    path, c = landing._place(spark, "grown"), table(spark, d, "customer")
    c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("C_CustKey"), "c_name", "c_acctbal", "c_mktsegment").write.parquet(f"{path}/generation=1")
    c.where("c_custkey % 2 <> 0").select("c_custkey", "c_name", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("TEAM_ID")).write.parquet(f"{path}/generation=2")
    return files.generations(spark, path, GROWN).withColumn("balance", F.round("balance", 6))


@_register
def published_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Three refreshes of a table; the second holds a key twice and the third lacks a parent, so that the first stands."""
    path = landing._place(spark, "published")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    parents = {"o_custkey": (table(spark, d, "customer", "c_custkey"), "c_custkey")}
    publish.publish(o.where("o_custkey % 3 > 0"), path, ["o_orderkey"], parents)
    cut = F.lit("1998-06-01").cast("date")
    fresh = o.where((F.col("o_orderdate") >= cut) & (F.col("o_custkey") % 3 == 0)).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    publish.publish(mutate.replace_since(publish.current(spark, path), fresh, "o_orderdate", cut), path, ["o_orderkey"], parents)
    for bad in (fresh.unionByName(fresh), fresh.withColumn("o_custkey", -F.col("o_custkey"))):
        try:
            publish.publish(mutate.replace_since(publish.current(spark, path), bad, "o_orderdate", cut), path, ["o_orderkey"], parents)
        except publish.Refused:
            continue
        if not bad.isEmpty():
            raise AssertionError("a broken refresh was published")
    return publish.current(spark, path).select("o_orderkey", "o_custkey", "o_orderdate", F.round("o_totalprice", 6).alias("o_totalprice"))
