"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import dates, html, text
from statloom.functions import metrics as m
from statloom.operators import mutate
from statloom.operators import relational as rel
from statloom.plans import games, landing, model, scores
from statloom.sources.files import query, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

_AS_OF = "1998-06-01"
_TEAM_METRICS = ["net", "efg", "oreb"]


def _register(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _r(c: str | Column, name: str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ------------------------------------------------------------------ scans, projection, filters


@_register
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("twice"), F.lit("player").alias("kind"), F.lit(None).cast("string").alias("note"))


@_register
def param_filter(spark: SparkSession, d: str) -> DataFrame:
    return query(spark, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders_in WHERE o_custkey = :player AND o_totalprice > :least", {"orders_in": table(spark, d, "orders")}, player=7, least=1000.0)


@_register
def open_band(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where(rel.open_band(F.col("l_quantity"), 15, 25)).select("l_orderkey", "l_partkey", "l_quantity")


@_register
def date_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    day, cut = F.col("o_orderdate").cast("date"), F.lit(_AS_OF).cast("date")
    o = table(spark, d, "orders", "o_orderdate")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return o.agg(n(day <= cut).alias("le"), n(day < cut).alias("lt"), n(day > cut).alias("gt"), n(day >= F.date_sub(cut, 20)).alias("lookback"), n(day != cut).alias("ne"))


@_register
def null_rows_removed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    return c.join(games.clutch(spark, d).select(F.col("player_id").alias("c_custkey"), "min"), "c_custkey", "left").dropna(subset=["min"]).where("min >= 10").select("c_custkey", "c_nationkey", _r("min", "min"))


@_register
def substring_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name")
    return p.where(~F.contains("p_name", F.lit("ring")) & F.col("p_name").rlike(r"[\p{L}\p{N}]"))


@_register
def lookup_search(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation", "n_nationkey", "n_name").where(F.lower("n_name").rlike("_1[0-9]$"))


@_register
def semi_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_name").join(table(spark, d, "events").select(F.col("user_id").alias("c_custkey")).distinct(), "c_custkey", "left_semi")


@_register
def existence(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").where((F.col("o_custkey") == 7) & (day <= F.lit(_AS_OF).cast("date"))).agg((F.count("*") > 0).alias("played"), F.count("*").alias("n"))


# ------------------------------------------------------------------ windows, top-k, sorts


@_register
def latest_n(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rel.latest_n(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("game_date"), "o_totalprice", F.col("rn").cast("long").alias("rn"))


@_register
def as_of_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").where(F.col("o_orderdate").cast("date") <= F.lit(_AS_OF).cast("date"))
    return rel.latest_n(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@_register
def nested_windows(spark: SparkSession, d: str) -> DataFrame:
    g = rel.latest_n(games.player_games(spark, d), ["player_id"], [F.desc("game_date"), F.desc("game_id")], 15)
    avg = lambda n: F.avg(F.when(F.col("rn") <= n, F.col("min")))
    return g.groupBy("player_id").agg(_r(avg(5), "min_5"), _r(avg(10), "min_10"), _r(avg(15), "min_15"))


@_register
def positional_weights(spark: SparkSession, d: str) -> DataFrame:
    g = rel.latest_n(games.player_games(spark, d), ["player_id"], [F.desc("game_date"), F.desc("game_id")], 3)
    return g.groupBy("player_id").agg(_r(F.sum((4 - F.col("rn")) * F.col("fga")) / 6, "weighted_fga"))


@_register
def rank_cols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_retailprice")
    from pyspark.sql import Window

    return p.select("p_partkey", "p_brand", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"))).cast("long").alias("price_rank"))


@_register
def multi_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return o.orderBy(F.desc_nulls_last("o_totalprice"), F.asc("o_custkey"), F.desc("o_orderkey")).limit(25).select("o_orderkey", "o_custkey", "o_totalprice")


@_register
def sort_by_text_date(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.upper_date(F.col("o_orderdate")).alias("game_date"))
    return o.orderBy(F.desc(dates.parse_date(F.col("game_date"), ("MMM d, y",))), F.desc("o_orderkey")).limit(20)


# ------------------------------------------------------------------ joins


def _roster(spark: SparkSession, d: str, g: DataFrame | None = None) -> DataFrame:
    """Players with their ratings over all (or the given) games: name, team_id, gp, min (minutes a game), pie, usg, net, off, def, ts, tov."""
    g = games.player_games(spark, d) if g is None else g
    a = g.groupBy("player_id").agg(F.count("*").alias("gp"), *[F.avg(c).alias(c) for c in ("min", "pts", "pm", "fga", "fta", "tov", "oreb")])
    pie = m.ratio(F.col("fta"), F.col("fga"))
    poss = m.possessions(F.col("fga"), F.col("fta"), F.col("oreb"), F.col("tov"))
    rated = a.select("player_id", "gp", (F.col("min") / 4).alias("min"), pie.alias("pie"), m.usage(F.col("fga"), F.col("fta"), F.col("tov"), F.col("min")).alias("usg"), m.net_rating(F.col("pm"), m.possessions(F.col("fga"), F.col("fta"), F.col("oreb"), F.col("tov"))).alias("net"), m.ratio(F.col("pts"), poss).alias("off"), m.ratio(F.col("pts") - F.col("pm"), poss).alias("def"), m.true_shooting(F.col("pts"), F.col("fga"), F.col("fta")).alias("ts"), m.turnover_rate(F.col("fga"), F.col("fta"), F.col("tov")).alias("tov"))
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    return c.join(rated, F.col("c_custkey") == F.col("player_id")).select("player_id", F.col("c_name").alias("name"), F.col("c_nationkey").alias("team_id"), "gp", "min", "pie", "usg", "net", "off", "def", "ts", "tov")


def _clutch(spark: SparkSession, d: str) -> DataFrame:
    c = games.clutch(spark, d)
    return c.select("player_id", "gp", *[v.alias(k) for k, v in m.clutch_metrics(*[F.col(x) for x in ("fgm", "fga", "fta", "tov", "min", "pm")], F.col("gp").cast("double")).items()])


@_register
def roster_inner_left_left(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    clutch = _clutch(spark, d).select(F.col("player_id").alias("c_custkey"), "clutch_score_pct")
    last = rel.last_row(table(spark, d, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey"]).withColumnsRenamed({"o_custkey": "c_custkey", "o_orderkey": "last_game"})
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(clutch, "c_custkey", "left").join(last, "c_custkey", "left").select(F.col("n_name").alias("team_name"), "c_custkey", "c_name", _r("clutch_score_pct", "clutch_score_pct"), "last_game")


@_register
def natural_merge(spark: SparkSession, d: str) -> DataFrame:
    c = _clutch(spark, d).select("player_id", F.round("clutch_usage_rate", 6).alias("clutch_usage_rate"))
    base = _roster(spark, d).join(c, "player_id", "left")
    a = base.select("player_id", "name", "gp", "clutch_usage_rate", F.round("ts", 6).alias("ts"))
    b = base.where("gp > 5").select("player_id", "name", "gp", "clutch_usage_rate", F.round("usg", 6).alias("usg"))
    return rel.natural_merge(a, b)


@_register
def self_pair(spark: SparkSession, d: str) -> DataFrame:
    p = rel.self_pairs(games.team_games(spark, d), "game_id", "team_id", ["dreb", "oreb"])
    return p.select("game_id", F.col("a_team_id").alias("t1_team"), F.col("b_team_id").alias("t2_team"), _r("a_dreb", "t1_dreb"), _r("b_dreb", "t2_dreb"), _r(F.col("a_oreb") - F.col("b_oreb"), "oreb_diff"))


@_register
def distinct_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").where(F.col("o_orderdate").cast("date") <= F.lit(_AS_OF).cast("date"))
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    n = rel.shares(li)
    o, li = o.repartition(n, "o_orderkey"), li.repartition(n, "l_orderkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_orderdate").cast("date").alias("game_date"), "o_orderstatus", "l_suppkey").distinct()


@_register
def n_plus_one_lookup(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    g = games.team_games(spark, d).join(own, F.col("team_id") == F.col("s_suppkey"))
    return g.groupBy("s_nationkey", "game_id").agg(_r(F.avg("oreb"), "oreb", 9))


@_register
def first_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name")
    s = table(spark, d, "part").select("p_name", F.col("p_partkey").alias("first_part"), F.col("p_brand").alias("first_brand"))
    return rel.first_match(p, s, "p_name", [F.asc("first_part")], ["first_part", "first_brand"])


@_register
def missing_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return rel.missing_keys(table(spark, d, "customer"), e, "c_custkey")


@_register
def count_lookups(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("player_gp"))
    t = table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    team = t.groupBy("c_nationkey").agg(F.max("player_gp").alias("team_gp"))
    return t.join(team, "c_nationkey").select("c_custkey", F.coalesce("player_gp", F.lit(0)).alias("player_gp"), "team_gp", _r(m.games_factor(F.coalesce("player_gp", F.lit(0)), F.col("team_gp").cast("double")), "factor"))


@_register
def cte_chain(spark: SparkSession, d: str) -> DataFrame:
    a = _roster(spark, d).select("player_id", "team_id", "ts")
    b = _clutch(spark, d).select("player_id", "clutch_net_rating")
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    return a.join(b, "player_id", "left").join(n, F.col("team_id") == F.col("n_nationkey")).select("player_id", F.col("n_name").alias("team_name"), _r("ts", "ts"), _r("clutch_net_rating", "clutch_net_rating"))


# ------------------------------------------------------------------ aggregates, sets


@_register
def avg_count_group(spark: SparkSession, d: str) -> DataFrame:
    g = rel.latest_n(games.player_games(spark, d), ["player_id"], [F.desc("game_date"), F.desc("game_id")], 10)
    return g.groupBy("player_id").agg(*[_r(F.avg(c), f"avg_{c}") for c in ("pts", "pm", "min", "fga", "fta", "tov", "oreb")], F.count("*").alias("games_played"))


@_register
def minmax_date(spark: SparkSession, d: str) -> DataFrame:
    day = dates.parse_date(dates.upper_date(F.col("o_orderdate")), ("MMM d, y",))
    return table(spark, d, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.min(day).alias("first_game"), F.max(day).alias("last_game"))


@_register
def nullif_avg(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.when(F.col("value") < 20, "").otherwise(F.col("value").cast("string")).alias("v"))
    return e.groupBy("event_type").agg(_r(F.avg(F.nullif("v", F.lit("")).cast("double")), "avg_value"), F.count("*").alias("n"))


@_register
def cond_ratio(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(_r(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), "win_rate"))


@_register
def last_row_per_key(spark: SparkSession, d: str) -> DataFrame:
    return rel.last_row(table(spark, d, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_orderstatus", "o_totalprice"])


@_register
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus").distinct()


@_register
def weighted_diffs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.head_to_head(games.team_games(spark, d), ["oreb"], n=3)).select("a_team_id", "b_team_id", "oreb_weighted", "oreb_plain")


@_register
def fixed_divisor_blend(spark: SparkSession, d: str) -> DataFrame:
    g = rel.latest_n(games.player_games(spark, d), ["player_id"], [F.desc("game_date"), F.desc("game_id")], 10)
    five = F.sum(F.when(F.col("rn") <= 5, F.col("fga"))) / 5
    return g.groupBy("player_id").agg(_r(0.6 * F.sum("fga") / 10 + 0.4 * five, "blend"))


@_register
def mean_skips_nan(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("value") < 10, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(_r(F.avg(F.nanvl(v, F.lit(None).cast("double"))), "mean_value"))


@_register
def union_all_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@_register
def season_fallback(spark: SparkSession, d: str) -> DataFrame:
    g = games.player_games(spark, d).select("player_id", "game_id", "game_date", "season")
    now, before = g.where("season = '1997-98'").drop("season"), g.where("season = '1996-97'").drop("season")
    return rel.topped_up(now, before, ["player_id"], [F.desc("game_date"), F.desc("game_id")], 3).select("player_id", "game_id", F.col("rn").cast("long").alias("rn"), F.col("source_rank").cast("long").alias("source_rank"))


# ------------------------------------------------------------------ scalars


@_register
def matchup_parse(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    sep = F.when(F.col("o_orderkey") % 2 == 0, " vs. ").otherwise(" @ ")
    match = F.concat("o_orderstatus", sep, F.split_part("o_orderpriority", F.lit("-"), F.lit(1)))
    return o.select("o_orderkey", match.alias("matchup")).select("o_orderkey", text.matchup_team(F.col("matchup")).alias("team"), text.matchup_team(F.col("matchup"), own=False).alias("home_team"), text.is_home(F.col("matchup")).alias("at_home"))


@_register
def season_of_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.season_of(F.col("o_orderdate")).alias("season"))


@_register
def multi_format_date(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 7
    shown = F.lit("not a date")
    for i, f in enumerate(("yyyy-M-d", "MM/dd/yyyy", "", "MM-dd-yyyy", "dd-MM-yyyy", "dd/MM/yyyy")):  # a day up to 12 also fits an earlier format
        shown = F.when(k == i, F.date_format(day, f) if f else dates.upper_date(day)).otherwise(shown)
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", dates.parse_date(shown).alias("game_date"), shown.alias("shown"))


@_register
def bucket_5day(spark: SparkSession, d: str) -> DataFrame:
    b = dates.bucket(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    e = table(spark, d, "events", "ts", "user_id", "value").select(b.alias("bucket"), "user_id", "value")
    per = e.groupBy("bucket", "user_id").agg(F.avg("value").alias("v"))
    return per.groupBy("user_id").agg(F.count("*").alias("buckets"), _r(F.avg("v"), "mean_of_means"))


@_register
def games_factor_pow(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("gp")).select("o_custkey", _r(m.games_factor(F.col("gp")), "factor"))


@_register
def category_case(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_size")
    return p.select("p_partkey", m.category(F.col("p_size")).alias("category"), m.category(F.col("p_size"), 30).alias("category_30"))


@_register
def table_name_text(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    return n.select("n_nationkey", F.format_string("%s_misc_stats", F.lower(F.replace("n_name", F.lit("_"), F.lit(" ")))).alias("table_name"), F.right("n_name", F.lit(2)).alias("suffix"), F.trim(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("plain"))


# ------------------------------------------------------------------ scores


@_register
def recent_form(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.recent_form(games.player_games(spark, d)))


@_register
def recent_form_compat(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.recent_form(games.player_games(spark, d), compat=True))


@_register
def clutch_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_clutch(spark, d))


@_register
def contribution_score(spark: SparkSession, d: str) -> DataFrame:
    recent = scores.recent_form(games.player_games(spark, d))
    return _rounded(scores.contributions(_roster(spark, d), _clutch(spark, d), recent))


@_register
def contribution_at_date(spark: SparkSession, d: str) -> DataFrame:
    """Contributions as of a date: games of its season up to it, weighted by the player's share of the team's games."""
    day, season = F.lit(_AS_OF).cast("date"), "1997-98"
    g = games.player_games(spark, d).where(F.col("season") == season)
    players = _roster(spark, d, g.where(F.col("game_date") <= day))
    whole = g.groupBy("player_id").agg(F.count("*").alias("gp"))
    team = g.join(table(spark, d, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_nationkey").alias("team_id")), "player_id").groupBy("team_id").agg(F.countDistinct("game_id").alias("team_gp"))
    players = players.drop("gp").join(whole, "player_id").join(team, "team_id")
    recent = scores.recent_form(g.where(F.col("game_date") <= day))
    return _rounded(scores.contributions(players, _clutch(spark, d), recent, team_games="team_gp", others="Other"))


@_register
def availability(spark: SparkSession, d: str) -> DataFrame:
    """Availability and steadiness of minutes, over a season of at most 82 games and a player's last ten."""
    g = games.player_games(spark, d).select("player_id", "game_id", "game_date", "min")
    ranked = rel.numbered(g, ["player_id"], [F.desc("game_date"), F.desc("game_id")])
    ten = F.when(F.col("rn") <= 10, F.col("min"))
    a = ranked.groupBy("player_id").agg(F.count("*").alias("gp"), F.avg("min").alias("season"), F.count(ten).alias("last"), F.avg(ten).alias("recent"), F.stddev_samp(ten).alias("deviation"))
    return a.select("player_id", _r(m.availability(F.col("gp"), 82.0, F.col("last")), "availability"), _r(m.minutes_consistency(F.col("season"), F.col("recent"), F.col("deviation")), "consistency"))


@_register
def estimated_ratings(spark: SparkSession, d: str) -> DataFrame:
    p = _roster(spark, d)
    out = model.estimated_ratings(p, (["usg", "ts", "pie"], "off"), (["pie", "tov", "usg"], "def"), "min", least=20.0)
    return out.select("player_id", *[m.settled(F.col(c)).alias(c) for c in ("e_off", "e_def", "e_net")])


@_register
def head_to_head_topped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.head_to_head(games.team_games(spark, d), _TEAM_METRICS, F.lit(_AS_OF).cast("date"), seasons=("1997-98", "1996-97")))


@_register
def team_form(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.team_form(games.team_games(spark, d), F.lit(_AS_OF).cast("date")))


@_register
def season_four_factors(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.season_four(games.team_games(spark, d)))


@_register
def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.head_to_head(games.team_games(spark, d), _TEAM_METRICS, F.lit(_AS_OF).cast("date")))


@_register
def strength_of_schedule(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.strength_of_schedule(games.team_games(spark, d), F.lit(_AS_OF).cast("date")))


@_register
def sliding_form(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scores.sliding_form(games.player_games(spark, d), "fga").drop("game_date"))


@_register
def ridge_blend(spark: SparkSession, d: str) -> DataFrame:
    p = _roster(spark, d)
    return _rounded(model.ridge_blend(p, ["usg", "ts", "pie"], "net", "min", "e_net", least=20.0).select("player_id", "e_net"))


# ------------------------------------------------------------------ table changes and checks


def _stage(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    added = c.where("c_custkey % 100 = 1").select((F.col("c_custkey") + 10000000).alias("c_custkey"), "c_name", "c_acctbal")
    return c, changed.unionByName(added)


@_register
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mutate.upsert(*_stage(spark, d), ["c_custkey"]))


@_register
def upsert_some_columns(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mutate.upsert(*_stage(spark, d), ["c_custkey"], update=["c_acctbal"]))


def _reloaded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    day = F.when(F.col("o_orderkey") % 20 != 7, F.col("o_orderdate").cast("date"))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").withColumn("o_orderdate", day)
    return o, o.where("o_custkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)


@_register
def scoped_replace_date(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mutate.replace_since(*_reloaded(spark, d), "o_orderdate", F.lit(_AS_OF).cast("date")))


@_register
def scoped_replace_key_date(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(mutate.replace_since_by_key(*_reloaded(spark, d), ["o_custkey"], "o_orderdate", F.lit(_AS_OF).cast("date")))


@_register
def lookup_backfill(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("n_nationkey"), F.lit(None).cast("string").alias("n_name"))
    known = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    filled = mutate.backfill(c, known, ["c_custkey"], ["n_nationkey"])
    return mutate.backfill(filled, table(spark, d, "nation"), ["n_nationkey"], ["n_name"])


@_register
def fix_list(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    broken = c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 50 == 3, F.lit(0)).otherwise(F.col("c_nationkey")))
    fixes = c.where("c_custkey % 50 = 3").select("c_custkey")
    return mutate.fix_list(broken, fixes, c.where("c_custkey % 100 = 3"), "c_custkey", "c_nationkey")


@_register
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    return mutate.orphans(o, "o_custkey", table(spark, d, "customer").where("c_custkey % 7 > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@_register
def pk_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return mutate.duplicates(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


# ------------------------------------------------------------------ pages, names


@_register
def page_comments(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages", "page_id", "html")
    return p.select("page_id", html.title(F.col("html")).alias("title"), F.size(html.links(F.col("html"))).alias("n_links"), F.array_join(F.transform(html.comments(F.col("html")), lambda c: F.trim(c)), "|").alias("comments"), F.size(html.table_ids(F.col("html"))).alias("n_tables"))


@_register
def uncommented(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages", "page_id", "html")
    return p.select("page_id", F.length(html.uncomment(F.col("html"))).cast("long").alias("n_chars"))


@_register
def name_normalise(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages", "page_id", "html")
    return p.select("page_id", text.plain_name(html.title(F.col("html"))).alias("plain"))


@_register
def props_json(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("attribute", "value"))


def queries() -> dict[str, Query]:
    from statloom.plans import history  # its queries use some of these

    return _QUERIES | landing.QUERIES | history.QUERIES
