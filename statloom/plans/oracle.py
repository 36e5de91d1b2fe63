"""DuckDB statements with the results of the queries, written on their own from the definitions."""

from __future__ import annotations

from statloom.plans import landing

_SEASON = "(CASE WHEN month({d}) >= 10 THEN year({d}) ELSE year({d}) - 1 END)"


def _season(d: str) -> str:
    s = _SEASON.format(d=d)
    return f"printf('%d-%02d', {s}, ({s} + 1) % 100)"


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_PTS = f"(CAST(SUM({_CENTS} * CAST(round((1 - l_discount) * 100) AS BIGINT)) AS DOUBLE) / 1e7::DOUBLE)"
_PM = f"({_PTS} - 0.95::DOUBLE * (CAST(SUM({_CENTS}) AS DOUBLE) / 1e5::DOUBLE))"


def _n(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS DOUBLE)"


_BOX = f"{_PTS} AS pts, {_PM} AS pm, SUM(l_quantity) AS min, CAST(COUNT(*) AS DOUBLE) AS fga, {_n("l_linestatus = 'F'")} AS fta, {_n("l_returnflag = 'R'")} AS tov, {_n("l_returnflag = 'A'")} AS oreb"

_PG = f"""pg AS (
  SELECT o_custkey AS player_id, o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, {_season('o_orderdate')} AS season, o_orderstatus AS wl, pts, pm, min, fga, fta, tov, oreb
  FROM orders JOIN (SELECT l_orderkey, {_BOX} FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
_TG = f"""tg AS (
  SELECT l_suppkey AS team_id, o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, {_season('o_orderdate')} AS season, o_orderstatus AS wl,
         pm / fga AS net, pts / (2 * (fga + 0.44::DOUBLE * fta)) AS efg, 100 * (tov / fga) AS tov, oreb / fga AS oreb, dreb / fga AS dreb, fta / fga AS ft
  FROM orders JOIN (SELECT l_orderkey, l_suppkey, {_BOX}, {_n("l_returnflag = 'N'")} AS dreb FROM lineitem GROUP BY 1, 2) ON o_orderkey = l_orderkey)"""
_LAST = "ranked AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS rn FROM pg)"
_CL = f"""cl AS (
  SELECT user_id AS player_id, COUNT(DISTINCT CAST(ts AS DATE)) AS gp, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS min,
         {_n("event_type = 'purchase'")} AS fgm, {_n("event_type IN ('purchase', 'click')")} AS fga, {_n("event_type = 'signup'")} AS fta, {_n("event_type = 'error'")} AS tov,
         CAST(SUM(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 10000 AS pm
  FROM events GROUP BY 1),
cm AS (
  SELECT player_id, gp, coalesce(fgm / nullif(fga, 0), 0) AS csp, (fga + 0.44::DOUBLE * fta + tov) / nullif(min, 0) AS cur, pm / nullif(CAST(gp AS DOUBLE), 0) AS cnr FROM cl)"""


def _poss(s: str = "") -> str:
    p = f"(0.96::DOUBLE * fga{s} + 0.44::DOUBLE * fta{s} - oreb{s} + tov{s})"
    return f"(CASE WHEN {p} > 0 THEN {p} END)"


def _ts(s: str = "") -> str:
    return f"pts{s} / nullif(2 * (fga{s} + 0.44::DOUBLE * fta{s}), 0)"


def _usg(s: str = "") -> str:
    return f"(fga{s} + 0.44::DOUBLE * fta{s} + tov{s}) / nullif(min{s}, 0)"


def _tovr(s: str = "") -> str:
    return f"tov{s} / nullif(fga{s} + 0.44::DOUBLE * fta{s} + tov{s}, 0)"


def _form(s: str, net: str) -> str:
    return f"(0.4::DOUBLE * ({net}) + 0.2::DOUBLE * ({_ts(s)}) + 0.15::DOUBLE * ({_usg(s)}) + 0.1::DOUBLE * ({_tovr(s)}) + 0.15::DOUBLE * (min{s} / n{s}))"


_COLS = ("pts", "pm", "min", "fga", "fta", "tov", "oreb")


def _recent(compat: bool) -> str:
    avgs = ", ".join(f"avg({c}) AS {c}10, avg({c}) FILTER (WHERE rn <= 5) AS {c}5" for c in _COLS)
    ten, five = f"pm10 / {_poss('10')}", f"pm5 / {_poss('5')}"
    return f"""{_PG}, {_LAST},
av AS (SELECT player_id, CAST(COUNT(*) AS DOUBLE) AS n10, CAST(COUNT(*) FILTER (WHERE rn <= 5) AS DOUBLE) AS n5, {avgs} FROM ranked WHERE rn <= 10 GROUP BY 1),
rf AS (SELECT player_id, CAST(n10 AS BIGINT) AS n_games, {_form('10', ten)} AS form_10, {_form('5', ten if compat else five)} AS form_5 FROM av),
recent AS (SELECT *, 0.6::DOUBLE * form_10 + 0.4::DOUBLE * form_5 AS recent FROM rf)"""


_ROSTER = f"""avgs AS (SELECT player_id, COUNT(*) AS gp, {', '.join(f'avg({c}) AS {c}' for c in _COLS)} FROM pg GROUP BY 1),
roster AS (
  SELECT player_id, c_name AS name, c_nationkey AS team_id, gp, min / 4 AS min, fta / nullif(fga, 0) AS pie, {_usg()} AS usg, pm / {_poss()} AS net, pts / {_poss()} AS off, (pts - pm) / {_poss()} AS def, {_ts()} AS ts, {_tovr()} AS tov
  FROM avgs JOIN customer ON c_custkey = player_id)"""


def _factor(gp: str, whole: str = "54.0::DOUBLE") -> str:
    return f"pow(CAST({gp} AS DOUBLE) / nullif({whole}, 0), 0.75::DOUBLE)"


def _four(tov: str = "tov") -> str:
    return f"(0.6::DOUBLE * efg - 0.25::DOUBLE * {tov} + 0.1::DOUBLE * oreb + 0.1::DOUBLE * dreb + 0.15::DOUBLE * ft)"


_AS_OF = "DATE '1998-06-01'"
_TEAM = ("net", "efg", "tov", "oreb", "dreb", "ft")


def _meetings(metrics: list[str], where: str) -> str:
    cols = ", ".join(f"round(sum((4 - rn) * (a_{c} - b_{c})) / 6, 6) AS {c}_weighted, round(sum(a_{c} - b_{c}) / 3, 6) AS {c}_plain" for c in metrics)
    pick = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in metrics)
    return f"""WITH {_TG},
pairs AS (
  SELECT a.team_id AS a_team_id, b.team_id AS b_team_id, {pick}, row_number() OVER (PARTITION BY a.team_id, b.team_id ORDER BY a.game_date DESC, a.game_id DESC) AS rn
  FROM tg a JOIN tg b ON a.game_id = b.game_id AND a.team_id <> b.team_id {where})
SELECT a_team_id, b_team_id, count(*) AS meetings, {cols} FROM pairs WHERE rn <= 3 GROUP BY 1, 2"""


_UPPER_DATE = "upper(strftime(o_orderdate, '%b %d, %Y'))"
_STAGE = """stage AS (
  SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 100 = 1)"""
_RELOADED = """o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 20 <> 7 THEN CAST(o_orderdate AS DATE) END AS o_orderdate, o_totalprice FROM orders),
n AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice + 1 AS o_totalprice FROM o WHERE o_custkey % 3 = 0)"""
_MATCHUP = "(SELECT o_orderkey, o_orderstatus AS a, split_part(o_orderpriority, '-', 1) AS b, o_orderkey % 2 = 0 AS home FROM orders)"

_SQL: dict[str, str] = {
    "scan_project": "SELECT c_custkey, c_name AS name, c_acctbal * 2 AS twice, 'player' AS kind, CAST(NULL AS VARCHAR) AS note FROM customer",
    "param_filter": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000",
    "open_band": "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 15 AND l_quantity < 25",
    "date_cutoffs": f"SELECT count(*) FILTER (WHERE d <= {_AS_OF}) AS le, count(*) FILTER (WHERE d < {_AS_OF}) AS lt, count(*) FILTER (WHERE d > {_AS_OF}) AS gt, count(*) FILTER (WHERE d >= {_AS_OF} - 20) AS lookback, count(*) FILTER (WHERE d <> {_AS_OF}) AS ne FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)",
    "null_rows_removed": f"WITH {_CL} SELECT c_custkey, c_nationkey, round(min, 6) AS min FROM customer JOIN cl ON player_id = c_custkey WHERE min >= 10",
    "substring_filter": "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'ring') AND regexp_matches(p_name, '[\\p{L}\\p{N}]')",
    "lookup_search": "SELECT n_nationkey, n_name FROM nation WHERE regexp_matches(lower(n_name), '_1[0-9]$')",
    "semi_ids": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events)",
    "existence": f"SELECT count(*) > 0 AS played, count(*) AS n FROM orders WHERE o_custkey = 7 AND CAST(o_orderdate AS DATE) <= {_AS_OF}",
    "latest_n": "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS game_date, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5",
    "as_of_latest": f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE CAST(o_orderdate AS DATE) <= {_AS_OF}) WHERE rn = 1",
    "nested_windows": f"WITH {_PG}, {_LAST} SELECT player_id, round(avg(min) FILTER (WHERE rn <= 5), 6) AS min_5, round(avg(min) FILTER (WHERE rn <= 10), 6) AS min_10, round(avg(min) FILTER (WHERE rn <= 15), 6) AS min_15 FROM ranked GROUP BY 1",
    "positional_weights": f"WITH {_PG}, {_LAST} SELECT player_id, round(sum((4 - rn) * fga) / 6, 6) AS weighted_fga FROM ranked WHERE rn <= 3 GROUP BY 1",
    "rank_cols": "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS price_rank FROM part",
    "multi_sort_topk": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_custkey, o_orderkey DESC LIMIT 25",
    "sort_by_text_date": f"SELECT o_orderkey, {_UPPER_DATE} AS game_date FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20",
    "roster_inner_left_left": f"WITH {_CL}, lastg AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_game FROM orders GROUP BY 1) SELECT n_name AS team_name, c_custkey, c_name, round(csp, 6) AS clutch_score_pct, last_game FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cm ON cm.player_id = c_custkey LEFT JOIN lastg ON o_custkey = c_custkey",
    "natural_merge": f"WITH {_PG}, {_ROSTER}, {_CL} SELECT r.player_id, name, r.gp, round(cur, 6) AS clutch_usage_rate, round(ts, 6) AS ts, round(usg, 6) AS usg FROM roster r LEFT JOIN cm ON cm.player_id = r.player_id WHERE r.gp > 5",
    "self_pair": f"WITH {_TG} SELECT a.game_id, a.team_id AS t1_team, b.team_id AS t2_team, round(a.dreb, 6) AS t1_dreb, round(b.dreb, 6) AS t2_dreb, round(a.oreb - b.oreb, 6) AS oreb_diff FROM tg a JOIN tg b ON a.game_id = b.game_id AND a.team_id <> b.team_id",
    "distinct_join": f"SELECT DISTINCT o_orderkey, CAST(o_orderdate AS DATE) AS game_date, o_orderstatus, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) <= {_AS_OF}",
    "n_plus_one_lookup": f"WITH {_TG} SELECT s_nationkey, game_id, round(avg(oreb), 9) AS oreb FROM tg JOIN supplier ON team_id = s_suppkey GROUP BY 1, 2",
    "first_match": "SELECT p.p_partkey, p.p_name, f.p_partkey AS first_part, f.p_brand AS first_brand FROM part p LEFT JOIN (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1) f ON f.p_name = p.p_name",
    "missing_keys": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
    "count_lookups": f"WITH t AS (SELECT c_custkey, c_nationkey, gp FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS gp FROM orders GROUP BY 1) ON o_custkey = c_custkey), m AS (SELECT c_nationkey, max(gp) AS team_gp FROM t GROUP BY 1) SELECT c_custkey, coalesce(gp, 0) AS player_gp, team_gp, round({_factor('coalesce(gp, 0)', 'CAST(team_gp AS DOUBLE)')}, 6) AS factor FROM t JOIN m USING (c_nationkey)",
    "cte_chain": f"WITH {_PG}, {_ROSTER}, {_CL} SELECT r.player_id, n_name AS team_name, round(ts, 6) AS ts, round(cnr, 6) AS clutch_net_rating FROM roster r LEFT JOIN cm ON cm.player_id = r.player_id JOIN nation ON n_nationkey = team_id",
    "avg_count_group": f"WITH {_PG}, {_LAST} SELECT player_id, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in _COLS)}, count(*) AS games_played FROM ranked WHERE rn <= 10 GROUP BY 1",
    "minmax_date": "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_game, CAST(max(o_orderdate) AS DATE) AS last_game FROM orders GROUP BY 1",
    "nullif_avg": "SELECT event_type, round(avg(CASE WHEN value >= 20 THEN value END), 6) AS avg_value, count(*) AS n FROM events GROUP BY 1",
    "cond_ratio": "SELECT o_custkey, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate FROM orders GROUP BY 1",
    "last_row_per_key": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "distinct_values": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "weighted_diffs": f"SELECT a_team_id, b_team_id, oreb_weighted, oreb_plain FROM ({_meetings(['oreb'], '')})",
    "fixed_divisor_blend": f"WITH {_PG}, {_LAST} SELECT player_id, round(0.6::DOUBLE * sum(fga) / 10 + 0.4::DOUBLE * sum(fga) FILTER (WHERE rn <= 5) / 5, 6) AS blend FROM ranked WHERE rn <= 10 GROUP BY 1",
    "mean_skips_nan": "SELECT user_id, round(avg(CASE WHEN value >= 10 THEN value END), 6) AS mean_value FROM events GROUP BY 1",
    "union_all_by_name": "SELECT c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS kind FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier",
    "season_fallback": f"WITH {_PG}, b AS (SELECT *, CAST(CASE WHEN season = '1997-98' THEN 0 ELSE 1 END AS BIGINT) AS source_rank FROM pg WHERE season IN ('1997-98', '1996-97')) SELECT player_id, game_id, rn, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY source_rank, game_date DESC, game_id DESC) AS rn FROM b) WHERE rn <= 3",
    "matchup_parse": f"SELECT o_orderkey, a AS team, CASE WHEN home THEN a ELSE b END AS home_team, home AS at_home FROM {_MATCHUP}",
    "season_of_date": f"SELECT o_orderkey, {_season('o_orderdate')} AS season FROM orders",
    "multi_format_date": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 4 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 7 < 6 THEN CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END END AS game_date,
  CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN {_UPPER_DATE} WHEN 3 THEN strftime(o_orderdate, '%m-%d-%Y') WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 5 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'not a date' END AS shown FROM orders""",
    "bucket_5day": "WITH p AS (SELECT CAST(floor((CAST(ts AS DATE) - DATE '2024-01-01') / 5) AS INTEGER) AS bucket, user_id, avg(value) AS v FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS buckets, round(avg(v), 6) AS mean_of_means FROM p GROUP BY 1",
    "games_factor_pow": f"SELECT o_custkey, round({_factor('count(*)')}, 6) AS factor FROM orders GROUP BY 1",
    "category_case": "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'Star' WHEN p_size > 15 AND p_size < 25 THEN 'Rotation' END AS category, CASE WHEN p_size > 30 THEN 'Star' WHEN p_size > 15 AND p_size < 30 THEN 'Rotation' END AS category_30 FROM part",
    "table_name_text": "SELECT n_nationkey, lower(replace(n_name, '_', ' ')) || '_misc_stats' AS table_name, right(n_name, 2) AS suffix, n_name AS plain FROM nation",
    "recent_form": f"WITH {_recent(False)} SELECT player_id, n_games, round(form_10, 6) AS form_10, round(form_5, 6) AS form_5, round(recent, 6) AS recent FROM recent",
    "recent_form_compat": f"WITH {_recent(True)} SELECT player_id, n_games, round(form_10, 6) AS form_10, round(form_5, 6) AS form_5, round(recent, 6) AS recent FROM recent",
    "clutch_metrics": f"WITH {_CL} SELECT player_id, gp, round(csp, 6) AS clutch_score_pct, round(cur, 6) AS clutch_usage_rate, round(cnr, 6) AS clutch_net_rating FROM cm",
    "contribution_score": f"""WITH {_recent(False)}, {_ROSTER}, {_CL},
parts AS (
  SELECT r.player_id, name, 0.175::DOUBLE * pie + 0.125::DOUBLE * usg + 0.1::DOUBLE * net * {_factor('r.gp')} AS p1, 0.125::DOUBLE * ts + 0.05::DOUBLE * tov + 0.15::DOUBLE * min AS p2,
         coalesce((0.5::DOUBLE * csp + 0.25::DOUBLE * cur + 0.25::DOUBLE * cnr) * {_factor('r.gp')}, 0) AS p3, recent, CASE WHEN min > 25 THEN 'Star' WHEN min > 15 AND min < 25 THEN 'Rotation' END AS category
  FROM roster r LEFT JOIN cm ON cm.player_id = r.player_id LEFT JOIN recent ON recent.player_id = r.player_id)
SELECT player_id, name, round(p1, 6) AS "primary", round(p2, 6) AS secondary, round(p3, 6) AS clutch, round(recent, 6) AS recent, category, round(0.5::DOUBLE * (p1 + p2) + 0.3::DOUBLE * p3 + 0.2::DOUBLE * recent, 6) AS score FROM parts WHERE category IS NOT NULL""",
    "team_form": f"""WITH {_TG}, r AS (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY game_date DESC, game_id DESC) AS rn FROM tg WHERE game_date <= {_AS_OF}),
a AS (SELECT team_id, count(*) AS n_games, {', '.join(f'0.6::DOUBLE * sum({c}) / 10 + 0.4::DOUBLE * coalesce(sum({c}) FILTER (WHERE rn <= 5), 0) / 5 AS {c}' for c in _TEAM)} FROM r WHERE rn <= 10 GROUP BY 1),
f AS (SELECT team_id, n_games, net, {_four('(tov / 100)')} AS four FROM a)
SELECT team_id, n_games, round(net, 6) AS net, round(four, 6) AS four, round(0.75::DOUBLE * net + 0.25::DOUBLE * four, 6) AS score FROM f""",
    "season_four_factors": f"WITH {_TG}, a AS (SELECT team_id, season, {', '.join(f'avg({c}) AS {c}' for c in _TEAM)} FROM tg GROUP BY 1, 2) SELECT team_id, season, round(net, 6) AS net, round({_four()}, 6) AS four FROM a",
    "head_to_head": _meetings(["net", "efg", "oreb"], f"WHERE a.game_date < {_AS_OF}"),
    "strength_of_schedule": f"""WITH {_TG}, g AS (SELECT * FROM tg WHERE game_date < {_AS_OF}), own AS (SELECT team_id, avg(CASE WHEN wl = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS win_rate, avg(net) AS net_rating FROM g GROUP BY 1)
SELECT a.team_id, count(*) AS meetings, round(avg(win_rate), 6) AS opponent_win_rate, round(avg(net_rating), 6) AS opponent_net FROM g a JOIN g b ON a.game_id = b.game_id AND a.team_id <> b.team_id JOIN own ON own.team_id = b.team_id GROUP BY 1""",
    "sliding_form": f"WITH {_PG} SELECT player_id, game_id, round(avg(fga) OVER w, 6) AS mean, round(stddev_samp(fga) OVER w, 6) AS deviation FROM pg WINDOW w AS (PARTITION BY player_id ORDER BY game_date, game_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "upsert_merge": f"WITH {_STAGE} SELECT c_custkey, c_name, round(c_acctbal, 6) AS c_acctbal FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM stage) UNION ALL SELECT * FROM stage)",
    "upsert_some_columns": f"WITH {_STAGE} SELECT c_custkey, c.c_name, round(coalesce(s.c_acctbal, c.c_acctbal), 6) AS c_acctbal FROM customer c LEFT JOIN stage s USING (c_custkey) UNION ALL SELECT c_custkey, c_name, round(c_acctbal, 6) FROM stage WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)",
    "scoped_replace_date": f"WITH {_RELOADED} SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice, 6) AS o_totalprice FROM (SELECT * FROM o WHERE o_orderdate < {_AS_OF} OR o_orderdate IS NULL UNION ALL SELECT * FROM n)",
    "scoped_replace_key_date": f"WITH {_RELOADED} SELECT o_orderkey, o_custkey, o_orderdate, round(CASE WHEN o_custkey % 3 = 0 AND o_orderdate >= {_AS_OF} THEN o_totalprice + 1 ELSE o_totalprice END, 6) AS o_totalprice FROM o",
    "lookup_backfill": "SELECT c_custkey, c_nationkey AS n_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "fix_list": "SELECT c_custkey, CASE WHEN c_custkey % 50 = 3 AND c_custkey % 100 <> 3 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer",
    "fk_orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 > 0)",
    "pk_duplicates": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "page_comments": """SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, CAST(len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS INTEGER) AS n_links,
  array_to_string(list_transform(regexp_extract_all(html, '<!--(.*?)-->', 1, 's'), lambda x: trim(x)), '|') AS comments, CAST(len(regexp_extract_all(html, '<table\\b[^>]*\\bid="([^"]*)"', 1)) AS INTEGER) AS n_tables FROM pages""",
    "uncommented": "SELECT page_id, length(replace(replace(html, '<!--', ''), '-->', '')) AS n_chars FROM pages",
    "props_json": "SELECT event_id, k AS attribute, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)",
}

_SQL["name_normalise"] = "SELECT page_id, trim(lower(regexp_replace(strip_accents(regexp_extract(html, '<title>(.*?)</title>', 1, 's')), '[^\\x00-\\x7F]', '', 'g'))) AS plain FROM pages"


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _ridge(x: tuple[str, str, str] = ("usg", "ts", "pie"), label: str = "net", out: str = "e_net", digits: int = 6) -> str:
    """Three features, so the normal equations are solved by Cramer's rule."""
    gram = [[f"s_{a}_{b}" if a < b else f"s_{b}_{a}" if a > b else f"(s_{a}_{a} + 0.5::DOUBLE)" for b in x] for a in x]
    sums = [f"sum((p.{a} - m.{a}) * (p.{b} - m.{b})) AS s_{a}_{b}" for a in x for b in x if a <= b] + [f"sum((p.{a} - m.{a}) * (p.{label} - m.{label})) AS y_{a}" for a in x]
    betas = ", ".join(f"{_det([[f'y_{a}' if j == k else gram[i][j] for j in range(3)] for i, a in enumerate(x)])} / {_det(gram)} AS b_{c}" for k, c in enumerate(x))
    line = " + ".join(f"coalesce({a}, 0) * b_{a}" for a in x)
    mean = " - ".join(f"b_{a} * m_{a}" for a in x)
    return f"""WITH {_PG}, {_ROSTER},
p AS (SELECT * FROM roster WHERE min >= 20 AND {' AND '.join(f'{a} IS NOT NULL' for a in (*x, label))}),
m AS (SELECT {', '.join(f'avg({a}) AS {a}' for a in (*x, label))} FROM p),
s AS (SELECT {', '.join(sums)}, {', '.join(f'any_value(m.{a}) AS m_{a}' for a in (*x, label))} FROM p, m),
b AS (SELECT *, {betas} FROM s)
SELECT player_id, round(least(coalesce(min, 0) / 20.0::DOUBLE, 1.0::DOUBLE) * coalesce({label}, 0) + (1 - least(coalesce(min, 0) / 20.0::DOUBLE, 1.0::DOUBLE)) * (m_{label} - {mean} + {line}), {digits}) AS {out} FROM roster, b"""


_SQL["ridge_blend"] = _ridge()
_OFF, _DEF = _ridge(label="off", out="e_off", digits=12), _ridge(("pie", "tov", "usg"), "def", "e_def", 12)
_SETTLED = ", ".join(f"floor(({x}) * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE AS {n}" for n, x in (("e_off", "e_off"), ("e_def", "e_def"), ("e_net", "e_off - e_def")))
_SQL["estimated_ratings"] = f"SELECT player_id, {_SETTLED} FROM ({_OFF}) JOIN ({_DEF}) USING (player_id)"
_SQL["availability"] = f"""WITH {_PG}, {_LAST}, a AS (SELECT player_id, count(*) AS gp, avg(min) AS season, count(*) FILTER (WHERE rn <= 10) AS last, avg(min) FILTER (WHERE rn <= 10) AS recent, stddev_samp(min) FILTER (WHERE rn <= 10) AS dev FROM ranked GROUP BY 1)
SELECT player_id, round(0.6::DOUBLE * {_factor('gp', '82.0::DOUBLE')} + 0.4::DOUBLE * last / 10, 6) AS availability, round(0.6::DOUBLE * season + 0.4::DOUBLE * (1 - dev / nullif(recent, 0)), 6) AS consistency FROM a"""
_SQL["head_to_head_topped"] = _meetings(["net", "efg", "oreb"], f"WHERE a.game_date < {_AS_OF} AND a.season IN ('1997-98', '1996-97')")
_SQL["contribution_at_date"] = f"""WITH {_PG.replace('pg AS', 'every AS')}, season AS (SELECT * FROM every WHERE season = '1997-98'), pg AS (SELECT * FROM season WHERE game_date <= {_AS_OF}), {_recent(False)[len(_PG) + 2:]}, {_ROSTER}, {_CL},
own AS (SELECT player_id, count(*) AS player_gp FROM season GROUP BY 1),
team AS (SELECT c_nationkey AS team_id, count(DISTINCT game_id) AS team_gp FROM season JOIN customer ON c_custkey = player_id GROUP BY 1),
parts AS (
  SELECT r.player_id, name, 0.175::DOUBLE * pie + 0.125::DOUBLE * usg + 0.1::DOUBLE * net * {_factor('player_gp', 'CAST(team_gp AS DOUBLE)')} AS p1, 0.125::DOUBLE * ts + 0.05::DOUBLE * tov + 0.15::DOUBLE * min AS p2,
         coalesce((0.5::DOUBLE * csp + 0.25::DOUBLE * cur + 0.25::DOUBLE * cnr) * {_factor('player_gp', 'CAST(team_gp AS DOUBLE)')}, 0) AS p3, recent, CASE WHEN min > 25 THEN 'Star' WHEN min > 15 AND min < 25 THEN 'Rotation' ELSE 'Other' END AS category
  FROM roster r JOIN own USING (player_id) JOIN team USING (team_id) LEFT JOIN cm ON cm.player_id = r.player_id LEFT JOIN recent ON recent.player_id = r.player_id)
SELECT player_id, name, round(p1, 6) AS "primary", round(p2, 6) AS secondary, round(p3, 6) AS clutch, round(recent, 6) AS recent, category, round(0.5::DOUBLE * (p1 + p2) + 0.3::DOUBLE * p3 + 0.2::DOUBLE * recent, 6) AS score FROM parts"""


def oracle_sql() -> dict[str, str]:
    from statloom.plans import history_sql  # written with the helpers above

    more = {"crawled_pages": _SQL["page_comments"]}
    return _SQL | landing.SQL | history_sql.SQL | more
