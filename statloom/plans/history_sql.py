"""DuckDB statements with the results of the queries over time, written on their own from the definitions."""

from __future__ import annotations

from statloom.plans.oracle import _PG, _TG, _det, _factor


def _sure(x: str, name: str) -> str:
    return f"floor(({x}) * 1e6::DOUBLE + 0.5001::DOUBLE) / 1e6::DOUBLE AS {name}"


def _unit(x: str) -> str:
    return f"CAST(floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def _fit(x: tuple[str, str, str], label: str) -> str:
    """A season's regression by Cramer's rule: (season, intercept, b_*)."""
    gram = [[f"s_{a}_{b}" if a < b else f"s_{b}_{a}" if a > b else f"(s_{a}_{a} + 0.5::DOUBLE)" for b in x] for a in x]
    sums = [f"sum((p.{a} - m.{a}) * (p.{b} - m.{b})) AS s_{a}_{b}" for a in x for b in x if a <= b] + [f"sum((p.{a} - m.{a}) * (p.{label} - m.{label})) AS y_{a}" for a in x]
    betas = ", ".join(f"{_det([[f'y_{a}' if j == k else gram[i][j] for j in range(3)] for i, a in enumerate(x)])} / {_det(gram)} AS b_{c}" for k, c in enumerate(x))
    names, present = (*x, label), " AND ".join(f"{a} IS NOT NULL" for a in (*x, label))
    return f"""(SELECT season, m_{label} - {' - '.join(f'b_{a} * m_{a}' for a in x)} AS b_0, {', '.join(f'b_{a}' for a in x)} FROM (
  SELECT *, {betas} FROM (
    SELECT p.season, {', '.join(sums)}, {', '.join(f'any_value(m.{a}) AS m_{a}' for a in names)}
    FROM (SELECT * FROM roster WHERE min >= 20 AND {present}) p JOIN (SELECT season, {', '.join(f'avg({a}) AS {a}' for a in names)} FROM roster WHERE min >= 20 AND {present} GROUP BY season) m ON p.season = m.season GROUP BY p.season)))"""


_POSS = "CASE WHEN 0.96::DOUBLE * fga + 0.44::DOUBLE * fta - oreb + tov > 0 THEN 0.96::DOUBLE * fga + 0.44::DOUBLE * fta - oreb + tov END"
_ROSTER = f"""a AS (SELECT season, player_id, avg(min) AS am, avg(pts) AS pts, avg(pm) AS pm, avg(fga) AS fga, avg(fta) AS fta, avg(tov) AS tov, avg(oreb) AS oreb FROM pg GROUP BY 1, 2),
roster AS (
  SELECT season, player_id, am / 4 AS min, pts / ({_POSS}) AS off, (pts - pm) / ({_POSS}) AS def, (fga + 0.44::DOUBLE * fta + tov) / nullif(am, 0) AS usg, pts / nullif(2 * (fga + 0.44::DOUBLE * fta), 0) AS ts, fta / fga AS pie,
         tov / nullif(fga + 0.44::DOUBLE * fta + tov, 0) AS tov
  FROM a)"""
_WEIGHT = "least(coalesce(min, 0) / 20.0::DOUBLE, 1.0::DOUBLE)"


def _blend(label: str, alias: str, x: tuple[str, str, str]) -> str:
    line = " + ".join(f"coalesce({a}, 0) * {alias}.b_{a}" for a in x)
    return f"({_WEIGHT} * coalesce({label}, 0) + (1 - {_WEIGHT}) * coalesce({alias}.b_0 + {line}, 0))"


_O, _D = ("usg", "ts", "pie"), ("pie", "tov", "usg")
_SCORES = f"""{_PG},
numbered AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS rn FROM pg),
b AS (
  SELECT player_id, count(*) AS gp, sum(CASE WHEN wl = 'F' THEN 1 ELSE 0 END) AS wins, sum(min) AS mins, sum({_unit('pts')}) AS p, sum({_unit('pts - pm')}) AS q, count(*) FILTER (rn <= 10 AND min > 0) AS last
  FROM numbered GROUP BY 1),
s AS (SELECT *, coalesce(wins * CAST(p AS DOUBLE) / nullif(p + q, 0), 0) AS ows FROM b),
signed AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
cl AS (
  SELECT user_id AS player_id, count(DISTINCT CAST(ts AS DATE)) AS cgp, CAST(sum(cents) AS DOUBLE) / 100 AS cmin, CAST(sum(CASE WHEN event_type = 'error' THEN -cents ELSE cents END) AS DOUBLE) / 1e4::DOUBLE AS cpm,
         CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS fgm, CAST(count(*) FILTER (event_type IN ('purchase', 'click')) AS DOUBLE) AS cfga, CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS cfta
  FROM signed GROUP BY 1),
f AS (
  SELECT s.player_id, 0.6::DOUBLE * coalesce(48.0::DOUBLE * wins / nullif(mins, 0), 0) + 0.2::DOUBLE * ows + 0.2::DOUBLE * (wins - ows) AS win_shares, 0.6::DOUBLE * {_factor('gp', '82.0::DOUBLE')} + 0.4::DOUBLE * last / 10 AS available,
         coalesce(0.4::DOUBLE * (cpm / cgp) + 0.3::DOUBLE * ((2 * fgm + cfta) / cgp) + 0.2::DOUBLE * (fgm / nullif(cfga, 0)) + 0.1::DOUBLE * (cpm / nullif(cmin, 0)), 0) AS clutch
  FROM s LEFT JOIN cl ON cl.player_id = s.player_id),
final AS (SELECT *, 0.5::DOUBLE * win_shares + 0.3::DOUBLE * clutch + 0.2::DOUBLE * available AS score FROM f)"""
_HELD = "SELECT page, page % 11 AS kind, count(*) AS n FROM (SELECT CAST(floor(c_custkey / 37) AS INTEGER) AS page FROM customer) GROUP BY 1"

SQL = {
    "games_as_of": f"""WITH {_TG},
h AS (
  SELECT team_id, game_id, game_date, season, sum({_unit('net')}) OVER ten / CAST(count(*) OVER ten AS DOUBLE) AS form, count(*) OVER year AS played, CAST(sum(CASE WHEN wl = 'F' THEN 1 ELSE 0 END) OVER year AS BIGINT) AS won
  FROM tg WINDOW ten AS (PARTITION BY team_id ORDER BY game_date, game_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), year AS (PARTITION BY team_id, season ORDER BY game_date, game_id ROWS UNBOUNDED PRECEDING)),
day AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY team_id, game_date ORDER BY game_id DESC) = 1),
known AS (
  SELECT t.team_id, t.game_id, t.game_date, form, CASE WHEN day.season = t.season THEN played ELSE 0 END AS played, CASE WHEN day.season = t.season THEN won ELSE 0 END AS won
  FROM tg t ASOF LEFT JOIN day ON day.team_id = t.team_id AND t.game_date > day.game_date)
SELECT a.game_id, a.game_date, a.team_id AS team_1, b.team_id AS team_2, {_sure('a.form / 1e6::DOUBLE', 'form_1')}, {_sure('b.form / 1e6::DOUBLE', 'form_2')}, a.played AS played_1, a.won AS won_1, b.played AS played_2, b.won AS won_2
FROM known a JOIN known b ON a.game_id = b.game_id AND a.team_id < b.team_id""",
    "orders_as_of_sliced": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders),
u AS (SELECT o_custkey, o_orderdate AS urgent_date, max(o_orderkey) AS urgent_key FROM o WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT o_orderkey, o.o_custkey, o_orderdate, urgent_key, urgent_date FROM o ASOF LEFT JOIN u ON u.o_custkey = o.o_custkey AND o.o_orderdate >= u.urgent_date""",
    "bucket_calendar": f"""WITH {_PG}, g AS (SELECT c_nationkey AS team_id, season, game_date, CAST(min AS BIGINT) AS mins FROM pg JOIN customer ON c_custkey = player_id),
s AS (SELECT DISTINCT team_id, season, make_date(CAST(left(season, 4) AS INTEGER), 10, 22) AS f, make_date(CAST(left(season, 4) AS INTEGER) + 1, 4, 14) AS l FROM g),
spine AS (SELECT team_id, season, k AS bucket, CAST(f + 5 * k AS DATE) AS date_from, CAST(f + 5 * k + 4 AS DATE) AS date_to FROM (SELECT *, CAST(unnest(range(40)) AS INTEGER) AS k FROM s) WHERE f + 5 * k <= l),
e AS (
  SELECT x.team_id, x.season, bucket, date_from, date_to, count(mins) AS n_games, floor(CAST(sum(mins) AS DOUBLE) * 1e6::DOUBLE / nullif(count(mins), 0) + 0.5::DOUBLE) AS mean
  FROM spine x LEFT JOIN g ON g.team_id = x.team_id AND g.season = x.season AND game_date BETWEEN date_from AND date_to GROUP BY ALL)
SELECT team_id, season, CAST(bucket AS BIGINT) AS bucket, date_from, date_to, n_games, {_sure('mean / 1e6::DOUBLE', 'mean_min')},
       {_sure('sum(CASE WHEN bucket > 0 THEN mean END) OVER w / count(CASE WHEN bucket > 0 THEN mean END) OVER w / 1e6::DOUBLE', 'mean_of_means')}
FROM e WINDOW w AS (PARTITION BY team_id, season ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "season_ratings": f"""WITH {_PG}, {_ROSTER}, fo AS {_fit(_O, 'off')}, fd AS {_fit(_D, 'def')},
r AS (SELECT roster.season, player_id, {_blend('off', 'fo', _O)} AS e_off, {_blend('def', 'fd', _D)} AS e_def FROM roster LEFT JOIN fo ON fo.season = roster.season LEFT JOIN fd ON fd.season = roster.season)
SELECT season, player_id, {_sure('e_off', 'e_off')}, {_sure('e_def', 'e_def')}, {_sure('e_off - e_def', 'e_net')} FROM r""",
    "final_ranking": f"WITH {_SCORES} SELECT player_id, {_sure('win_shares', 'win_shares')}, {_sure('clutch', 'clutch')}, {_sure('available', 'available')}, {_sure('score', 'score')} FROM final",
    "team_decision": f"""WITH {_SCORES}, ranked AS (SELECT c_nationkey AS team_id, {_unit('score')} AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_unit('score')} DESC, player_id) AS rn FROM final JOIN customer ON c_custkey = player_id),
best AS (SELECT team_id, CAST(sum(score) AS DOUBLE) / count(*) / 1e6::DOUBLE AS players FROM ranked WHERE rn <= 8 GROUP BY 1),
own AS (SELECT c_nationkey AS team_id, CAST(sum({_unit('pm')}) AS DOUBLE) / sum(fga) / 1e6::DOUBLE AS team FROM pg JOIN customer ON c_custkey = player_id GROUP BY 1)
SELECT team_id, {_sure('team', 'team')}, {_sure('players', 'players')}, {_sure('0.7::DOUBLE * team + 0.3::DOUBLE * players', 'decision')} FROM own JOIN best USING (team_id)""",
    "listed_games": "SELECT o_orderkey, o_custkey, -CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT) AS place FROM orders WHERE o_custkey % 10 = 3",
    "landed_result_sets": f"""SELECT c_custkey AS PLAYER_ID, c_name AS PLAYER_NAME, CASE WHEN kind = 5 AND c_custkey % 2 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS TEAM_ID, CAST(printf('%.2f', c_acctbal) AS DOUBLE) AS PTS, CAST(NULL AS BIGINT) AS GP
FROM customer JOIN ({_HELD}) ON page = floor(c_custkey / 37) WHERE kind NOT IN (1, 2, 3, 6, 7) AND NOT (kind = 4 AND page IN (SELECT floor(c_custkey / 37) FROM customer WHERE c_custkey % 500 = 7))""",
    "result_set_problems": f"""SELECT CASE WHEN kind <> 1 THEN 'players/' || page END AS resource, ['no document of result sets', 'a key column missing', 'a header twice', 'rows of other length than headers', 'values of another type', 'no such set', 'no headers or rows'][kind] AS problem,
       CAST(CASE WHEN kind IN (1, 6, 7) THEN 0 WHEN kind = 5 THEN (SELECT count(*) FROM customer WHERE floor(c_custkey / 37) = page AND c_custkey % 2 = 0) ELSE n END AS BIGINT) AS n_rows, true AS names_file
FROM ({_HELD}) h WHERE kind BETWEEN 1 AND 7 AND (kind <> 4 OR page IN (SELECT floor(c_custkey / 37) FROM customer WHERE c_custkey % 500 = 7))""",
    "late_rows": """SELECT event_id, user_id, round(CASE WHEN event_id % 10 = 7 AND own < 5 THEN value + 1 ELSE value END, 6) AS value, CAST(CASE WHEN event_id % 10 = 7 AND own < 5 THEN 2 ELSE 1 END AS BIGINT) AS version, CAST(own AS BIGINT) AS bucket
FROM (SELECT *, least(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5, 5) AS own FROM events) WHERE NOT (event_id % 10 = 9 AND own < 2)""",
    "bucketed_upsert": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || '*' ELSE c_name END AS c_name, round(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 6) AS c_acctbal FROM customer
UNION ALL SELECT c_custkey + 10000000, c_name, round(c_acctbal, 6) FROM customer WHERE c_custkey % 100 = 1""",
    "evolved_columns": "SELECT c_custkey, c_name, round(c_acctbal, 6) AS balance, CASE WHEN c_custkey % 2 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS TEAM_ID FROM customer",
    "published_refresh": """WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders)
SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice, 6) AS o_totalprice FROM o WHERE o_custkey % 3 > 0 AND o_orderdate < DATE '1998-06-01'
UNION ALL SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice + 1, 6) FROM o WHERE o_custkey % 3 = 0 AND o_orderdate >= DATE '1998-06-01'""",
}
