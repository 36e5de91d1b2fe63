"""Rating formulas as column expressions. Divisions give null where the divisor is 0 or the result undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def known(x: Column, value: float = 0.0) -> Column:
    """NaN and null as ``value``."""
    return F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(value))


def settled(x: Column) -> Column:
    """Six decimals, halves and what lies a hair below them upwards: ratings are often exact halves of a millionth, which no two engines round alike."""
    return F.floor(x * 1e6 + 0.5001) / 1e6


def attempts(fga: Column, fta: Column) -> Column:
    return fga + 0.44 * fta


def possessions(fga: Column, fta: Column, oreb: Column, tov: Column) -> Column:
    """Possessions used; null where they are not above 0."""
    p = 0.96 * fga + 0.44 * fta - oreb + tov
    return F.when(p > 0, p)


def net_rating(pm: Column, poss: Column) -> Column:
    """Points for less points against, a possession: that is plus-minus a possession."""
    return ratio(pm, poss)


def true_shooting(pts: Column, fga: Column, fta: Column) -> Column:
    return ratio(pts, 2 * attempts(fga, fta))


def usage(fga: Column, fta: Column, tov: Column, minutes: Column) -> Column:
    return ratio(attempts(fga, fta) + tov, minutes)


def turnover_rate(fga: Column, fta: Column, tov: Column) -> Column:
    return ratio(tov, attempts(fga, fta) + tov)


def form(a: dict[str, Column], net: Column | None = None) -> Column:
    """Form over some games from their averages (pts, pm, min, fga, fta, tov, oreb) and number n."""
    net = net_rating(a["pm"], possessions(a["fga"], a["fta"], a["oreb"], a["tov"])) if net is None else net
    return 0.4 * net + 0.2 * true_shooting(a["pts"], a["fga"], a["fta"]) + 0.15 * usage(a["fga"], a["fta"], a["tov"], a["min"]) + 0.1 * turnover_rate(a["fga"], a["fta"], a["tov"]) + 0.15 * ratio(a["min"], a["n"])


def blend(ten: Column, five: Column) -> Column:
    return 0.6 * ten + 0.4 * five


def games_factor(gp: Column, whole: Column | float = 54.0) -> Column:
    """Weight of a player's games played: (games / whole) ** 0.75."""
    whole = whole if isinstance(whole, Column) else F.lit(whole)
    return F.pow(ratio(gp.cast("double"), whole), F.lit(0.75))


def primary(pie: Column, usg: Column, net: Column, factor: Column) -> Column:
    return 0.175 * pie + 0.125 * usg + 0.1 * net * factor


def secondary(ts: Column, tov: Column, minutes: Column) -> Column:
    return 0.125 * ts + 0.05 * tov + 0.15 * minutes


def clutch(csp: Column, cur: Column, cnr: Column, factor: Column) -> Column:
    """Clutch score; 0 where a part is missing."""
    return known((0.5 * csp + 0.25 * cur + 0.25 * cnr) * factor)


def clutch_metrics(fgm: Column, fga: Column, fta: Column, tov: Column, minutes: Column, pm: Column, gp: Column) -> dict[str, Column]:
    """Shooting share (0 without attempts), usage a minute and plus-minus a game in close games."""
    return {"clutch_score_pct": F.coalesce(ratio(fgm, fga), F.lit(0.0)), "clutch_usage_rate": ratio(attempts(fga, fta) + tov, minutes), "clutch_net_rating": ratio(pm, gp)}


def contribution(first: Column, second: Column, close: Column, recent: Column, base: float = 0.5, clutch_weight: float = 0.3, recent_weight: float = 0.2) -> Column:
    return base * (first + second) + clutch_weight * close + recent_weight * recent


def four_factors(efg: Column, tov: Column, oreb: Column, dreb: Column, ft: Column) -> Column:
    return 0.6 * efg - 0.25 * tov + 0.1 * oreb + 0.1 * dreb + 0.15 * ft


def team_score(net: Column, four: Column) -> Column:
    return 0.75 * net + 0.25 * four


def availability(gp: Column, whole: Column | float, last: Column, of: int = 10) -> Column:
    """How far a player can be counted on: games of the season (scaled) and of the team's last ``of``."""
    return 0.6 * games_factor(gp, whole) + 0.4 * last / of


def minutes_consistency(season: Column, recent: Column, deviation: Column) -> Column:
    """Season minutes, and how steady the recent ones are."""
    return 0.6 * season + 0.4 * (1 - ratio(deviation, recent))


def win_share_score(per_48: Column, offence: Column, defence: Column) -> Column:
    return 0.6 * per_48 + 0.2 * offence + 0.2 * defence


def clutch_score(net: Column, points: Column, efg: Column, added: Column) -> Column:
    """Close games: net rating, points a game, effective shooting and win probability added; 0 where a part is missing."""
    return known(0.4 * net + 0.3 * points + 0.2 * efg + 0.1 * added)


def final_score(wins: Column, close: Column, available: Column) -> Column:
    """The final ranking's score."""
    return 0.5 * wins + 0.3 * close + 0.2 * available


def decision(team: Column, players: Column) -> Column:
    """A team's own rating and that of its players."""
    return 0.7 * team + 0.3 * players


def category(minutes: Column, star: float = 25.0, rotation: float = 15.0) -> Column:
    """'Star' above ``star`` minutes, 'Rotation' in the open band below it, else null: both bounds lie outside."""
    return F.when(minutes > star, "Star").when((minutes > rotation) & (minutes < star), "Rotation")
