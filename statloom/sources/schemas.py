"""Logical tables: explicit schemas, keys and foreign keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    """A logical table; ``foreign`` maps a column to (table, column), ``renamed`` a column's former name to its present one."""

    name: str
    ddl: str
    key: tuple[str, ...] = ()
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)
    partition: str | None = None
    renamed: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


def _doubles(names: str) -> str:
    return ", ".join(f"{n} DOUBLE" for n in names.split())


_BOX = "FGM FGA FG_PCT FG3M FG3A FG3_PCT FTM FTA FT_PCT OREB DREB REB AST TOV STL BLK PF PTS"

TABLES = {
    t.name: t
    for t in (
        Table("teams", "TEAM_ID BIGINT NOT NULL, TEAM_NAME STRING, TEAM_ABBREVIATION STRING", ("TEAM_ID",)),
        Table("teams_misc", f"TEAM_ID BIGINT NOT NULL, TEAM_NAME STRING, GP BIGINT, W BIGINT, L BIGINT, W_PCT DOUBLE, MIN DOUBLE, {_doubles(_BOX)}, BLKA DOUBLE, PFD DOUBLE, PLUS_MINUS DOUBLE", ("TEAM_ID",)),
        Table("players_misc", f"PLAYER_ID BIGINT NOT NULL, PLAYER_NAME STRING, SEASON_ID STRING, LEAGUE_ID STRING, TEAM_ID BIGINT, TEAM_ABBREVIATION STRING, PLAYER_AGE DOUBLE, GP BIGINT, GS BIGINT, MIN DOUBLE, {_doubles(_BOX)}", ("PLAYER_ID",), {"TEAM_ID": ("teams", "TEAM_ID")}),
        Table("players_estimated", f"PLAYER_ID BIGINT NOT NULL, PLAYER_NAME STRING, TEAM_ID BIGINT, GP BIGINT, W BIGINT, L BIGINT, W_PCT DOUBLE, MIN DOUBLE, {_doubles('E_OFF_RATING E_DEF_RATING E_NET_RATING E_AST_RATIO E_OREB_PCT E_DREB_PCT E_REB_PCT E_TOV_PCT E_USG_PCT E_PACE')}", ("PLAYER_ID",), {"TEAM_ID": ("teams", "TEAM_ID"), "PLAYER_ID": ("players_misc", "PLAYER_ID")}),
        Table("players_advanced", f"PLAYER_ID BIGINT NOT NULL, PLAYER_NAME STRING, TEAM_ID BIGINT, TEAM_ABBREVIATION STRING, AGE DOUBLE, GP BIGINT, W BIGINT, L BIGINT, MIN DOUBLE, {_doubles('OFF_RATING DEF_RATING NET_RATING AST_PCT AST_TO AST_RATIO OREB_PCT DREB_PCT REB_PCT TM_TOV_PCT E_TOV_PCT EFG_PCT TS_PCT USG_PCT E_USG_PCT PACE PIE')}", ("PLAYER_ID",), {"TEAM_ID": ("teams", "TEAM_ID"), "PLAYER_ID": ("players_misc", "PLAYER_ID")}),
        Table("player_clutch", f"PLAYER_ID BIGINT, GP BIGINT, {_doubles('MIN FGM FGA FTA TOV PLUS_MINUS CLUTCH_SCORE_PCT CLUTCH_USAGE_RATE CLUTCH_NET_RATING')}"),
        Table("player_games", f"season STRING, PLAYER_ID BIGINT, GAME_ID STRING, GAME_DATE DATE, MATCHUP STRING, WL STRING, {_doubles('MIN PTS FGA FTA TOV OREB PLUS_MINUS')}, TEAM_ID BIGINT, TEAM_NAME STRING", ("PLAYER_ID", "GAME_DATE"), {"PLAYER_ID": ("players_misc", "PLAYER_ID")}, "season", {"Player_ID": "PLAYER_ID"}),
        Table("team_games", "season STRING, TEAM_ID BIGINT, TEAM_NAME STRING, TEAM_ABBREVIATION STRING, GAME_ID STRING, GAME_DATE DATE, WL STRING, FT_PCT DOUBLE", ("TEAM_ID", "GAME_DATE"), {"TEAM_ID": ("teams", "TEAM_ID")}, "season"),
        Table("team_adv_games", f"season STRING, GAME_ID STRING, TEAM_ID BIGINT, TEAM_NAME STRING, TEAM_ABBREVIATION STRING, TEAM_CITY STRING, {_doubles('NET_RATING OFF_RATING DEF_RATING AST_TOV OREB_PCT DREB_PCT TM_TOV_PCT EFG_PCT TS_PCT PACE PIE')}", ("GAME_ID", "TEAM_ID"), {}, "season"),
        Table("injury_report", "PLAYER_NAME STRING, TEAM_NAME STRING, TEAM_ID BIGINT, PLAYER_ID BIGINT"),
    )
}
