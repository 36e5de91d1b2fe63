"""Text: matchups, plain names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def matchup_team(matchup: Column, own: bool = True) -> Column:
    """The team of a matchup 'PHI vs. HOU' (at home) or 'PHI @ HOU' (away).

    ``own``: the first team, whose row it is. Otherwise the home team (the second of an away matchup).
    """
    first, second = (F.split_part(F.replace(matchup, F.lit(" vs. "), F.lit(" @ ")), F.lit(" @ "), F.lit(k)) for k in (1, 2))
    return first if own else F.when(F.contains(matchup, F.lit("@")), second).otherwise(first)


def is_home(matchup: Column) -> Column:
    return ~F.contains(matchup, F.lit("@"))


@F.pandas_udf(StringType())
def plain_name(names: pd.Series) -> pd.Series:
    """A name without accents: compatibility decomposition, ASCII only, lower case, trimmed. Null stays null.

    Spark has no decomposition function, and an accent-blind collation would equate more than this does.
    """
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower().strip())


def money(text: Column) -> Column:
    """A number from text such as '$453,173'; null where there is none."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
