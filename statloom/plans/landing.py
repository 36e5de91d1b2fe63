"""Queries over sinks and landed files: what is written is read back, and compared with the tables that it came from."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import dates, html
from statloom.operators import mutate
from statloom.operators import relational as rel
from statloom.plans import games
from statloom.sources import files
from statloom.sources.files import table
from statloom.sources.schemas import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(f):
    QUERIES[f.__name__] = f
    return f


def _place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names; the warehouse where none is named.

    On a cluster a warehouse in a machine's own file system is no shared folder, and an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir")
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match(r"file:|/", shared):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared.rstrip('/')}/landing/{name}-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")


# ------------------------------------------------------------------ sinks


@_register
def sink_overwrite(spark: SparkSession, d: str) -> DataFrame:
    path, c = _place(spark, "overwrite"), _customers(spark, d)
    mutate.overwrite(c.where("c_custkey % 2 = 0"), path)
    mutate.overwrite(c.where("c_custkey % 3 = 0"), path)
    return spark.read.schema(c.schema).parquet(path)


@_register
def sink_append(spark: SparkSession, d: str) -> DataFrame:
    path, c = _place(spark, "append"), _customers(spark, d)
    mutate.overwrite(c.where("c_custkey % 2 = 0"), path)
    mutate.append(c.where("c_custkey % 3 = 0"), path)
    return spark.read.schema(c.schema).parquet(path)


@_register
def sink_clear_and_append(spark: SparkSession, d: str) -> DataFrame:
    path, c = _place(spark, "clear"), _customers(spark, d)
    mutate.overwrite(c, path)
    mutate.overwrite(c.where("false"), path)
    mutate.append(c.where("c_custkey % 5 = 0"), path)
    return spark.read.schema(c.schema).parquet(path)


@_register
def sink_by_team(spark: SparkSession, d: str) -> DataFrame:
    """One partition a team; of those only the touched ones are replaced."""
    path, c = _place(spark, "teams"), _customers(spark, d)
    mutate.overwrite(c, path, "c_nationkey")
    mutate.overwrite(c.where("c_nationkey = 3").withColumn("c_name", F.lower("c_name")), path, "c_nationkey")
    return spark.read.schema(c.schema).parquet(path)


@_register
def season_scan(spark: SparkSession, d: str) -> DataFrame:
    path, g = _place(spark, "seasons"), games.player_games(spark, d).select("player_id", "game_id", "game_date", "season")
    mutate.overwrite(g, path, "season")
    return files.season_table(spark, path, "1997-98").select("player_id", "game_id", "game_date", "season")


@_register
def table_ddl(spark: SparkSession, d: str) -> DataFrame:
    """A table is made from its logical schema, filled, counted and dropped."""
    name, t = f"ddl_{uuid.uuid4().hex}", TABLES["teams"]
    spark.sql(f"CREATE TABLE {name} ({t.ddl}) USING parquet")
    table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("TEAM_ID"), F.col("n_name").alias("TEAM_NAME"), F.upper(F.left("n_name", F.lit(3))).alias("TEAM_ABBREVIATION")).write.insertInto(name)
    names, path = spark.table(name).columns, _place(spark, "ddl")
    counts = spark.table(name).agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column_name", "n_rows")
    counts.write.parquet(path)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.schema(counts.schema).parquet(path).withColumn("still_there", F.lit(spark.catalog.tableExists(name)))


# ------------------------------------------------------------------ landed files


@_register
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, c = _place(spark, "csv"), table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("c_name"), F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")).alias("c_nationkey"))
    mutate.export_csv(c, path)
    return files.delimited(spark, path, c.schema)


@_register
def tab_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Files with padded names and values, a header in each."""
    path, n = _place(spark, "tabs"), table(spark, d, "nation")
    rows = n.select(F.col("n_nationkey").alias("Key"), F.concat("n_name", F.lit("   ")).alias("Name  "), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("Region"))
    rows.write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.delimited(spark, path, "nation_key long, name string, region_key long", "\t")


@_register
def nested_json(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a map of title -> attributes, where attributes differ from title to title; one a line."""
    path, n = _place(spark, "json"), table(spark, d, "nation")
    attributes = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("Region"), F.col("n_regionkey").cast("string"))).otherwise(F.create_map(F.lit("Region"), F.col("n_regionkey").cast("string"), F.lit("Key"), F.col("n_nationkey").cast("string")))
    n.select(F.to_json(F.array(F.create_map("n_name", attributes))).alias("value")).write.text(path)
    return files.titled_json(spark, path, whole=False)


@_register
def landed_frames(spark: SparkSession, d: str) -> DataFrame:
    """Landed team rows read by their logical schema, with rows that break its key or its references marked."""
    t, path = TABLES["players_misc"], _place(spark, "landed")
    c = table(spark, d, "customer")
    rows = c.select(F.when(F.col("c_custkey") % 50 == 1, F.lit(1)).otherwise(F.col("c_custkey")).cast("long").alias("PLAYER_ID"), F.col("c_name").alias("PLAYER_NAME"), F.when(F.col("c_custkey") % 7 == 0, F.lit(-1)).otherwise(F.col("c_nationkey")).cast("long").alias("TEAM_ID"))
    files.land(rows, t, path)
    got = files.landed(spark, t, path)
    teams = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("TEAM_ID"))
    twice = mutate.duplicates(got, list(t.key)).select(*t.key, F.lit(True).alias("key_twice"))
    lost = mutate.orphans(got, "TEAM_ID", teams, "TEAM_ID").select("PLAYER_NAME").distinct().withColumn("no_team", F.lit(True))
    out = got.join(twice, list(t.key), "left").join(lost, "PLAYER_NAME", "left")
    return out.select("PLAYER_ID", "PLAYER_NAME", "TEAM_ID", F.coalesce("key_twice", F.lit(False)).alias("key_twice"), F.coalesce("no_team", F.lit(False)).alias("no_team"))


@_register
def common_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns that both sides have come from the left one alone; the join needs no suffixes."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    o = table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("c_name"), "c_acctbal", "c_nationkey")
    shared = rel.shared_columns(c, o, except_for=("c_custkey",))
    return c.join(o.drop(*shared), "c_custkey").select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 6).alias("c_acctbal"))


# ------------------------------------------------------------------ HTML tables


def _cell(tag: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))


def _team_pages(spark: SparkSession, d: str) -> DataFrame:
    """One page a region with a commented table of its nations, beneath a header of two rows."""
    n = table(spark, d, "nation")
    row = F.concat(F.lit("<tr>"), _cell("th", F.col("n_name")), _cell("td", F.concat(F.lit(" <b>"), F.col("n_nationkey").cast("string"), F.lit("</b> "))), _cell("td", F.lit("&amp;")), _cell("td", (F.col("n_nationkey") * 2).cast("string")), F.lit("</tr>"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "\n")
    head = '<html><div id="all"><!-- <table class="stats wide" id="misc_stats"><thead><tr><th></th><th colspan="2">Advanced</th><th>Arena</th></tr><tr><th>Team</th><th>Key</th><th>Mark</th><th>Twice</th></tr></thead><tbody>'
    return n.groupBy("n_regionkey").agg(F.concat(F.lit(head), body, F.lit('</tbody></table> --></div><table id="other"><tr><td>no</td></tr></table></html>')).alias("html"))


@_register
def html_table(spark: SparkSession, d: str) -> DataFrame:
    cells = html.extract_table(_team_pages(spark, d), "html", "misc_stats", keep=("n_regionkey",))
    return cells.select("n_regionkey", "row", "col", "group", "header", "text")


@_register
def html_table_frame(spark: SparkSession, d: str) -> DataFrame:
    """The same as one row a team, its columns typed."""
    cells = html.extract_table(_team_pages(spark, d), "html", "misc_stats", keep=("n_regionkey",))
    wide = cells.groupBy("n_regionkey", "row").pivot("header", ["Team", "Key", "Twice"]).agg(F.first("text"))
    return wide.select("n_regionkey", F.col("Team").alias("team"), F.col("Key").cast("long").alias("nation_key"), F.col("Twice").cast("long").alias("twice"))


@_register
def html_table_names(spark: SparkSession, d: str) -> DataFrame:
    p = _team_pages(spark, d)
    return p.select("n_regionkey", F.array_join(html.table_ids(F.col("html")), ",").alias("ids"), F.array_join(html.table_classes(F.col("html")), ",").alias("classes"))


# ------------------------------------------------------------------ texts of time


@_register
def minutes_and_seconds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey")
    shown = F.when(F.col("o_orderkey") % 10 == 0, "DNP").when(F.col("o_orderkey") % 10 == 1, F.lit("12")).otherwise(F.format_string("%d:%02d", F.col("o_orderkey") % 48, F.col("o_orderkey") % 60))
    return o.select("o_orderkey", F.round(dates.minutes_played(shown), 6).alias("minutes"))


_TEAM_TABLE = "SELECT CAST(n_regionkey AS BIGINT) AS r, n_name, CAST(n_nationkey AS BIGINT) AS k, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS i, n_regionkey FROM nation"

SQL = {
    "sink_overwrite": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 = 0",
    "sink_append": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 0",
    "sink_clear_and_append": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 5 = 0",
    "sink_by_team": "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN lower(c_name) ELSE c_name END AS c_name, c_nationkey FROM customer",
    "season_scan": "SELECT o_custkey AS player_id, o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date, '1997-98' AS season FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-10-01' AND CAST(o_orderdate AS DATE) < DATE '1998-10-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)",
    "table_ddl": "SELECT c AS column_name, n AS n_rows, false AS still_there FROM (SELECT unnest(['TEAM_ID', 'TEAM_NAME', 'TEAM_ABBREVIATION']) AS c), (SELECT count(*) AS n FROM nation)",
    "csv_round_trip": "SELECT c_custkey, c_name || ', \"x\"' AS c_name, CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END AS c_nationkey FROM customer",
    "tab_delimited": "SELECT CAST(n_nationkey AS BIGINT) AS nation_key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS BIGINT) END AS region_key FROM nation",
    "nested_json": "SELECT n_name AS title, 'Region' AS attribute, CAST(n_regionkey AS VARCHAR) AS value FROM nation WHERE n_nationkey < 25 UNION ALL SELECT n_name, 'Key', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey < 25 AND n_nationkey % 2 <> 0",
    "landed_frames": """SELECT p AS PLAYER_ID, c_name AS PLAYER_NAME, t AS TEAM_ID, count(*) OVER (PARTITION BY p) > 1 AS key_twice, t NOT IN (SELECT n_nationkey FROM nation) AS no_team
FROM (SELECT CAST(CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE c_custkey END AS BIGINT) AS p, c_name, CAST(CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS BIGINT) AS t FROM customer)""",
    "common_columns": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer",
    "html_table": f"""SELECT n_regionkey, i AS row, CAST(c AS INTEGER) AS col, ['', 'Advanced', 'Advanced', 'Arena'][c + 1] AS "group", ['Team', 'Key', 'Mark', 'Twice'][c + 1] AS header, [n_name, CAST(k AS VARCHAR), '&', CAST(2 * k AS VARCHAR)][c + 1] AS text
FROM ({_TEAM_TABLE}), (SELECT unnest(range(4)) AS c)""",
    "html_table_frame": f"SELECT n_regionkey, n_name AS team, k AS nation_key, 2 * k AS twice FROM ({_TEAM_TABLE})",
    "html_table_names": "SELECT DISTINCT n_regionkey, 'misc_stats,other' AS ids, 'stats wide' AS classes FROM nation",
    "minutes_and_seconds": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 12.0::DOUBLE ELSE round((o_orderkey % 48) + (o_orderkey % 60) / 60.0::DOUBLE, 6) END AS minutes FROM orders",
}
