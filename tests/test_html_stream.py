from pyspark.sql import functions as F

from statloom.functions import html
from statloom.streaming.refresh import refresh, windowed

PAGE = """<div><!-- <table id="misc"><thead><tr><th></th><th>Group</th></tr><tr><th>Player</th><th>&nbsp;</th><th>G<i>P</i></th></tr></thead>
<tbody><tr><th>A &amp; B</th><td>1</td><td> 2 </td></tr><tr><td>C<td>3<td>4</tr></tbody></table> --></div><table id="other"><tr><td>no</table>"""


def test_table_in_a_comment():
    assert html.read_table(PAGE, "misc") == [(0, 0, "", "Player", "A & B"), (0, 1, "Group", "", "1"), (0, 2, "", "GP", "2"), (1, 0, "", "Player", "C"), (1, 1, "Group", "", "3"), (1, 2, "", "GP", "4")]
    assert html.read_table("<p>none</p>") == [] and html.read_table(None) == []


def test_extract_table(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    rows = html.extract_table(df, "html", "misc", keep=("page_id",))
    assert rows.where("header = 'GP'").orderBy("row").select("page_id", "text").collect() == [(1, "2"), (1, "4")]
    wide = rows.groupBy("page_id", "row").pivot("header", ["Player", "GP"]).agg(F.first("text"))
    assert sorted(r.Player for r in wide.collect()) == ["A & B", "C"]
    assert df.select(html.table_ids(F.col("html"))).first()[0] == ["misc", "other"]


def test_stream_refreshes_a_table(spark, tmp_path):
    schema = "k long, season string, v long"
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    for batch in ([(1, "a", 1), (2, "b", 1)], [(2, "b", 2), (3, "b", 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(land)
        q = refresh(spark.readStream.schema(schema).parquet(land), out, ["k"], str(tmp_path / "cp"), "season")
        q.awaitTermination()
        assert q.exception() is None
    assert sorted((r.k, r.season, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a", 1), (2, "b", 2), (3, "b", 3)]


def test_a_key_may_change_its_partition(spark, tmp_path):
    schema = "k long, season string, v long, t long"
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    for batch in ([(1, "a", 1, 1), (2, "b", 1, 1), (3, "b", 1, 1)], [(1, "b", 5, 3), (1, "b", 9, 2)], []):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(land)
        q = refresh(spark.readStream.schema(schema).parquet(land), out, ["k"], str(tmp_path / "cp"), "season", "t")
        q.awaitTermination()
        assert q.exception() is None
    assert sorted((r.k, r.season, r.v) for r in spark.read.parquet(out).collect()) == [(1, "b", 5), (2, "b", 1), (3, "b", 1)]


def test_windows_of_a_stream_close_by_watermark(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    days = [["2024-01-01", "2024-01-05"], ["2024-03-01"], ["2024-01-02"], ["2024-05-01"]]  # the third is too late
    for k, d in enumerate(days):
        spark.createDataFrame([(x,) for x in d], "d string").select(F.to_timestamp("d").alias("ts"), F.lit(float(k)).alias("v")).coalesce(1).write.mode("append").parquet(land)
        s = windowed(spark.readStream.schema("ts timestamp, v double").parquet(land), "ts", [], [F.count("*").alias("n")])
        q = s.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(out).orderBy("window_start").collect()
    assert [r.n for r in got][:2] == [1, 1] and sum(r.n for r in got) == 3


def test_five_day_windows(spark):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:00:00', 1.0D), (timestamp'2024-01-05 23:00:00', 3.0D), (timestamp'2024-01-06 00:00:00', 5.0D) AS t(ts, v)")
    got = windowed(df, "ts", [], [F.avg("v").alias("mean")], start="3 days").orderBy("window_start").collect()
    assert [r["mean"] for r in got] == [2.0, 5.0]
