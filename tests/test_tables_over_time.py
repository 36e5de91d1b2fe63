"""Tables that are published whole, merged by bucket, written under two schemas, or fed by streams of landed files."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import publish
from statloom.operators import relational as rel
from statloom.plans import history, model, queries
from statloom.plans.oracle import oracle_sql
from statloom.sources import files, result_sets
from statloom.sources.schemas import TABLES, Table
from statloom.streaming import landed

from .oracle import connect, same

# ------------------------------------------------------------------ published versions


def test_a_failed_check_or_write_changes_nothing(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "t"), lambda *x: spark.createDataFrame(list(x), "k int, p int")
    now = lambda: sorted(tuple(r) for r in publish.current(spark, path).collect())
    assert publish.current(spark, path) is None
    parents = {"p": (spark.createDataFrame([(1,), (2,)], "id int"), "id")}
    with pytest.raises(publish.Refused):
        publish.publish(rows((1, 9)), path, ["k"], parents)
    assert publish.current(spark, path) is None
    publish.publish(rows((1, 1), (2, None)), path, ["k"], parents)
    for bad in (rows((1, 1), (1, 2)), rows((3, 3))):
        with pytest.raises(publish.Refused):
            publish.publish(bad, path, ["k"], parents)
        assert now() == [(1, 1), (2, None)]
    with pytest.raises(Exception, match="killed"):
        publish.publish(rows((5, 1)).withColumn("k", F.raise_error(F.lit("killed")).cast("int")), path, ["k"], parents)
    assert now() == [(1, 1), (2, None)]
    with monkeypatch.context() as m:
        m.setattr(publish, "_point", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            publish.publish(rows((5, 1)), path, ["k"], parents)
    assert now() == [(1, 1), (2, None)]
    publish.publish(publish.current(spark, path).unionByName(rows((3, 2))), path, ["k"], parents)  # reads what it replaces
    assert now() == [(1, 1), (2, None), (3, 2)]
    publish.clean(spark, path)
    assert now() == [(1, 1), (2, None), (3, 2)] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 1


def test_bucketed_merge_does_not_shuffle_the_target(spark):
    old = spark.createDataFrame([(k, f"a{k}") for k in range(500)], "k int, v string")
    stage = spark.createDataFrame([(3, "new"), (1000, "added")], "k int, v string")
    for t in ("merge_old", "merge_new"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    old.write.bucketBy(4, "k").sortBy("k").saveAsTable("merge_old")
    publish.upsert_bucketed("merge_old", stage, "k", "merge_new", 4)
    assert dict(spark.table("merge_new").collect()) == {k: f"a{k}" for k in range(500)} | {3: "new", 1000: "added"}
    assert len(spark.table("merge_new").inputFiles()) == 4  # a file a bucket, so that the next merge needs no sort either
    joined = spark.table("merge_new").join(stage.hint("merge"), "k", "full_outer")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        publish.upsert_bucketed("merge_new", stage.unionByName(stage), "k", "merge_more", 4)
    for t in ("merge_old", "merge_new"):
        spark.sql(f"DROP TABLE {t}")


def test_generations_of_a_schema(spark, tmp_path):
    t, path = Table("t", "id BIGINT, name STRING, score DOUBLE, team BIGINT", ("id",), renamed={"points": "score", "pts": "score"}), str(tmp_path)
    spark.createDataFrame([(1, "a", 1.5, "gone")], "ID long, name string, pts double, old string").write.parquet(f"{path}/g=1")
    spark.createDataFrame([(2, 2.5)], "id long, points double").write.parquet(f"{path}/g=2")
    spark.createDataFrame([(3, "c", 3.5, 7)], "id long, name string, score double, team int").write.parquet(f"{path}/g=3")
    assert sorted(map(tuple, files.generations(spark, path, t).collect())) == [(1, "a", 1.5, None), (2, None, 2.5, None), (3, "c", 3.5, 7)]


# ------------------------------------------------------------------ landed result sets


def test_whole_files_and_every_problem_by_file(spark, tmp_path):
    good = '{"resource": "r", "parameters": {"x": 1},\n "resultSets": [{"name": "Other", "headers": [], "rowSet": []},\n {"name": "P", "headers": ["TEAM_ID", "PLAYER_ID", "MORE"], "rowSet": [[5, 1, "x"], [null, 2, null]]}]}'
    for name, text in {
        "good": good,
        "broken": good[:60],
        "empty": "",
        "none": good.replace('"P"', '"Q"'),
        "twice": good.replace('"MORE"', '"TEAM_ID"'),
        "keyless": good.replace('"PLAYER_ID"', '"ID"'),
        "short": good.replace('[5, 1, "x"]', "[5, 1]"),
        "typed": good.replace('[5, 1, "x"]', '["five", 1, "x"]'),
        "null_key": good.replace("[null, 2, null]", "[1, null, null]"),
    }.items():
        (tmp_path / f"{name}.json").write_text(text)
    t = TABLES["players_misc"]
    rows = result_sets.result_sets(spark, str(tmp_path), t, "P", whole=True)
    assert rows.columns == [f.name for f in t.schema]
    assert sorted((r.PLAYER_ID or -1, r.TEAM_ID or -1) for r in rows.collect()) == [(-1, 1), (1, -1), (1, 5), (1, 5), (2, -1), (2, -1)]
    found = {r.file.rsplit("/", 1)[1][:-5]: (r.problem, r.n_rows) for r in result_sets.problems(spark, str(tmp_path), t, "P", whole=True).collect()}
    assert found == {"broken": ("no document of result sets", 0), "none": ("no such set", 0), "twice": ("a header twice", 2), "keyless": ("a key column missing", 2), "short": ("rows of other length than headers", 2), "typed": ("values of another type", 1), "null_key": ("values of another type", 1)}


# ------------------------------------------------------------------ streams

EVENT = "id long, ts timestamp, v double, version int, bucket int"


def _day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def _run(spark, place, rows, k, late="20 days"):
    if rows is not None:
        spark.createDataFrame(rows, EVENT).write.parquet(f"{place}/landed/d={k}")
    q = landed.late_refresh(spark, f"{place}/landed/*", spark.createDataFrame([], EVENT).schema, f"{place}/t", f"{place}/s", ["id"], "ts", "version", "bucket", late)
    q.awaitTermination()
    return q


def test_late_rows_before_and_behind_the_watermark_and_a_restart(spark, tmp_path):
    place = str(tmp_path)
    _run(spark, place, [(1, _day(0), 1.0, 1, 0), (2, _day(30), 2.0, 1, 3)], 0)
    _run(spark, place, [(3, _day(31), 3.0, 1, 3)], 1)
    late = [(4, _day(12), 4.0, 1, 1), (5, _day(5), 5.0, 1, 0), (2, _day(30), 9.0, 1, 3), (3, _day(31), 3.5, 2, 3)]  # within, behind, again, corrected
    _run(spark, place, late, 2)
    table = lambda: sorted((r.id, r.v, r.version) for r in spark.read.parquet(f"{place}/t").collect())
    want = [(1, 1.0, 1), (2, 2.0, 1), (3, 3.5, 2), (4, 4.0, 1)]
    assert table() == want
    q = _run(spark, place, None, 3)  # a run without new files reads none and changes nothing
    assert sum(p["numInputRows"] for p in q.recentProgress) == 0 and table() == want
    _run(spark, place, [(6, _day(60), 6.0, 1, 6)], 4)
    _run(spark, place, [(7, _day(39), 7.0, 1, 3), (8, _day(41), 8.0, 1, 4)], 5)  # the watermark of earlier runs holds
    assert table() == [*want, (6, 6.0, 1), (8, 8.0, 1)]


def test_a_second_crawl_reads_only_new_pages(spark, tmp_path):
    place, schema = str(tmp_path), "page_id long, html string"
    page = "<title>T</title><a href='x'>q</a><a href=\"y\">z</a><!-- <table id=\"s\"></table> -->"
    read = []
    for k, rows in enumerate([[(1, page), (2, None)], [(3, page)], []]):
        if rows:
            spark.createDataFrame(rows, schema).write.parquet(f"{place}/in/part={k}")
        q = landed.crawl(spark, f"{place}/in/*", schema, f"{place}/out", f"{place}/s")
        q.awaitTermination()
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert read == [2, 1, 0]
    assert sorted((r.page_id, r.title, r.n_links, r.n_tables) for r in spark.read.parquet(f"{place}/out").collect()) == [(1, "T", 1, 1), (2, None, 0, 0), (3, "T", 1, 1)]


# ------------------------------------------------------------------ regressions, lists


def test_fits_of_groups_equal_each_group_alone(spark):
    rng = np.random.default_rng(3)
    rows = [(g, *map(float, rng.normal(size=3))) for g in ("a", "b") for _ in range(40)] + [("c", 1.0, None, 2.0), (None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    fits = {r.g: r for r in model.ridge_fits(df, ["g"], {"one": (["x", "y"], "z"), "two": (["x"], "y")}, 0.5).collect()}
    for g in ("a", "b"):
        for name, features, label in (("one", ["x", "y"], "z"), ("two", ["x"], "y")):
            a, c = model.ridge_fit(df.where(F.col("g") == g), features, label, 0.5)
            assert np.allclose(fits[g][name], [a, *c.values()])
    assert fits["c"].one is None and fits["c"].two is None and len(fits[None].one) == 3


@pytest.mark.parametrize("name", ["estimated_ratings", "season_ratings", "games_as_of", "final_ranking", "team_decision"])
def test_sensitive_queries_on_more_rows(spark, name):
    sf = "/root/testdata/sf0.01"
    same(queries.queries()[name](spark, sf), oracle_sql()[name], connect(sf))


def test_listed_rows_keep_the_first_place(spark):
    df, ids = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string"), spark.createDataFrame([(2, 5), (2, 1), (9, 0), (1, 3)], "k int, place int")
    assert [tuple(r) for r in rel.listed(df, ids, "k", "place").orderBy("place", "v").collect()] == [(2, "b", 1), (2, "c", 1), (1, "a", 3)]


def test_final_scores_without_close_games_count_them_0(spark):
    rows = history.final_ranking(spark, "/root/testdata/sf0.001").collect()
    assert all(r.clutch is not None and r.score is not None for r in rows)


def test_state_of_late_rows_has_few_partitions(spark, tmp_path):
    cores, usual = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8 * cores)
    try:
        _run(spark, str(tmp_path), [(1, _day(0), 1.0, 1, 0), (2, _day(1), 2.0, 1, 0)], 0)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(8 * cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    stores = [x for x in (tmp_path / "s" / "state" / "0").iterdir() if x.name.isdigit()]
    assert len(stores) == 4 * cores  # was: as many as the session shuffles into, each loaded and written in every batch
