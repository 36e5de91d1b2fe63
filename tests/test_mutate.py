import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.operators import mutate
from statloom.sources import files
from statloom.sources.schemas import TABLES

ROW = "k long, a string, b long"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 2)], ROW)
    new = spark.createDataFrame([(20, "B", 2), (30, "C", 3)], "b long, a string, k long").select("b", "a", "k")
    assert _rows(mutate.upsert(old, new, ["k"])) == [(1, "x", 1), (2, "B", 20), (3, "C", 30)]
    assert _rows(mutate.upsert(old, new, ["k"], update=["b"])) == [(1, "x", 1), (2, "y", 20), (3, "C", 30)]
    with pytest.raises(ValueError):
        mutate.upsert(old, new.union(new), ["k"])


@given(st.dictionaries(st.integers(0, 9), st.integers(0, 5)), st.dictionaries(st.integers(0, 9), st.integers(0, 5)))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_upsert_twice_changes_nothing(spark, old, new):
    o, n = (spark.createDataFrame([(k, str(v), v) for k, v in d.items()], ROW) for d in (old, new))
    once = mutate.upsert(o, n, ["k"])
    assert _rows(once) == _rows(mutate.upsert(once, n, ["k"])) == sorted((k, str(v), v) for k, v in {**old, **new}.items())


def test_replace_since(spark):
    d = [dt.date(2025, 1, i) for i in range(1, 6)]
    old = spark.createDataFrame([(1, d[0], 1), (1, d[3], 1), (2, d[3], 1), (2, None, 1)], "k long, d date, v long")
    new = spark.createDataFrame([(1, d[4], 2), (1, d[0], 9)], "k long, d date, v long")
    cut = F.lit(d[3])
    assert sorted((r.k, str(r.d), r.v) for r in mutate.replace_since(old, new, "d", cut).collect()) == [(1, "2025-01-01", 1), (1, "2025-01-01", 9), (1, "2025-01-05", 2), (2, "None", 1)]
    by_key = sorted((r.k, str(r.d), r.v) for r in mutate.replace_since_by_key(old, new, ["k"], "d", cut).collect())
    assert by_key == [(1, "2025-01-01", 1), (1, "2025-01-05", 2), (2, "2025-01-04", 1), (2, "None", 1)]


def test_backfill_and_fix_list(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "y", 2)], ROW)
    look = spark.createDataFrame([(1, "one"), (2, "two")], "k long, a string")
    assert _rows(mutate.backfill(df, look, ["k"], ["a"])) == [(1, "one", 1), (2, "y", 2)]
    fixes = spark.createDataFrame([(2,), (9,)], "k long")
    assert _rows(mutate.fix_list(df, fixes, look, "k", "a")) == [(1, None, 1), (2, "two", 2)]


def test_checks(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", None), (2, "z", 6)], ROW)
    assert [(r.k, r.n) for r in mutate.duplicates(df, ["k"]).collect()] == [(1, 2)]
    parent = spark.createDataFrame([(5,)], "p long")
    assert [r.b for r in mutate.orphans(df, "b", parent, "p").collect()] == [6]


def test_partitions_are_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2023-24", 1), (2, "2024-25", 2)], "k long, season string, b long")
    mutate.overwrite(df, path, "season")
    mutate.overwrite(spark.createDataFrame([(3, "2024-25", 3)], df.schema), path, "season")
    assert sorted((r.k, r.season) for r in spark.read.parquet(path).collect()) == [(1, "2023-24"), (3, "2024-25")]
    mutate.append(df.limit(1), path, "season")
    one = files.season_table(spark, path, "2023-24")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(season" in one._jdf.queryExecution().toString()
    mutate.export_csv(df, str(tmp_path / "csv"))
    assert files.delimited(spark, str(tmp_path / "csv"), df.schema).count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Country\tRegion  \nA land   \tASIA  \nB\t\n")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "a.txt"), "country string, region string", "\t").collect()] == [("A land", "ASIA"), ("B", None)]
    (tmp_path / "j.json").write_text('[{"One": {"Gross": "$4,5", "Weeks": 54}, "Two": {"Weeks": null}}]')
    got = sorted((r.title, r.attribute, r.value or "") for r in files.titled_json(spark, str(tmp_path / "j.json")).collect())
    assert got == [("One", "Gross", "$4,5"), ("One", "Weeks", "54"), ("Two", "Weeks", "")]
    (tmp_path / "p.html").write_text("<p>x</p>")
    assert files.pages(spark, str(tmp_path / "p.html")).first().html == "<p>x</p>"
    assert {c for t in TABLES.values() for c in t.key} <= {f for t in TABLES.values() for f in t.schema.fieldNames()}
