import os
import random

import corpus_pipeline as pipeline
import pytest

from .util import components, corpus, cut, hits, words
from .test_small_ops import _base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    texts = [t if t is None else t[:6000] for t in corpus(11, 70)]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    rows += [(500, texts[0], None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(d / "documents.parquet"))
    long = [t for t in texts if t and len(t.split()) > 40]
    spark.createDataFrame([(1, long[3]), (2, "zz yy")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_every_stage_equals_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, step) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        step(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == pipeline.COLUMNS
            after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            assert set(after) == {i for i, t in before.items() if not _base(t)[5]}
        elif name == "jaccard_join":
            assert set(after) == {i for i, (_, c) in components(list(before.items())).items() if i == c}
        elif name == "substring_dedup":
            assert {i: " ".join(words(t)) for i, t in after.items()} == {i: kept for i, _, _, kept in cut(list(before.items()))}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "decontamination":
            assert set(after) == {i for i, n, hit, _ in hits(list(before.items()), items) if not (hit and 20 * hit >= n)}
            assert len(after) < len(before)
        else:
            rows = docs.collect()
            assert {r.doc_id for r in rows} == set(before)
            assert all(len(r.ids) == 4 * r.length <= 4 * 4096 for r in rows)


def test_run_and_empty_documents(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    os.symlink(f"{folder}/benchmark.parquet", tmp_path / "benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def _prose(seed, n=40):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n)]


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "en", h, len(t)) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def _two_stages(spark, rows):
    out = pipeline.keep_quality(spark, _table(spark, rows), SF)
    return {(r.doc_id, r.text) for r in pipeline.one_of_each(spark, out, SF).collect()}


def test_one_of_many_near_copies_stays(spark):
    lines = [_prose(k, 12) for k in range(8)]
    rows = [(i, "\n".join(" ".join([*w, _prose(1000 + i, 1)[0]] if k == 7 else w) for k, w in enumerate(lines)), "a") for i in range(60)]
    assert _two_stages(spark, rows) == {rows[0][:2]}


def test_boilerplate_is_removed_and_depleted_rows_go(spark):
    notice = [" ".join(_prose(2000 + k, 45)) for k in range(2)]
    menu = [(i, "\n".join([*notice, " ".join(_prose(3000 + i, 20))]), "b") for i in range(30)]
    rich = [(50 + i, "\n".join([notice[i % 2], " ".join(_prose(5000 + i, 120))]), "b") for i in range(20)]
    own = [(100 + i, " ".join(_prose(4000 + i, 60)), "b") for i in range(10)]
    assert _two_stages(spark, menu + rich + own) == {(i, t.split("\n")[1]) for i, t, _ in rich} | {r[:2] for r in own}


def test_null_and_shared_ids(spark, tmp_path):
    bad, passage = "no " * 5, " ".join(_prose(1, 60))
    good = [" ".join(_prose(10 + k)) for k in range(4)]
    kept = pipeline.keep_quality(spark, _table(spark, [(None, bad, "a"), (None, good[0], "a"), (7, bad, "a"), (7, good[1], "a")]), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("None", good[0]), ("7", good[1])])

    rows = [(1, good[0], "a"), (5, good[0] + " x", "a"), (5, good[1], "a"), (None, good[0] + " y", "a"), (None, good[2], "a"), (None, good[2], "a"), (8, good[3], "a"), (8, good[3], "a")]
    left = sorted((str(r.doc_id), r.text) for r in pipeline.one_of_each(spark, _table(spark, rows), SF).collect())
    assert left == sorted([("1", good[0]), ("5", good[1]), ("None", good[2]), ("8", good[3])])

    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, passage, "a"), (None, good[0], "a"), (3, passage, "a"), (3, good[1], "a")]
    clean = pipeline.drop_contaminated(spark, _table(spark, rows), str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text) for r in clean) == sorted([("None", good[0]), ("3", good[1])])


def test_entry_lists_the_operators():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_no_cut_hides_a_benchmark_passage(spark, tmp_path):
    item = _prose(77, 20)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first, rest = " ".join(item[:10]), " ".join(item[10:])
    rows = [(i, "\n".join([" ".join(_prose(6000 + i, 60)), first, rest]), "c") for i in range(20)] + [(50 + i, "\n".join([" ".join(_prose(7000 + i, 60)), first]), "c") for i in range(5)]
    kept = pipeline.keep_quality(spark, _table(spark, rows), str(tmp_path))
    assert {r.text for r in kept.where("doc_id < 50").collect()} == {t for i, t, _ in rows if i < 50}  # whole, for decontamination to see
    assert not [r for r in kept.where("doc_id >= 50").collect() if first in r.text]  # boilerplate as before
    assert pipeline.drop_contaminated(spark, kept, str(tmp_path)).where("doc_id < 50").count() == 0
    docs = _table(spark, rows)
    for _, step in pipeline.STAGES[:4]:
        docs = step(spark, docs, str(tmp_path))
    assert not [r for r in docs.collect() if set(r.text.split()) & set(item)]


def test_long_texts_go_through_whole(spark, tmp_path):
    long = " ".join(_prose(88, 60_000))
    spark.createDataFrame([(1, "zz yy")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = _table(spark, [(1, long, "a"), (2, " ".join(_prose(89, 50)), "a")])
    for _, step in pipeline.STAGES[:4]:
        docs = step(spark, docs, str(tmp_path))
    assert {r.doc_id: len(r.text) for r in docs.collect()}[1] == len(long)
