import pytest

from statloom.llm import decontamination
from statloom.llm.decontamination import decontaminate

from .util import corpus, frame, hits

ITEM = "item_id long, text string"


def _items(texts):
    long = [t for t in texts if t and len(t.split()) > 20]
    return [(0, long[0]), (1, long[1].upper()), (2, "one"), (3, None), (4, "  "), (5, " ".join(long[2].split()[:15])), (6, " ".join(long[2].split()[3:9])), (7, long[0]), (10, "a1 b2")]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_equals_brute_force(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", broadcast)
    texts = corpus(5, 60)  # one of them is long
    docs, items = list(enumerate(texts)), _items(texts)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in decontaminate(frame(spark, docs, 3), spark.createDataFrame(items, ITEM)).collect())
    want = sorted(hits(docs, items))
    assert got == want
    assert sum(w[2] for w in want) > 0


def test_repeated_rows_and_null_ids(spark):
    items = spark.createDataFrame([(1, "the quick brown fox")], ITEM)
    docs = [(1, "See: The-Quick brown FOX!"), (1, "See: The-Quick brown FOX!"), (None, "the quick brown fox"), (2, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items) for r in decontaminate(frame(spark, docs, 2), items).collect())
    assert got == [(-1, 4, 4, 1), (1, 5, 4, 1), (1, 5, 4, 1), (2, 0, 0, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEM)
    some = spark.createDataFrame([(1, "a b c")], ITEM)
    assert decontaminate(frame(spark, []), some).count() == 0
    assert [r.n_hit for r in decontaminate(frame(spark, ["a b c"]), none).collect()] == [0]
    assert [r.n_hit for r in decontaminate(frame(spark, ["a b c"]), spark.createDataFrame([(1, None)], ITEM)).collect()] == [0]
