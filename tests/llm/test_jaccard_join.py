import numpy as np
import pyarrow as pa
import pytest

from statloom.llm.jaccard_join import NEAREST, _pairs, bitmaps, differing, jaccard_components, links, shingle_sets

from .util import components, corpus, frame


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = list(enumerate(corpus(seed)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, docs, 5)).collect()}
    assert got == components(docs)


def test_many_near_copies_and_their_copies(spark):
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(300):
        w = list(base)
        w[(k * 7) % 120] = f"v{k % 40}"
        docs.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, docs, 6)).collect()}
    assert got == components(docs)
    assert len({c for _, c in got.values()}) < 300


def test_links_at_the_limit():
    # 8 of 10 shingles in common: exactly 80 percent
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    none = np.zeros(1, np.uint64)
    assert links(a, b, none, none, 80)
    assert not links(a, b, none, none, 81)


def test_bitmaps_bound_the_difference():
    texts = [" ".join(str((i * k) % 977) for i in range(n)).encode() for k, n in ((3, 50), (5, 700), (7, 3000), (3, 60))]
    keys, ends = shingle_sets(texts, 5)
    sets = np.split(keys, ends[:-1])
    maps = bitmaps(keys, ends)
    for x, m in zip(sets, maps):
        for y, o in zip(sets, maps):
            assert differing(m, o) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (5, "A B C D E F"), (7, "")]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_components(frame(spark, docs, 2)).collect())
    assert [(a, n, -1 if c is None else c) for a, n, c in got] == [(-1, 0, -1), (-1, 2, -1), (1, 2, 1), (1, 2, 1), (5, 2, 1), (7, 0, 7)]
    assert jaccard_components(frame(spark, [])).count() == 0


def test_a_turn_over_a_crowded_tile_tries_a_few_partners_a_row():
    m = 400
    fold = np.random.default_rng(3).integers(0, 2**63, 4, dtype=np.uint64).tobytes()
    tile = pa.table({"sig": range(m), "key": [7] * m, "room": [100] * m, "n": [100] * m, "label": range(m), "fold": [fold] * m})
    pairs = [sum(b.num_rows for b in _pairs(80, nearest)(tile)) for nearest in (True, False)]
    assert 0 < pairs[0] <= NEAREST * m
    assert pairs[1] == m * (m - 1) // 2
