import random
import re

import numpy as np
import pytest

from statloom.llm.substring_dedup import _cut, _word_bounds, substring_dedup

from .util import corpus, cut, frame


@pytest.mark.parametrize("seed, group", [(3, 20_000), (4, 3), (5, 0)])
def test_equals_brute_force(spark, seed, group):
    docs = list(enumerate(corpus(seed)))
    got = sorted((r.doc_id, r.n_words, r.n_removed, " ".join(r.text.encode().decode().split(" "))) for r in substring_dedup(frame(spark, docs, 7), group=group).collect())
    want = sorted(cut(docs))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    from .util import words

    assert [" ".join(words(g[3])) for g in got] == [w[3] for w in want]
    assert sum(w[2] for w in want) > 0


def test_repeats_inside_one_document_stay(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(1, f"{passage} x {passage}"), (2, f"a {passage} b {passage} c")]
    got = {r.doc_id: (r.n_removed, r.text) for r in substring_dedup(frame(spark, docs, 2)).collect()}
    assert got[1][0] == 0
    assert got[2] == (40, "a b c")


def test_white_space_and_other_columns_stay(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = [(1, passage), (2, f"first  line\n{passage}\nlast\tline "), (3, None)]
    got = {r.doc_id: r for r in substring_dedup(frame(spark, docs, 2), keep=("lang", "rest")).collect()}
    assert got[2].text == "first  line\nlast\tline"
    assert got[2].rest == "x" and got[3].text == ""


def test_copies_repeated_rows_null_ids_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(14))
    docs = [(4, t), (4, t), (9, t), (None, t), (8, "w0 w1"), (2, "w0 w1")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup(frame(spark, docs, 3)).collect())
    assert got == [(-1, 14, 0), (2, 2, 0), (4, 14, 0), (4, 14, 0), (8, 2, 0), (9, 14, 14)]
    assert substring_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("group", [20_000, 50])
def test_a_passage_in_very_many_documents(spark, group):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for k in range(3000):
        own = [f"{rng.choice('xyz')}{rng.randrange(50_000)}" for _ in range(rng.randrange(5, 15))]
        at = rng.randrange(len(own))
        w = own[:at] + passage[: rng.choice([12, 13, 20, 30])] + own[at:]
        docs.append((k, " ".join(w * rng.choice([1, 1, 1, 3]))))
    docs.append((5000, "u v " * 20_000 + " ".join(passage)))  # the same few windows over and over
    docs.append((5001, "u v " * 15_000))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(frame(spark, docs, 9), group=group).collect()}
    assert got == {i: (n, gone) for i, n, gone, _ in cut(docs)}
    assert got[5001] == (30_000, 30_000)


def test_cutting_works_on_runs_of_words_not_word_by_word():
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice("ab \t\n\x0b\r\x1cé ") for _ in range(rng.randrange(40))).encode()
        bounds = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
        assert list(zip(*(x.tolist() for x in _word_bounds(text)))) == bounds
        gone = np.array([rng.random() < 0.4 for _ in bounds], bool)
        kept = _cut(text, gone)
        assert kept.split() == [text[a:z] for (a, z), g in zip(bounds, gone) if not g]
        assert all(text[a:d] in kept for (a, _), (_, d), g, h in zip(bounds, bounds[1:], gone, gone[1:]) if not g and not h)
