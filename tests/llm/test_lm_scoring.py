"""LM scoring: base scores and model scores against plain Python, sums of probabilities, and what the updates gain."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from statloom.llm import lm_scoring as lm

from .util import corpus, frame


def _counts(docs):
    return Counter(w for i, t in docs if lm.trains(i) for w in lm.tokens((t or "").encode()))


def test_base_score(spark):
    docs = [*enumerate(corpus(10, 60)), (5, "again"), (5, "again"), (None, "a b c"), (7777, "long " * 120_000)]
    c = _counts(docs)
    n = sum(c.values())
    base = lambda ws: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in ws)
    rows = lm.lm_score(frame(spark, docs, 4), chunk_bytes=100_000).collect()
    want = Counter((i, not lm.trains(i), len(w := lm.tokens((t or "").encode())), sum(x in c for x in w), n) for i, t in docs)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == want
    by = defaultdict(list)
    for i, t in docs:
        by[i].append(base(lm.tokens((t or "").encode())))
    for r in rows:
        assert min(abs(r.base_score - x) for x in by[r.doc_id]) < 1e-9 * max(1, abs(r.base_score)) and r.score < 0
    assert lm.lm_score(frame(spark, [])).count() == 0


def _plain_score(words, model, weights, c):
    """The model's log10 probability, token by token, from the same weights."""
    total = 0.0
    mask = model.buckets - 1
    big = (1 << 64) - 1
    ids = {w: xxhash.xxh64_intdigest(w) for w in words}
    for j, w in enumerate(words):
        one = ids[words[j - 1]] if j >= 1 else 1
        two = ids[words[j - 2]] if j >= 2 else 2
        both = (one * 0x9E3779B97F4A7C15 & big) ^ (two * 0xD6E8FEB86659FD93 & big)
        feats = [one ^ one >> 29, two ^ two >> 31, both ^ both >> 32]
        k, e = (int(x[0]) for x in model.place(np.array([ids[w]], np.uint64), np.array([lm.zlib.crc32(w)], np.uint32), np.array([lm.ending_class(w)], np.uint8)))
        z = model.class_bias.astype(float) + sum(weights[0][t][f >> 17 & mask] for t, f in enumerate(feats))
        p = np.exp(z[k]) / np.exp(z).sum()
        if k >= lm.SINGLE:
            own = (k + 1) * 0xBF58476D1CE4E5B9 & big
            z = model.entry_bias[k].astype(float) + sum(weights[1][t][((f ^ own) * 0x94D049BB133111EB & big) >> 37 & mask] for t, f in enumerate(feats))
            p *= np.exp(z[e]) / np.exp(z).sum()
        total += math.log10(p)
        if e == lm.ENTRIES - 1:
            total += math.log10(c[w] + 0.1) - model.rest[k]
    return total


def test_score_equals_plain_version_and_sums_to_one(spark):
    docs = [(i, t) for i, t in enumerate(corpus(12, 70)) if t is None or len(t) < 20_000]
    c = _counts(docs)
    made = lm.Corpus(frame(spark, docs, 3), "doc_id", "text", 50_000)
    weights = lm.train(made.stream, made.lexis)
    assert all(np.abs(w).max() > 0.1 for w in weights)
    texts = dict(docs)
    for r in made.scores(weights).collect():
        assert r.score == pytest.approx(_plain_score(lm.tokens((texts[r.id] or "").encode()), made.lexis, weights, c), rel=1e-4)
    # what the words of training have together, and one unseen word of each class, is one
    start, unseen = [b"a1", b"b2"], {}
    for i in range(3000):
        unseen.setdefault(lm.ending_class(w := b"unseen%d" % i), w)
    known = _plain_score(start, made.lexis, weights, c)
    total = sum(10 ** (_plain_score([*start, w], made.lexis, weights, c) - known) for w in [*c, *unseen.values()])
    assert len(unseen) == lm.CLASSES - lm.SINGLE and total == pytest.approx(1, abs=1e-3)


def test_every_update_raises_the_held_out_likelihood(spark):
    rng = random.Random(3)
    after = {w: rng.sample(range(300), 3) for w in range(300)}

    def text():
        w, out = rng.randrange(300), []
        for _ in range(150):
            out.append(f"w{w}")
            w = rng.choice(after[w])
        return " ".join(out)

    made = lm.Corpus(frame(spark, [text() for _ in range(600)], 4), "doc_id", "text", 20_000)
    held = F.crc32(F.col("id").cast("string")) % 10 == 0
    logs = []
    look = lambda w: logs.append(made.scores(w).where(held).agg(F.sum("score"), F.sum("base_score")).first())
    look(lm.new_weights(made.lexis))
    lm.train(made.stream, made.lexis, look)
    scores = [x[0] for x in logs]
    assert len(scores) == 1 + lm.UPDATES and scores == sorted(scores)
    assert scores[-1] > 0.8 * logs[0][1]


def test_model_is_not_made_smaller():
    assert lm.CLASSES >= 32 and lm.SINGLE >= 12 and lm.ENTRIES >= 32 and lm.UPDATES >= 4
    assert lm.make_lexis([(1, 1, 20, 10**9)], np.full(lm.CLASSES, 1e9), np.full(lm.CLASSES, 1e6)).buckets == lm.MOST


def test_scores_do_not_depend_on_the_layout(spark):
    docs = list(enumerate(corpus(21, 150)))
    rows = []
    for parts, chunk in ((1, 32 << 20), (7, 32 << 20), (3, 4000)):
        df = frame(spark, docs, parts)
        out = lm.lm_score(df, chunk_bytes=chunk)
        rows.append(sorted((r.doc_id, r.n_known, r.train_tokens, r.base_score, r.score) for r in out.collect()))
    assert rows[0] == rows[1] == rows[2]


def test_every_update_learns_from_documents():
    shares = [sum(lm.update_of(i) == k for i in range(4000)) for k in range(lm.UPDATES)]
    assert min(shares) > 800 and lm.update_of(None) in range(lm.UPDATES)
