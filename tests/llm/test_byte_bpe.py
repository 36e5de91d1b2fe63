import base64
import random

import public_tokenizers
import pytest
import tiktoken

from statloom.llm import byte_bpe
from statloom.llm.byte_bpe import Bpe, bpe_decode, bpe_encode

from .util import corpus, frame

PATTERN = public_tokenizers.PATTERN
PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]
KINDS = ["a", "b", " ", "  ", "\n", "'", "'re", "'ll", "é", "word", "=", "==", "-", "1", "22", "　", "\x85", "\xa0", "\x1c", "ß", "日本", "🙂", "<|endoftext|>", "\t", "\r\n", "́"]


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return memoryview(raw).cast("I").tolist()


@pytest.mark.parametrize("path", PATHS)
def test_every_rank_is_what_its_bytes_encode_to(path):
    """The property on which joins rest."""
    bpe = Bpe(path, PATTERN)
    assert all(ids(bpe.match(b)) == [i] for b, i in bpe.ranks.items())


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize(("leaf", "most"), [(1, 2), (3, 4), (8, 5), (4096, 48)])
def test_random_texts_equal_the_library(monkeypatch, path, leaf, most):
    monkeypatch.setattr(byte_bpe, "LEAF", leaf)
    monkeypatch.setattr(byte_bpe, "LEAF_BYTES", most)
    monkeypatch.setattr(byte_bpe, "LEAF_IDS", leaf)
    bpe, lib, rng = Bpe(path, PATTERN), library(path), random.Random(leaf)
    for _ in range(1500):
        t = "".join(rng.choice(KINDS) * rng.choice([1, 1, 1, 2, 5, 17]) for _ in range(rng.randrange(25)))
        got = bpe.encoded(t)
        assert ids(got) == lib.encode_ordinary(t), repr(t)
        assert bpe.decoded(got) == t.encode()


def test_any_two_halves_join_to_the_whole():
    bpe, rng = Bpe(PATHS[0], PATTERN), random.Random(5)
    for _ in range(400):
        b = "".join(rng.choice(["ab", "=", "e", "é", "the", "日"]) for _ in range(rng.randrange(2, 30))).encode()
        k = rng.randrange(len(b) + 1)
        assert bpe.joined(bpe.merged(b[:k]).tobytes(), bpe.merged(b[k:]).tobytes()) == bpe.merged(b).tobytes()
        assert bpe._scanned(b) == bpe._heaped(b)


def test_parts_join_at_any_cut():
    bpe, rng = Bpe(PATHS[0], PATTERN), random.Random(6)
    for _ in range(400):
        t = "".join(rng.choice(KINDS) for _ in range(rng.randrange(2, 30)))
        k = rng.randrange(1, len(t))
        whole, made = bpe.part(t, 0, len(t)), bpe.join(t, bpe.part(t, 0, k), bpe.part(t, k, len(t)))
        assert made.ids == whole.ids and sum(made.lengths) == len(t) and sum(made.sizes) == len(made.ids)


@pytest.mark.parametrize("text", ["=" * 60_001, "ab" * 30_000, " " * 50_001 + "x", "日" * 20_000, "'" * 20_001, "x " * 30_000, "\n" * 30_000, "a\n\n b\t" * 9_000])
def test_long_texts_without_breaks(text):
    bpe = Bpe(PATHS[0], PATTERN)
    got = bpe.encoded(text)
    assert ids(got) == library(PATHS[0]).encode_ordinary(text) and bpe.decoded(got) == text.encode()


def test_tables(spark):
    docs = [*enumerate(corpus(8, 60)), (None, "null id"), (3, "twice"), (3, "twice")]
    lib = library(PATHS[0])
    out = bpe_decode(bpe_encode(frame(spark, docs, 4), PATHS[0], PATTERN), PATHS[0], PATTERN)
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out.collect()), key=key)
    assert got == sorted(((k, lib.encode_ordinary(t or ""), (t or "").encode()) for k, t in docs), key=key)
    assert bpe_encode(frame(spark, []), PATHS[0], PATTERN).count() == 0


def test_decoding_parts_of_texts_and_nulls(spark):
    lib = library(PATHS[0])
    cut = lib.encode_ordinary("x 🙂")[:-1]  # inside a character
    rows = spark.createDataFrame([(1, cut), (2, None), (3, [])], "k long, ids array<int>")
    assert {r.k: bytes(r.decoded) for r in bpe_decode(rows, PATHS[0], PATTERN).collect()} == {1: lib.decode_bytes(cut), 2: b"", 3: b""}
