"""Every query of the subpackage runs on the smallest tables, and its digest columns are what the contract says."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statloom.llm import queries
from statloom.llm.lm_scoring import trains
from statloom.llm.sharding import shard_rows

from ..oracle import SF
from .util import frame


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def test_op1(spark):
    rows = queries.op1_html_extraction(spark, SF).collect()
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    assert sorted(r.page_id for r in rows) == sorted(pages)
    assert all(r.n_chars == len(r.text) and ("<" not in r.text) for r in rows)
    assert all(r.text.count("\n") + 1 == pages[r.page_id].count("<p>") + pages[r.page_id].count("<h1>") for r in rows)


def test_op4(spark, texts):
    rows = queries.op4_lm_scoring(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == (not trains(r.doc_id)) and r.n_tokens == len((texts[r.doc_id] or "").encode().split()) + 1 for r in rows)


def test_op5(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in queries.op5_packing(spark, SF).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 4096


def test_op6(spark, texts):
    rows = queries.op6_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shards = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        shards[r.shard].append(r.slot)
    assert set(shards) == set(range(24)) and len({len(x) for x in shards.values()}) <= 2
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())


def test_op6_takes_any_columns(spark):
    df = frame(spark, [("x" * (k % 3)) for k in range(50)] + [None, "long " * 50_000])
    for c in ("_at", "_row", "row_number", "shard", "slot", "at", "key_0"):
        df = df.withColumn(c, df.doc_id)
    rows = shard_rows(df, 4, ["text", "doc_id"]).collect()
    assert sorted(r._row for r in rows) == list(range(52)) and sorted(r.row_number for r in rows) == list(range(52))
    assert all(0 <= r.shard < 4 for r in rows) and rows[0].__fields__.count("shard") == 1


def test_op7(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    rows = queries.op7_token_counts(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 512)


def test_op13(spark, texts):
    import base64
    import hashlib

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.op13_byte_bpe(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
