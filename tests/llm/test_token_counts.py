import random

import public_tokenizers
from tokenizers import Tokenizer

from statloom.llm.token_counts import pre_tokens, token_counts

from .util import corpus, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    docs = list(enumerate([*corpus(6, 60), "it's we'll I'd  x\n\n y z\x1c\x85q", "日本語 text　here 12³45", "<|endoftext|>", "a<|endoftext|>  b"]))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(frame(spark, docs, 4), PATH).collect())
    assert got == [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for k, t in docs]


def test_pieces_add_up_on_random_text():
    library, rng = Tokenizer.from_file(PATH), random.Random(0)
    kinds = "ab Zé'sßñ1²½ \n\t  \x1c\x1f\x85,.!?<|>$\U0001f600́"
    for _ in range(1500):
        t = "".join(rng.choice(kinds) for _ in range(rng.randrange(25)))
        assert sum(len(library.encode(w, add_special_tokens=False)) for w in pre_tokens(t.encode(), PATH)) == len(library.encode(t, add_special_tokens=False)), repr(t)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts(frame(spark, [(1, "a b"), (1, "a b"), (None, "c"), (2, None)], 2), PATH).collect())
    assert got == [(-1, 1), (1, 2), (1, 2), (2, 0)]
    assert token_counts(frame(spark, []), PATH).count() == 0

