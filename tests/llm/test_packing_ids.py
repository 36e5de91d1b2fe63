"""Token ids of packing's shared word encoding against the library, over whole chunks of awkward texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from statloom.llm.packing import Lexicon

WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", "'s", "'LL", "'ſ", "क़", "क़", "각", "각", "́", "á", "\x1c", "\x1f", "\x85", "\xa0", "​", "\x00", "﻿", "١", "²", "\U0001f600", "ﬁ", "Ǆ", "ͅ", ";", "Å", "\t", "\n", "\r"]


def _text(rng):
    out = []
    for _ in range(rng.randint(0, 8)):
        r = rng.random()
        if r < 0.45:
            out.append("".join(rng.choice("abcdeXYZéÉßİıſKÅǅΣςжЙ") for _ in range(rng.randint(1, 5))))
        elif r < 0.6:
            out.append("".join(rng.choice("!-_.,:;'\"<|>/&#*`") for _ in range(rng.randint(1, 3))))
        elif r < 0.7:
            out.append(str(rng.randint(0, 999)))
        elif r < 0.78:
            out.append(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF)])))
        else:
            out.append(rng.choice(ODD))
        if rng.random() < 0.5:
            out.append(" ")
    return "".join(out)


def _differences(texts):
    stream, sizes, _ = Lexicon(WORDS, 2).encode(texts)
    want = [e.ids + [2] for e in Tokenizer.from_file(WORDS).encode_batch_fast(texts, add_special_tokens=False)]
    ends = np.cumsum(sizes)
    return [t for t, w, a, n in zip(texts, want, ends, sizes) if stream[a - n : a].tolist() != w]


@pytest.mark.parametrize("seed", range(8))
def test_chunks_of_awkward_texts(seed):
    rng = random.Random(seed)
    assert _differences([_text(rng) for _ in range(1500)]) == []


def test_texts_do_not_shift_their_neighbours():
    assert _differences(["<|endoftext|>", "the cat sat on a mat", "aİ bİ cİ", "<|endoftext|>x y"]) == []
