"""Token counts of documents from piece counts of distinct pre-tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTIAL_SCHEMA, block_index, document_sums, partial_sums

#: The pattern by which byte-level vocabularies of this family cut a text before their merges.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Salts for a pre-token, so that the blocks of a very common one are dealt to several tasks.
SALTS = 8
#: Pre-tokens whose counts a task remembers; beyond, it starts anew.
KNOWN = 1_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a .json file, once for each Python worker; no truncation, no padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core already
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _specials(path: str) -> tuple[bytes, ...]:
    return tuple(x.content.encode() for x in tokenizer(path).get_added_tokens_decoder().values())


def pre_tokens(text: bytes, path: str) -> list[str]:
    """A text's pre-tokens; an added token that occurs in the text is one of them, as the library reads it first."""
    s = text.decode()
    special = _specials(path)
    if not any(x in text for x in special):
        return _PIECES.findall(s)
    parts = regex.split("(" + "|".join(regex.escape(x.decode()) for x in special) + ")", s)
    return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else _PIECES.findall(part))]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_bytes (UTF-8) and n_tokens of its whole text, without any token ids being kept.

    ``vocabulary`` is the path of a byte-level BPE .json file, present on every executor. Each task turns its
    documents into blocks and lists, for each distinct pre-token of a block, the documents that hold it and how
    often. Those lists meet by pre-token; there a pre-token's pieces are counted once (in each of :data:`SALTS`
    parts at most) and multiplied into sums a block and document, which leave the task already added up.

    Null and empty texts have 0 tokens; null and repeated ids keep a row each. A long text is one document of its
    block however many bytes it has.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        library = tokenizer(vocabulary)

        def values(b: pa.RecordBatch) -> np.ndarray:
            words = b.column("token").to_pylist()
            if len(known) > KNOWN:
                known.clear()
            if new := list({w for w in words if w is not None and w not in known}):
                for i in range(0, len(new), 20000):
                    part = new[i : i + 20000]
                    known.update(zip(part, (len(e) for e in library.encode_batch_fast([w.decode() for w in part], add_special_tokens=False))))
            return np.array([0.0 if w is None else known[w] for w in words])[:, None]

        return partial_sums(batches, values)

    index = block_index(docs, id_col, text_col, lambda t: pre_tokens(t, vocabulary), lambda t, _: len(t))
    met = index.repartition(F.coalesce(F.xxhash64("token", F.pmod("block", F.lit(SALTS))), "block")).sortWithinPartitions("block")
    sums = document_sums(met.mapInArrow(count, PARTIAL_SCHEMA), 1)
    return sums.select(F.col("doc_id").alias(id_col), F.col("extra").cast("long").alias("n_bytes"), F.round(F.col("sums")[0]).cast("long").alias("n_tokens"))
