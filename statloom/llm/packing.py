"""Order-preserving packing of documents' tokens into sequences by dynamic programming."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, text_chunks
from .token_counts import _specials, tokenizer

#: Tokens that one dynamic programme spans, at least; only its last sequence may be short.
BLOCK_TOKENS = 1 << 21
#: Penalties in padding tokens: to cut a document after a sentence, and inside a sentence.
SENTENCE_CUT, INNER_CUT = 32, 512
#: Where a stretch without sentence ends is longer, it may be cut at every so many tokens.
STRIDE = 256
#: Entries of a worker's word cache, after which it starts anew.
CACHE = 500_000

_ENDS = frozenset(".!?…。！？")
#: Letters that normal form and lower case leave single letters and that join with no neighbour.
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x530)) if unicodedata.category(c)[0] == "L" and unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha())
_PLAIN = re.compile(f"[{_LETTERS}!-&(-@\\[-`{{-~]+")
_RUNS = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class Lexicon:
    """A worker's words so far, numbered, with their ids in one row: word i has ``length[i]`` ids from ``first[i]``."""

    def __init__(self, path: str, end_id: int):
        self.library, self.special, self.end_id = tokenizer(path), [x.decode() for x in _specials(path)], end_id
        size = self.library.get_vocab_size()
        self.last = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.names: defaultdict = defaultdict()
        self.names.default_factory = self.names.__len__
        self.names[""]  # the end of a text
        self.whole: set[str] = set()
        self.table, self.first = np.array([self.end_id], "<u4"), np.zeros(1, np.int64)
        self.length, self.ending = np.ones(1, np.int64), np.zeros(1, bool)

    def learn(self) -> None:
        """Encode the words that were numbered since.

        Words of plain letters, digits and marks go many in one text: their runs (letters, a digit, marks) are known
        beforehand, and each ends in a token that says so, by which the ids are parted again. All others, among them
        whole texts, words with an apostrophe, and letters that the library may change, are encoded one by one.
        """
        old = len(self.length)
        words = list(islice(self.names, old, None))
        runs = [1 if w.isalpha() and w.isascii() else len(_RUNS.findall(w)) if _PLAIN.fullmatch(w) and w not in self.whole else 0 for w in words]
        order = [k for k, r in enumerate(runs) if r]
        groups = [order[i : i + 500] for i in range(0, len(order), 500)]
        alone = [k for k, r in enumerate(runs) if not r]
        first, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at, tables = len(self.table), [self.table]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join([words[k] for k in g]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            at_run = np.cumsum([runs[k] for k in group]) - 1
            if len(ends) != at_run[-1] + 1:  # not the runs that were expected
                alone += group
                continue
            stop = ends[at_run]
            length[group] = np.diff(np.concatenate([[0], stop]))
            first[group] = at + stop - length[group]
            at += len(ids)
            tables.append(ids)
        for k, e in zip(alone, self.library.encode_batch_fast([words[k] for k in alone], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            first[k], length[k] = at, len(ids)
            at += len(ids)
            tables.append(ids)
        self.table = np.concatenate(tables)
        self.first, self.length = np.concatenate([self.first, first]), np.concatenate([self.length, length])
        self.ending = np.concatenate([self.ending, np.array([w[-1] in _ENDS for w in words], bool)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' ids in one row, each text followed by the end id; tokens of each text; places where a sentence ends.

        The vocabulary drops white space, so a text's ids are those of its white-space separated words in a row. Each
        word is encoded once and the row put together in numpy. Texts that hold an added token's string, or control
        characters on which Python and the library differ, go to the library whole.
        """
        if len(self.names) > CACHE:
            self.clear()
        rows = []
        for t in texts:
            low = t.lower() if t.isascii() else t  # fewer words; the vocabulary lower-cases anyway
            if any(x in low for x in self.special) or _ODD_SPACE.search(t):
                self.whole.add(t)
                w = [t]
            else:
                w = low.split()
            w.append("")
            rows.append(np.fromiter(map(self.names.__getitem__, w), np.int64, len(w)))
        if len(self.names) > len(self.length):
            self.learn()
        ids = np.concatenate([np.zeros(0, np.int64), *rows])
        each, first = self.length[ids], self.first[ids]
        ends = np.cumsum(each)
        stream = self.table[np.repeat(first - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum([len(r) for r in rows], dtype=np.int64) - 1
        return stream, np.diff(np.concatenate([np.zeros(1, np.int64), ends[last]])), ends[self.ending[ids]]


@lru_cache(maxsize=2)
def lexicon(path: str, end_id: int) -> Lexicon:
    return Lexicon(path, end_id)


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int) -> np.ndarray:
    """The places to cut, of those in ``at`` (ascending from 0; the last is the end), at most ``length`` apart.

    Minimises the sum over windows of padding (length - window) plus the penalty of the cut that ends it. With
    f(j) the least cost up to place j, f(j) = min over i of f(i) + at(i), plus length - at(j) + penalty(j): a
    window minimum, kept in a queue whose values ascend, so every place enters and leaves it once.
    """
    places, costs = at.tolist(), penalty.tolist()
    back = [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(places)):
        p = places[j]
        while places[queue[0][1]] < p - length:
            queue.popleft()
        value, back[j] = queue[0]
        value += length + costs[j]  # f(j) + at(j)
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out = [len(places) - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return at[out[::-1]]


def candidates(sizes: np.ndarray, inner: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places where a stream of documents may be cut, with penalties: document ends, sentence ends, and inner places."""
    ends = np.cumsum(sizes)
    at = np.concatenate([[0], ends, inner])
    cost = np.concatenate([[0], np.zeros(len(ends)), np.full(len(inner), float(SENTENCE_CUT))])
    order = np.lexsort((cost, at))
    at, cost = at[order], cost[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])
    at, cost = at[first], cost[first]
    wide = np.flatnonzero(np.diff(at) > stride)
    if len(wide):
        more = np.concatenate([np.arange(at[i] + stride, at[i + 1], stride) for i in wide])
        at, cost = np.concatenate([at, more]), np.concatenate([cost, np.full(len(more), float(INNER_CUT))])
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


_SCHEMA = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack_documents(docs: DataFrame, vocabulary: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents' token streams into sequences of at most ``length`` tokens; one row a piece.

    A document's tokens are those of ``vocabulary`` (a .json file on every executor, words separated by white space
    that it drops) without special tokens, then ``end_id``. Each scan partition packs its documents in the order in
    which they stand, in blocks of about :data:`BLOCK_TOKENS`; within a block dynamic programming picks the cuts
    with the least padding plus truncation penalties (document ends are free, sentence ends cost a little, places
    inside a sentence much). Nothing is shuffled: a block needs only its own documents, padding arises at sentence
    ends and once a block, and a lost task packs its partition again alike.

    Null text counts as empty: such a document is its ``end_id`` alone. Repeated rows are packed each. A text longer
    than a block makes a longer block. Returns id, start (tokens of the document before the piece), length,
    doc_tokens, sequence_id (unique; partition and running number), offset in the sequence (gapless from 0) and
    ids (little-endian uint32).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        names: list = []
        streams: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        sentences: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            sizes, stream = np.concatenate(counts), np.concatenate(streams)
            at, cost = candidates(sizes, np.concatenate(sentences))
            cuts = best_cuts(at, cost, length)
            ends = np.cumsum(sizes)
            breaks = np.union1d(np.append(ends, 0), cuts)
            left, right = breaks[:-1], breaks[1:]
            doc = np.searchsorted(ends, left, side="right")
            window = np.searchsorted(cuts, left, side="right") - 1
            who = pa.array(names, pa.int64())
            for i in range(0, len(left), 1000):
                s = slice(i, i + 1000)
                yield pa.RecordBatch.from_arrays([who.take(pa.array(doc[s])), pa.array(left[s] - (ends - sizes)[doc[s]]), pa.array((right - left)[s]), pa.array(sizes[doc[s]]), pa.array(sequence + window[s]), pa.array(left[s] - cuts[window[s]]), packed(stream[left[i] : right[s][-1]], right[s] - left[i])], schema=_SCHEMA)
            sequence += len(cuts) - 1
            held = 0
            for x in (names, streams, counts, sentences):
                x.clear()

        for b in text_chunks(batches, 1, 4 << 20):
            stream, sizes, inner = lexicon(vocabulary, end_id).encode([x or "" for x in b.column(1).to_pylist()])
            names += b.column(0).to_pylist()
            streams.append(stream)
            counts.append(sizes)
            sentences.append(inner + held)
            held += len(stream)
            if held >= BLOCK_TOKENS:
                yield from flush()
        if names:
            yield from flush()

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return out.withColumnRenamed("id", id_col)
