"""Byte-level BPE of whole texts by a monoid tree reduction, and back."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import text_chunks

#: Code points of a text that are encoded without halving, bytes of one match, and ids that are decoded without halving.
LEAF, LEAF_BYTES, LEAF_IDS = 4096, 48, 4096
#: Code points that the pattern may look at from the start of a match (the longest contraction).
REACH = 3
#: Texts of a generation whose ids a worker remembers, and their greatest length.
KNOWN, LONG = 250_000, 64
#: Bytes of an id; rows of ids are kept as unsigned 32-bit numbers.
ID = 4


#: White space but spaces and line feeds, which stand alone more often than not.
_RARE = regex.compile(r"[\t\v\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Part(NamedTuple):
    """A stretch of a text, encoded as if it stood alone.

    It falls into units, which are one match each, or the matches from a space up to the next: their code points, the
    bytes of their ids, and all ids.
    """

    start: int
    end: int
    lengths: array
    sizes: array
    ids: bytes


def compiled(pattern: str) -> regex.Pattern:
    """``pattern`` with \\s as Unicode's White_Space, which the rank files' libraries mean by it (this one has four control characters more)."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _middle(n: int) -> int:
    """The greatest power of two below n: long runs of one character fall apart into the tokens that they have as a whole."""
    return 1 << (n - 1).bit_length() - 1


class _Known(dict):
    """The ids of the texts so far, in two generations: what a full one holds is kept only if it is met again in the next."""

    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = self.work(text)
        if len(text) <= LONG:
            if len(self) >= KNOWN:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Bpe:
    """The vocabulary of a rank file. Every rank must be what its own bytes encode to, as in vocabularies made by merges.

    Joins rest on one property of such merges: a row of ids is the encoding of its bytes if each two neighbours are the
    encoding of theirs. (Up to the first merge across a border of two neighbours, both evolve as they do as a pair, so
    that merge would be made in the pair as well.) So a window around a cut is encoded anew, and once its first id is
    the left half's own at that place and its last id the right half's own, no id outside of it can change.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = compiled(pattern)
        self.known = _Known(lambda word: self.match(word.encode()))
        self.spaced = _Known(lambda rest: self.match(b" " + rest.encode()) if rest.isalpha() else b"".join(map(self.known.__getitem__, self.pattern.findall(" " + rest))))

    # ------------------------------------------------------------ one match

    def _scanned(self, b: bytes) -> list[int]:
        """Where the parts of a few bytes begin, and the end: merge by rank, leftmost first, until no two neighbours make a token."""
        get, none = self.ranks.get, 1 << 32
        at, pairs = list(range(len(b) + 1)), [get(b[i : i + 2], none) for i in range(len(b) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del at[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(b[at[i] : at[i + 2]], none)
            if i:
                pairs[i - 1] = get(b[at[i - 1] : at[i + 1]], none)
        return at

    def _heaped(self, b: bytes) -> list[int]:
        """The same for many bytes, by a heap of pairs over linked parts."""
        ranks, n = self.ranks, len(b)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != k:
                continue  # one of the two has been merged otherwise
            after[i], alive[j] = k, 0
            if k < n:
                before[k] = i
                if (r := ranks.get(b[i : after[k]])) is not None:
                    heapq.heappush(heap, (r, i, after[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(b[h:k])) is not None:
                heapq.heappush(heap, (r, h, k))
        return [*(i for i in range(n) if alive[i]), n]

    def merged(self, b: bytes) -> array:
        """The ids of a stretch of bytes."""
        at = self._scanned(b) if len(b) <= LEAF_BYTES else self._heaped(b)
        return array("I", [self.ranks[b[i:k]] for i, k in zip(at, at[1:])])

    def joined(self, left: bytes, right: bytes) -> bytes:
        """The ids of two neighbouring stretches of one match, from the ids of each."""
        if not left or not right:
            return left + right
        x, y = memoryview(left).cast("I"), memoryview(right).cast("I")
        a, z = 1, 1
        while True:
            window = self.merged(self.decoded(left[-a * ID :]) + self.decoded(right[: z * ID]))
            first, last = a == len(x) or window[0] == x[-a], z == len(y) or window[-1] == y[z - 1]
            if first and last:
                return left[: -a * ID] + window.tobytes() + right[z * ID :]
            a, z = a if first else min(len(x), 2 * a), z if last else min(len(y), 2 * z)

    def match(self, b: bytes) -> bytes:
        """The ids of the bytes of one match: halves, joined."""
        if len(b) <= LEAF_BYTES:
            return self.merged(b).tobytes()
        m = _middle(len(b))
        return self.joined(self.match(b[:m]), self.match(b[m:]))

    # ------------------------------------------------------------ a text

    def _leaf(self, text: str, start: int, end: int) -> Part:
        """Encode without halving: as words with the space before them, whose ids are remembered; where other white space may meet a space, match by match."""
        leaf = text[start:end]
        if "  " in leaf or " \n" in leaf or "\n " in leaf or _RARE.search(leaf):
            words = self.pattern.findall(leaf)
            lengths, ids = array("I", map(len, words)), list(map(self.known.__getitem__, words))
        else:
            first, *rest = leaf.split(" ")
            head = self.pattern.findall(first)
            lengths = array("I", [*map(len, head), *map((1).__add__, map(len, rest))])
            ids = [*map(self.known.__getitem__, head), *map(self.spaced.__getitem__, rest)]
        return Part(start, end, lengths, array("I", map(len, ids)), b"".join(ids))

    def part(self, text: str, start: int, end: int) -> Part:
        if end - start <= LEAF:
            return self._leaf(text, start, end)
        cut = start + _middle(end - start)
        return self.join(text, self.part(text, start, cut), self.part(text, cut, end))

    def join(self, text: str, left: Part, right: Part) -> Part:
        """Two neighbouring parts of a text as one.

        A unit of the left part stands if it ended before the cut and none of the characters it looked at lay beyond.
        From the first that may not stand, the text is matched anew over ever more units of the right part, until
        a match ends where a unit of the right part ends and has seen all it looks at: from there on all is as before.
        """
        cut, k, at = left.end, len(left.lengths), left.end
        while k and (at == cut or at - left.lengths[k - 1] + REACH > cut):
            k -= 1
            at -= left.lengths[k]
        n, most = 2, len(right.lengths)
        while True:
            n = min(n, most)
            ends, to = {cut: 0}, cut
            for i in range(n):
                to += right.lengths[i]
                ends[to] = i + 1
            words, here = [], at
            for m in self.pattern.finditer(text, at, to):
                words.append(m.group())
                here = m.end()
                if here in ends and here < to and m.start() + REACH <= to:
                    break
            else:
                here = to
            if here < to or n == most:
                break
            n *= 2
        r = ends[here]
        if len(words) == 1 and r == 1 and k == len(left.lengths) - 1 and " " not in words[0][1:]:  # one match across the cut: its two rows of ids are joined
            a, z = left.sizes[k], right.sizes[0]
            ids = [self.joined(left.ids[len(left.ids) - a :], right.ids[:z])]
        else:
            ids = list(map(self.known.__getitem__, words))
        drop, skip = sum(left.sizes[k:]), sum(right.sizes[:r])
        return Part(
            left.start,
            right.end,
            left.lengths[:k] + array("I", map(len, words)) + right.lengths[r:],
            left.sizes[:k] + array("I", map(len, ids)) + right.sizes[r:],
            left.ids[: len(left.ids) - drop] + b"".join(ids) + right.ids[skip:],
        )

    def encoded(self, text: str) -> bytes:
        """The ids of a whole text."""
        return self.part(text, 0, len(text)).ids

    def decoded(self, ids: bytes) -> bytes:
        """The bytes of a row of ids, concatenated up the tree of its halves."""
        n = len(ids) // ID
        if n <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        m = _middle(n) * ID
        return self.decoded(ids[:m]) + self.decoded(ids[m:])


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> Bpe:
    """A vocabulary, once for each Python worker."""
    return Bpe(path, pattern)


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the id and ``ids`` array<int>, what the rank file ``vocabulary`` (present on every executor) makes of the whole text.

    Each match of ``pattern`` is encoded on its own, without special tokens; its matches must cover any text, look at one
    character past their end at most or at :data:`REACH` from their start, hold no space after other than white space, and
    take a space with the letters after it. A text is cut into halves down to
    :data:`LEAF` code points and its parts are joined up the tree; a match is cut and joined likewise. A node keeps 4
    bytes an id and 8 a match, so a task holds about 8 MB of texts (or one longer text) and small multiples of them.
    No shuffle: a lost task is done again by itself.

    Null and empty texts have no ids; null and repeated ids keep a row each; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary, pattern)
        for b in text_chunks(batches, 1):
            rows = [bpe.encoded(t or "") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]) // ID
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, pattern: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with one column more, the bytes of the ids (null ids: none).

    Bytes, since the ids of part of a text may end inside a character. An id that the vocabulary lacks is an error.
    """
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(vocabulary, pattern)
        for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            rows = [x.values.to_numpy().astype(np.uint32).tobytes() if x.is_valid else b"" for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(map(bpe.decoded, rows)), pa.binary())], names=[*b.schema.names, to])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add(to, BinaryType()))
