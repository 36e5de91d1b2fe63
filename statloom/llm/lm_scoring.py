"""A hashed maximum-entropy language model with class-factored softmax, trained by distributed gradient updates on Spark."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, packed, release, runs, stage, text_chunks, tidy

#: Classes: the most frequent words have one each, all others share the rest by their ending.
CLASSES, SINGLE = 48, 12
#: Entries of the softmax within a class: its most frequent words, and one for all others.
ENTRIES = 32
#: Feature templates (previous word, word before it, both).
TEMPLATES = 3
#: Feature buckets of a template follow the training tokens: one for so many, a power of two within these bounds.
#: The upper bound holds the model's two tables to 32 MB, so that each task can have them whole.
TOKENS_A_BUCKET, FEWEST, MOST = 64, 1024, 32_768
#: Gradient updates; each sees its own share of the training documents, by a hash of their ids, all together see every document once.
UPDATES = 4
#: Step of an update (with its counts' curvature), smoothing of that curvature, and bound of a weight, so that exponentials stay finite.
RATE, DAMP, BOUND = 0.7, 3.0, 8.0
#: Bytes of text that a task tokenises at a time (or one longer text) into a chunk for each update, and positions scored at a time.
CHUNK, STEP = 32 << 20, 32_768
#: Buckets whose counts travel together in an update.
BLOCK = 256

END = b""


def trains(doc_id: object) -> bool:
    """Whether a document belongs to the training part; a null id has an empty text and is held out."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


def update_of(doc_id: object) -> int:
    """The update that learns from a document: by its id alone, whatever table or file it lies in."""
    return xxhash.xxh32_intdigest(b"" if doc_id is None else str(doc_id).encode()) % UPDATES


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def ending_class(word: bytes) -> int:
    return SINGLE + zlib.crc32(word[-2:]) % (CLASSES - SINGLE)


# ---------------------------------------------------------------- token streams

_STREAM = "chunk long, part int, keys binary, checks binary, ends binary, marked binary, ids binary, sizes binary, docs binary"


def _streams(chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a chunk of documents of one update: its distinct words (hash, checksum, class by ending, count in training documents), the tokens as places among them, and the documents."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "checks", "ends", "marked", "ids", "sizes", "docs"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        shares = ((seq, b, k) for seq, b in enumerate(text_chunks(batches, 1, chunk_bytes)) for k in range(UPDATES))
        for seq, b, k in shares:
            own = np.flatnonzero([update_of(i) == k for i in b.column(0).to_pylist()])
            if not len(own):
                continue
            b = b.take(pa.array(own))
            who = b.column(0).to_pylist()
            names: defaultdict = defaultdict()
            names.default_factory = names.__len__
            rows = [np.fromiter(map(names.__getitem__, w), np.uint32, len(w)) for w in map(tokens, bytes_of(b.column(1)))]
            ids, sizes = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
            learnt = np.repeat(np.array([trains(i) for i in who], bool), sizes)
            columns = [
                np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names)),
                np.fromiter(map(zlib.crc32, names), np.uint32, len(names)),
                np.fromiter(map(ending_class, names), np.uint8, len(names)),
                np.bincount(ids[learnt], minlength=len(names)).astype(np.uint32),
                ids,
                sizes,
                np.array([0 if i is None else i for i in who] + [i is None for i in who], np.int64),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([part << 24 | (seq * UPDATES + k)]), pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], schema=schema)

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            keys, checks = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["checks"], np.int32)
            ends, marked = np.frombuffer(row["ends"], np.uint8).astype(np.int16), np.frombuffer(row["marked"], np.uint32).astype(np.int64)
            for i in range(0, len(keys), 100_000):
                s = slice(i, i + 100_000)
                n = len(keys[s])
                yield pa.RecordBatch.from_arrays([pa.array(keys[s]), pa.array(checks[s]), pa.array(ends[s]), pa.array(np.full(n, row["chunk"])), pa.array(np.arange(i, i + n, dtype=np.int32)), pa.array(marked[s])], names=["key", "check", "k", "chunk", "at", "n"])


_TOTALS = "kind byte, chunk long, at binary, counts binary, key long, check int, k short, n long, words long"


def _totals(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """From postings in whole runs of a word: for each chunk its words' total counts; for each class the sum and number of counts; the most frequent words."""
    arrow = pa.schema([("kind", pa.int8()), ("chunk", pa.int64()), ("at", pa.binary()), ("counts", pa.binary()), ("key", pa.int64()), ("check", pa.int32()), ("k", pa.int16()), ("n", pa.int64()), ("words", pa.int64())])
    key, check, k, chunk, at, n = (t.column(c).to_numpy() for c in ("key", "check", "k", "chunk", "at", "n"))
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
    total = np.add.reduceat(n, first)
    every = np.repeat(total, np.diff(np.append(first, len(key))))
    order = np.argsort(chunk, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(chunk[order])) + 1, len(order))
    blank = lambda m, kind: pa.nulls(m, kind)
    m, sizes = len(ends), np.diff(np.concatenate([[0], ends]))
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int8)), pa.array(chunk[order][ends - 1]), packed(at[order].astype(np.uint32), np.cumsum(sizes)), packed(every[order], np.cumsum(sizes)), blank(m, pa.int64()), blank(m, pa.int32()), blank(m, pa.int16()), blank(m, pa.int64()), blank(m, pa.int64())], schema=arrow)
    seen = np.flatnonzero(total > 0)
    kk, c = k[first[seen]], total[seen]
    mass, words = np.bincount(kk, c, CLASSES), np.bincount(kk, minlength=CLASSES)
    on = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(on), np.int8)), *(blank(len(on), x) for x in (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32())), pa.array(on.astype(np.int16)), pa.array(mass[on].astype(np.int64)), pa.array(words[on])], schema=arrow)
    top = seen[np.argsort(-c, kind="stable")[: CLASSES * ENTRIES]]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), 2, np.int8)), *(blank(len(top), x) for x in (pa.int64(), pa.binary(), pa.binary())), pa.array(key[first[top]]), pa.array(check[first[top]]), pa.array(k[first[top]]), pa.array(total[top]), blank(len(top), pa.int64())], schema=arrow)


# ---------------------------------------------------------------- the model


@dataclass
class Lexis:
    """Which class and entry a word has, and how likely it is among the other words of its class; sizes are fixed."""

    keys: np.ndarray  # of the words with an entry of their own, ascending
    checks: np.ndarray
    classes: np.ndarray
    entries: np.ndarray
    class_bias: np.ndarray
    entry_bias: np.ndarray  # class x entry; very low where there is none
    rest: np.ndarray  # of each class: log10 of the smoothed count of its words without an entry
    buckets: int

    def place(self, keys: np.ndarray, checks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and entry of each word."""
        k, e = ends.astype(np.int64), np.full(len(keys), ENTRIES - 1)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            own = (self.keys[at] == keys) & (self.checks[at] == checks)
            k[own], e[own] = self.classes[at[own]], self.entries[at[own]]
        return k, e


def make_lexis(top: list[tuple[int, int, int, int]], mass: np.ndarray, words: np.ndarray) -> Lexis:
    """``top``: (key, check, class by ending, count) of the most frequent training words, most frequent first."""
    mass, words = mass.astype(float), words.astype(float)
    count = np.zeros((CLASSES, ENTRIES))
    used, heads = np.zeros(CLASSES, int), []
    for i, (key, check, k, n) in enumerate(top):
        own = i if i < SINGLE else k
        if i >= SINGLE and used[own] >= ENTRIES - 1:
            continue
        heads.append((key & (1 << 64) - 1, check & (1 << 32) - 1, own, used[own]))
        count[own, used[own]] = n
        used[own] += 1
        mass[k] -= n
        words[k] -= 1
    count[SINGLE:, -1] = mass[SINGLE:]
    there = np.arange(ENTRIES) < used[:, None]
    there[SINGLE:, -1] = True
    there[:SINGLE, 0] = True
    entry = np.where(there, np.log((count + 0.5) / (count.sum(1, keepdims=True) + 0.5 * there.sum(1, keepdims=True))), -1e4)
    whole = count.sum(1)
    heads.sort()
    key, check, k, e = (np.array(x, t) for x, t in zip(zip(*heads) if heads else ((), (), (), ()), (np.uint64, np.uint32, np.int64, np.int64)))
    n = int(whole.sum())
    buckets = min(MOST, max(FEWEST, 1 << max(0, n // TOKENS_A_BUCKET).bit_length()))
    return Lexis(key, check, k, e, np.log((whole + 0.5) / (whole.sum() + 0.5 * CLASSES)).astype(np.float32), entry.astype(np.float32), np.log10(mass + 0.1 * (words + 1)), buckets)


class Chunk:
    """A chunk's tokens with their classes, entries and features."""

    def __init__(self, row: dict, lexis: Lexis):
        keys, ids = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["ids"], np.uint32).astype(np.int64)
        self.ids, self.sizes = ids, np.frombuffer(row["sizes"], np.int64)
        docs = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
        self.docs, self.null = docs[0], docs[1].astype(bool)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.word_class, self.word_entry = lexis.place(keys, np.frombuffer(row["checks"], np.uint32), np.frombuffer(row["ends"], np.uint8))
        self.classes, self.entries = self.word_class[ids], self.word_entry[ids]
        h = keys[ids]
        place = self.at = np.arange(len(ids)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        with np.errstate(over="ignore"):
            one = np.where(place >= 1, np.concatenate([h[:1], h[:-1]]), np.uint64(1))
            two = np.where(place >= 2, np.concatenate([h[:2], h[:-2]])[: len(h)], np.uint64(2))
            both = (one * np.uint64(0x9E3779B97F4A7C15)) ^ (two * np.uint64(0xD6E8FEB86659FD93))
            self.features = [one ^ (one >> np.uint64(29)), two ^ (two >> np.uint64(31)), both ^ (both >> np.uint64(32))]
        self.mask = np.uint64(lexis.buckets - 1)

    def uniform(self, at: np.ndarray, which: int) -> np.ndarray:
        """A number from 0 to 1 for each position, made of its document's id and its place there alone."""
        with np.errstate(over="ignore"):
            x = self.docs[self.owner[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.at[at].astype(np.uint64) * np.uint64(2) + np.uint64(which)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            return ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)

    def class_slots(self, at: np.ndarray | slice) -> list[np.ndarray]:
        return [((x[at] >> np.uint64(17)) & self.mask).astype(np.int64) for x in self.features]

    def entry_slots(self, at: np.ndarray) -> list[np.ndarray]:
        """Buckets of the features together with the token's class."""
        with np.errstate(over="ignore"):
            own = (self.classes[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            return [((((x[at] ^ own) * np.uint64(0x94D049BB133111EB)) >> np.uint64(37)) & self.mask).astype(np.int64) for x in self.features]


def softmax(bias: np.ndarray, weights: np.ndarray, slots: list[np.ndarray]) -> np.ndarray:
    """Probabilities, a row a position: exponentials of bias plus the weights of its features, in proportion."""
    z = bias + weights[0][slots[0]]
    for k in range(1, TEMPLATES):
        z += weights[k][slots[k]]
    np.exp(z, out=z)
    z /= z.sum(1)[:, None]  # row by row, so that a position's result does not depend on those beside it
    return z


def new_weights(lexis: Lexis) -> list[np.ndarray]:
    """Weights [template, bucket, class] and [template, bucket with class, entry]."""
    return [np.zeros((TEMPLATES, lexis.buckets, m), np.float32) for m in (CLASSES, ENTRIES)]


def _drawn(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One outcome a row, drawn from its probabilities by the uniform numbers ``u``."""
    return np.minimum((np.cumsum(p, axis=1) < u[:, None]).sum(1), p.shape[1] - 1)


def _gradient(lexis: Lexis, held):
    """Observed outcomes minus outcomes drawn from the model, by feature and outcome: the likelihood's gradient, without bias.

    Each task adds up its chunks and sends one row a block of :data:`BLOCK` buckets: observed and drawn counts, compressed.
    """
    arrow = pa.schema([("block", pa.int32()), ("row", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        total = [np.zeros((2, TEMPLATES, lexis.buckets * w.shape[2]), np.int32) for w in weights]
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, lexis)
                learnt = np.flatnonzero(np.repeat([trains(None if x else int(i)) for i, x in zip(c.docs, c.null)], c.sizes))
                inner = learnt[c.classes[learnt] >= SINGLE]
                for which, at, target, slots in ((0, learnt, c.classes, c.class_slots), (1, inner, c.entries, c.entry_slots)):
                    w, m = weights[which], weights[which].shape[2]
                    drawn = np.zeros(len(at), np.int64)
                    for i in range(0, len(at), STEP):
                        s = at[i : i + STEP]
                        bias = lexis.entry_bias[c.classes[s]] if which else lexis.class_bias
                        drawn[i : i + STEP] = _drawn(softmax(bias, w, slots(s)), c.uniform(s, which))
                    for k, slot in enumerate(slots(at)):
                        for j, what in enumerate((target[at], drawn)):
                            total[which][j, k] += np.bincount(slot * m + what, minlength=lexis.buckets * m).astype(np.int32)
        first, squeeze = 0, zstandard.ZstdCompressor(level=1).compress
        for w, t in zip(weights, total):
            both = t.reshape(2, TEMPLATES * lexis.buckets // BLOCK, BLOCK * w.shape[2]).swapaxes(0, 1)
            met = np.flatnonzero(both.any((1, 2)))
            for i in met:
                row = both[i]
                yield pa.RecordBatch.from_arrays([pa.array([i + first], pa.int32()), pa.array([squeeze((row.astype(np.uint16) if row.max() < 1 << 16 else row).tobytes())], pa.binary())], schema=arrow)
            first += len(both)

    return run


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the tasks' rows by block of buckets and turn each into the step of its weights: gradient over curvature."""
    total: dict[int, np.ndarray] = {}
    spread = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for block, row, width in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = spread(row)
            r = np.frombuffer(raw, np.uint16 if len(raw) == 4 * BLOCK * width else np.int32).astype(np.int64)
            total[block] = total[block] + r if block in total else r
    for block, both in total.items():
        seen, drawn = both.reshape(2, -1)
        step = (RATE * (seen - drawn) / ((seen + drawn) / 2 + DAMP)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([step.tobytes()], pa.binary())], names=["block", "row"])


def train(stream: DataFrame, lexis: Lexis, after: Callable[[list[np.ndarray]], None] | None = None) -> list[np.ndarray]:
    """The weights after :data:`UPDATES` gradient updates; ``after`` is called with the weights after each.

    An update's gradient (observed minus expected counts of each feature and outcome, the latter drawn from the
    present model) is summed over its documents' chunks by Spark, by block of buckets; each weight's step is its gradient divided by the
    curvature that the same counts estimate. Only the steps of the model's tables, of fixed size, reach the driver.
    """
    context = stream.sparkSession.sparkContext
    weights = new_weights(lexis)
    many = TEMPLATES * lexis.buckets
    for k in range(UPDATES):
        held = context.broadcast(weights)
        steps = stream.where(F.col("part") == k).select("chunk", "keys", "checks", "ends", "ids", "sizes", "docs").mapInArrow(_gradient(lexis, held), "block int, row binary")
        steps = steps.withColumn("width", F.when(F.col("block") < many // BLOCK, CLASSES).otherwise(ENTRIES))
        weights = [w.copy() for w in weights]
        flat = [w.reshape(many // BLOCK, -1) for w in weights]
        for block, row in steps.repartition("block").mapInArrow(_steps, "block int, row binary").collect():
            flat[block // (many // BLOCK)][block % (many // BLOCK)] += np.frombuffer(row, np.float32)
        for w in weights:
            np.clip(w, -BOUND, BOUND, out=w)
        held.destroy()
        tidy(stream.sparkSession)
        if after:
            after(weights)
    return weights


# ---------------------------------------------------------------- scoring

_SCORES = "id long, n_tokens long, n_known long, base_score double, score double"


def _scores(lexis: Lexis, held, n_train: int, n_words: int):
    """Score the chunks; rows come by chunk, the counts of its words before its stream."""
    floor = np.log10(n_train + 0.1 * (n_words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        pieces: list[tuple[bytes, bytes]] = []
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if row["at"] is not None:
                    pieces.append((row["at"], row["counts"]))
                    continue
                c = Chunk(row, lexis)
                counts = np.zeros(len(c.word_class), np.int64)
                for at, n in pieces:
                    counts[np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.int64)
                pieces.clear()
                yield _chunk_scores(c, counts, lexis, weights, floor)

    return run


def _chunk_scores(c: Chunk, counts: np.ndarray, lexis: Lexis, weights: list[np.ndarray], floor: float) -> pa.RecordBatch:
    n = len(c.sizes)
    word = np.log10(counts + 0.1)
    rest = np.where(c.word_entry == ENTRIES - 1, word - lexis.rest[c.word_class], 0.0)
    base = np.bincount(c.owner, (word - floor)[c.ids], n)
    known = np.bincount(c.owner, (counts > 0)[c.ids], n)
    logs = np.empty(len(c.ids))
    for i in range(0, len(c.ids), STEP):
        at = np.arange(i, min(i + STEP, len(c.ids)))
        p = softmax(lexis.class_bias, weights[0], c.class_slots(at))[np.arange(len(at)), c.classes[at]].astype(float)
        inner = at[c.classes[at] >= SINGLE]
        if len(inner):
            p[inner - i] *= softmax(lexis.entry_bias[c.classes[inner]], weights[1], c.entry_slots(inner))[np.arange(len(inner)), c.entries[inner]]
        logs[at] = np.log10(np.maximum(p, 1e-60))
    score = np.bincount(c.owner, rest[c.ids], n) + np.bincount(c.owner, logs, n)
    return pa.RecordBatch.from_arrays([pa.array(c.docs, mask=c.null), pa.array(c.sizes), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names=["id", "n_tokens", "n_known", "base_score", "score"])


class Corpus:
    """The staged token streams of a table, the counts of its words, and the lexis of its training part."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int):
        d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        small = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}  # rows are large
        self.stream = stage(d.mapInArrow(_streams(chunk_bytes), _STREAM), "streams", by="part", **small)
        postings = self.stream.select("chunk", "keys", "checks", "ends", "marked").mapInArrow(_postings, "key long, check int, k short, chunk long, at int, n long")
        self.totals = stage(postings.repartition("key").sortWithinPartitions("key", "check").mapInArrow(runs(_totals), _TOTALS), "totals")
        mass, words = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, m, v in self.totals.where("kind = 1").groupBy("k").agg(F.sum("n"), F.sum("words")).collect():
            mass[k], words[k] = m, v
        self.n_train, self.n_words = int(mass.sum()), int(words.sum())
        top = self.totals.where("kind = 2").orderBy(F.desc("n"), "key", "check").limit(CLASSES * ENTRIES).select("key", "check", "k", "n").collect()
        self.lexis = make_lexis([tuple(r) for r in top], mass, words)

    def scores(self, weights: list[np.ndarray]) -> DataFrame:
        held = self.stream.sparkSession.sparkContext.broadcast(weights)
        own = ["keys", "checks", "ends", "ids", "sizes", "docs"]
        counts = self.totals.where("kind = 0").select("chunk", "at", "counts", *[F.lit(None).cast("binary").alias(c) for c in own])
        both = counts.unionByName(self.stream.select("chunk", *[F.lit(None).cast("binary").alias(c) for c in ("at", "counts")], *own))
        rows = both.repartition("chunk").sortWithinPartitions("chunk", F.col("at").isNull())
        return rows.mapInArrow(_scores(self.lexis, held, self.n_train, self.n_words), _SCORES)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the text).

    A text's tokens are its words (ASCII white space, A-Z lower-cased) and an end. Training documents are those
    whose crc32(id as text) mod 10 is not 0. base_score is the smoothed unigram model. score is the model's:
    P(token) = P(class | features) * P(entry | class, features) * P(token | entry), where the features are the
    hashed previous word, the word before it and both. The first two factors are softmaxes trained by gradient
    updates (:func:`train`). An entry is one frequent word, or stands for all other words of its class, of which
    each has its smoothed share and one share is left for words that training did not see; so the probabilities of
    all tokens sum to one.

    Texts are tokenised once, into a staged stream of chunks. A document's update follows from its id, and what is drawn
    for its positions from its id and their places, so scores do not depend on how files or partitions divide the table.
    Counts cover the
    whole corpus: each chunk sends its distinct words once, they are summed by word (64-bit hash and checksum), and
    the sums go back to the chunks, so no task holds a vocabulary and a frequent word has one row a chunk. The
    model's tables follow the training tokens up to a fixed size. A long text is a chunk of its own and is scored
    some thousand positions at a time. Null text counts as empty (its end alone); a null id is held out. Repeated
    rows keep a row each.
    """
    corpus = Corpus(docs, id_col, text_col, chunk_bytes)
    out = release(corpus.scores(train(corpus.stream, corpus.lexis)), "scores", corpus.stream, corpus.totals)
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 10 == 0
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(corpus.n_train).cast("long").alias("train_tokens"), "base_score", "score")
