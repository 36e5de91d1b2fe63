"""Document quality: word and symbol counts, repetition, and lines that many documents of a host share."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, stage, text_chunks

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_DIGITS = bytes.maketrans(b"123456789", b"000000000")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_hash(line: bytes) -> int:
    """Hash of a line in its normal form: A-Z lower-cased, white space to single spaces, digits alike."""
    return _signed(xxhash.xxh64_intdigest(b" ".join(line.split()).lower().translate(_DIGITS)))


def repeated_words(texts: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each word list: how many of its words lie in a window of words that occurs twice or more in it."""
    names: defaultdict = defaultdict()
    names.default_factory = names.__len__
    sizes = np.array([len(w) for w in texts])
    ids = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in texts)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    out = np.zeros(len(texts), np.int64)
    if len(ids) < window:
        return out
    starts = np.flatnonzero(owner[: len(ids) - window + 1] == owner[window - 1 :])
    if not len(starts):
        return out
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(ids) - window + 1, np.uint64)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for k in range(window):
            rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + len(rolled)]
        keys = (rolled[starts] ^ (rolled[starts] >> np.uint64(31))) + owner[starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keys, kind="stable")
    at, ordered = starts[order], keys[order]
    a, b = at[:-1], at[1:]
    same = np.flatnonzero((ordered[1:] == ordered[:-1]) & (owner[a] == owner[b]))
    if len(same):  # equal hashes are confirmed word by word
        span = np.arange(window)
        same = same[(ids[a[same][:, None] + span] == ids[b[same][:, None] + span]).all(1)]
    hit = np.zeros(len(ids) + 1, np.int64)
    found = np.unique(np.concatenate([a[same], b[same]]))
    np.add.at(hit, found, 1)
    np.add.at(hit, found + window, -1)
    covered = np.cumsum(hit)[:-1] > 0
    return np.bincount(owner[covered], minlength=len(texts)).astype(np.int64)


_FACTS = "id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<at:int,hash:long,words:int>>"


def _facts():
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("lines", pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 2):
            texts = bytes_of(b.column(2))
            words = [t.split() for t in texts]
            chars, symbols, dups, lines = [], [], [], []
            for t, w in zip(texts, words):
                chars.append(len(b"".join(w).translate(None, _CONTINUATION)))
                symbols.append(len(t) - len(t.translate(None, _SYMBOLS)))
                seen: set[bytes] = set()
                kept, n = [], 0
                for k, line in enumerate(t.split(b"\n")):
                    if m := len(line.split()):
                        n += line in seen
                        seen.add(line)
                        kept.append({"at": k, "hash": line_hash(line), "words": m})
                dups.append(n)
                lines.append(kept)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(dups, pa.int64()), pa.array(repeated_words(words)), pa.array(lines, schema.field("lines").type)], schema=schema)

    return run


def _shared(lines: DataFrame, docs: DataFrame, share: float, least: int) -> DataFrame:
    """(host, hash) of the lines that at least ``least`` documents of the host hold, and more than ``share`` of them.

    Both counts are sums with partial aggregation over a document's distinct lines, so that a common line or host burdens no task.
    """
    sizes = stage(docs.groupBy("host").agg(F.count("*").alias("docs")), "hosts")
    held = lines.select("host", "row", "hash").groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return stage(held.join(sizes, "host").where(F.col("n") > F.lit(share) * F.col("docs")).select("host", "hash"), "lines")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_share: float = 0.05, least_docs: int = 5, least_left: float = 0.2, min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Judge every document by its own words and by the lines that it shares with others of its host.

    Base rules: fewer than ``min_words`` words, or more than ``most_repeated`` percent of them in 8-word windows that
    occur twice in the text. Method, over the normal forms of all lines with a word, whatever their length:

    1. A line is shared when at least ``least_docs`` documents of its host hold it, and more than ``line_share`` of
       all of the host's documents with words.
    2. A document is rich when at least half of its words lie outside shared lines. A shared line is boilerplate when
       at least ``least_docs`` rich documents hold it, and more than ``line_share`` of the host's rich ones. Menus and
       notices stand beside other text somewhere; copies and near copies of one document hold nothing but lines that
       they share, so they make no boilerplate of each other and are left to deduplication.
    3. ``cut_lines`` are the numbers of the boilerplate lines in the text, which :func:`without_lines` removes,
       ``n_cut_words`` their words. A document left with less than ``least_left`` of its words is depleted.

    ``kept`` is neither failed nor depleted. All limits are shares, so hosts and corpora of any size are judged alike;
    a host with fewer than ``least_docs`` documents has no boilerplate. Lines are hashed once (64 bits) and written
    with the counts of each document. Spark broadcasts shared lines only under its size threshold, else it splits hot ones.

    Null text counts as empty (no words: failed), null host as a host of its own. Repeated rows and ids keep a row
    each and count each. Returns id, the counts, base_failed, depleted, n_cut_words, cut_lines and kept.
    """
    facts = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text")).mapInArrow(_facts(), _FACTS).withColumn("row", F.monotonically_increasing_id()), "facts")
    some = facts.where("n_words > 0")
    held = facts.select("row", "host", F.explode(F.array_distinct(F.transform("lines", lambda l: l["hash"]))).alias("hash"))
    shared = _shared(held, some, line_share, least_docs)

    lines = facts.select("row", "host", "n_words", F.explode("lines").alias("l")).select("row", "host", "n_words", F.col("l.at").alias("at"), F.col("l.hash").alias("hash"), F.col("l.words").alias("words"))
    met = stage(lines.join(shared, ["host", "hash"]), "shared")
    poor = met.groupBy("row").agg(F.sum("words").alias("w"), F.first("n_words").alias("n_words")).where("2 * w > n_words").select("row")
    poor = stage(poor, "poor")
    boilerplate = _shared(met.select("host", "row", "hash").distinct().join(poor, "row", "left_anti"), some.join(poor, "row", "left_anti"), line_share, least_docs)

    cut = met.join(boilerplate, ["host", "hash"]).groupBy("row").agg(F.sum("words").alias("n_cut_words"), F.sort_array(F.collect_list("at")).alias("cut_lines"))
    out = facts.drop("lines", "host").join(cut, "row", "left").drop("row")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    out = out.withColumn("n_cut_words", F.coalesce("n_cut_words", F.lit(0)).cast("long")).withColumn("cut_lines", F.coalesce("cut_lines", F.array().cast("array<int>"))).withColumn("base_failed", failed)
    out = out.withColumn("depleted", F.col("n_words") - F.col("n_cut_words") < F.lit(least_left) * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).withColumnRenamed("id", id_col)


def without_lines(text: str, cut_lines: str) -> Column:
    """The column ``text`` without the lines whose numbers (from 0) the array ``cut_lines`` holds; a null or empty array leaves it as it is."""
    left = F.filter(F.split(text, "\n", -1), lambda _, k: ~F.array_contains(F.col(cut_lines), k))
    return F.when(F.size(cut_lines) > 0, F.array_join(left, "\n")).otherwise(F.col(text))
