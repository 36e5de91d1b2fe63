"""Repeated word passages across documents, found in prefix-partitioned suffix trees and cut out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, packed, stage, text_chunks

#: Words of a window that may not repeat, of the shortest prefix that a group of suffixes shares, and of what lies on each side of it in a window.
WINDOW, PREFIX = 13, 7
SIDE = WINDOW - PREFIX
#: Texts with a prefix up to which their suffixes form one group (about 100 bytes each).
GROUP = 20_000


class Words:
    """The words of several texts in a row: 64-bit hashes, owners, and the anchors of their windows."""

    def __init__(self, texts: list[bytes]):
        names: defaultdict = defaultdict()
        names.default_factory = names.__len__
        rows = [np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in (t.split() for t in texts)]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.ends = np.cumsum(self.sizes)
        ids = np.concatenate([np.zeros(0, np.int64), *rows])
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[ids]
        self.owner = np.repeat(np.arange(len(rows), dtype=np.int64), self.sizes)
        self.keys, self.anchors = self._anchors()

    def _anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all prefixes, and the places of anchors: in each window the prefix with the least hash, the first of equal ones.

        Equal windows have their anchor at the same place, so windows that repeat meet under the anchor's prefix.
        """
        n = len(self.hashes)
        if n < WINDOW:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            keys = np.zeros(n - PREFIX + 1, np.uint64)
            for k in range(PREFIX):
                keys = keys * np.uint64(0x9E3779B97F4A7C15) + self.hashes[k : k + len(keys)]
            keys ^= keys >> np.uint64(32)
            keys *= np.uint64(0xD6E8FEB86659FD93)
            keys ^= keys >> np.uint64(29)
        starts = np.arange(n - WINDOW + 1)
        least, at = keys[: len(starts)].copy(), starts.copy()
        for k in range(1, SIDE + 1):
            other = keys[k : k + len(starts)]
            lower = other < least
            least[lower] = other[lower]
            at[lower] = starts[lower] + k
        at = at[self.owner[: len(starts)] == self.owner[WINDOW - 1 :]]
        return keys, np.unique(at)

    def windows(self) -> np.ndarray:
        """Hashes of all windows of :data:`WINDOW` words."""
        with np.errstate(over="ignore"):
            keys = np.zeros(len(self.hashes) - WINDOW + 1, np.uint64)
            for k in range(WINDOW):
                keys = keys * np.uint64(0xD6E8FEB86659FD93) + self.hashes[k : k + len(keys)]
            return (keys ^ (keys >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, id, tag, sure) of each anchor prefix and text.

    Texts that repeat in a chunk are listed once. A prefix that two texts of the chunk hold is shared for sure; of
    those only one row still has to meet other tasks, so a passage in very many documents sends each task's one row.
    """
    names = ["hash", "id", "tag", "sure"]
    for b in text_chunks(batches, 2):
        texts = bytes_of(b.column(2))
        first = list({t: i for i, t in reversed(list(enumerate(texts)))}.values())
        w = Words([texts[i] for i in first])
        if not len(w.anchors):
            continue
        k, o = w.keys[w.anchors], w.owner[w.anchors]
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
        k, o = k[once], np.array(first)[o[once]]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        many = ~new | np.concatenate([~new[1:], [False]])
        ids, tags = b.column(0).to_numpy()[o], b.column(1).to_numpy()[o]
        for keep, sure in ((new, 0), (many, 1)):
            yield pa.RecordBatch.from_arrays([pa.array(k[keep].view(np.int64)), pa.array(ids[keep]), pa.array(tags[keep]), pa.array(np.full(keep.sum(), sure, np.int8))], names=names)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by hash, those whose hash several rows hold, and those that are sure."""
    held: pa.Table | None = None

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k, sure = t.column("hash").to_numpy(), t.column("sure").to_numpy()
        same = k[1:] == k[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        yield from t.filter(pa.array((keep & (sure == 0)) | (sure == 1))).select(["hash", "id", "tag"]).to_batches()

    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        k = t.column("hash").to_numpy()
        other = k[::-1] != k[-1]
        last = int(other.argmax()) if other.any() else len(k)  # rows of the last hash, which may go on in the next batch
        if len(k) > last:
            yield from out(t.slice(0, len(k) - last))
        held = t.slice(len(k) - last)
    if held is not None and held.num_rows:
        yield from out(held)


def tree_repeats(key: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows around each suffix also start in a smaller document, among suffixes grouped by prefix.

    ``key`` is a suffix's prefix, ``right`` the word hashes after it (suffixes x SIDE) and ``left`` those before it,
    nearest first. Sorting a group by the words after its prefix lists its suffix tree's leaves in order, and the
    longest common prefix of neighbours tells the inner nodes: for windows that take ``o`` words from before the
    prefix, the nodes at depth WINDOW - o are the maximal runs of neighbours with that much in common. Leaves of a
    node that agree in those ``o`` words too hold the same window. ``open_`` bit o: the window is judged here.
    Returns two bit masks a suffix: found in a smaller document; in the least document of its node (still open).
    """
    n = len(key)
    found, least = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    order = np.lexsort((*(right[:, k] for k in reversed(range(SIDE))), key))
    k, r, l_, d, m = key[order], right[order], left[order], doc[order], open_[order]
    same = k[1:] == k[:-1]
    common = np.where(same, PREFIX + np.cumprod(r[1:] == r[:-1], axis=1).sum(1), 0)
    with np.errstate(over="ignore"):
        before = np.zeros(n, np.uint64)
        for o in range(SIDE + 1):
            if o:
                before = (before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + l_[:, o - 1] + np.uint64(o)
            on = np.flatnonzero((m >> o) & 1)
            if not len(on):
                continue
            node = np.concatenate([[0], np.cumsum(common < WINDOW - o)])[on]
            by = np.lexsort((d[on], before[on], node))
            on, node = on[by], node[by]
            head = np.concatenate([[True], (node[1:] != node[:-1]) | (before[on][1:] != before[on][:-1])])
            lowest = d[on][np.flatnonzero(head)][np.cumsum(head) - 1]
            more = d[on] > lowest
            found[order[on[more]]] |= np.uint8(1 << o)
            least[order[on[~more]]] |= np.uint8(1 << o)
    return found, least


_OUT = "kind byte, route long, id long, tag int, mask short, places binary, sides binary"
_OUT_ARROW = pa.schema([("kind", pa.int8()), ("route", pa.int64()), ("id", pa.int64()), ("tag", pa.int32()), ("mask", pa.int16()), ("places", pa.binary()), ("sides", pa.binary())])


def _rows(kind: int, route: np.ndarray, owner: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, mask: np.ndarray, sides: np.ndarray | None, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of suffixes; those of one text that are alike (of a whole window, only the window counts) become one row with all their places, so repetitive texts send few rows."""
    with np.errstate(over="ignore"):
        like = (route.view(np.uint64) ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93) + mask.astype(np.uint64)
        for k in range(0 if sides is None or whole else sides.shape[1]):
            like = ((like ^ (like >> np.uint64(29))) + sides[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(like, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], like[order][1:] != like[order][:-1]])) if len(order) else order
    ends = np.append(first[1:], len(order))
    for i in range(0, len(first), 50_000):
        a, e = first[i : i + 50_000], ends[i : i + 50_000]
        s, n = order[a], len(a)
        blob = pa.nulls(n, pa.binary()) if sides is None else packed(sides[s].ravel(), np.arange(1, n + 1) * sides.shape[1])
        places = packed(pos[order[a[0] : e[-1]]].astype(np.int32), e - a[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(route[s]), pa.array(ids[s]), pa.array(tags[s]), pa.array(mask[s].astype(np.int16)), places, blob], schema=_OUT_ARROW)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes at shared anchors; windows that repeat within the chunk are settled here, the rest goes on to its prefix's group.

    A prefix too frequent for one group is lengthened: there each window goes on by itself, to the group of its own words.
    """
    for b in text_chunks(batches, 2):
        w = Words(bytes_of(b.column(2)))
        if not len(w.anchors):
            continue
        with np.errstate(over="ignore"):  # a chance match only adds an anchor to look at, or lengthens a prefix
            mine = w.keys[w.anchors] + (w.owner[w.anchors].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            asked = []
            for lists in (b.column(3), b.column(4)):
                wanted = np.asarray(lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]).view(np.uint64)
                whose = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                asked.append(wanted + (whose.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        some = np.isin(mine, asked[0])
        at, frequent = w.anchors[some], np.isin(mine[some], asked[1])
        if not len(at):
            continue
        own = w.owner[at]
        start, end = (w.ends - w.sizes)[own], w.ends[own]
        n = len(w.hashes)
        short = (w.hashes >> np.uint64(32)).astype(np.uint32)
        left = np.stack([np.where(at - k >= start, short[np.maximum(at - k, 0)], 0) for k in range(1, SIDE + 1)], 1)
        right = np.stack([np.where(at + PREFIX + k < end, short[np.minimum(at + PREFIX + k, n - 1)], 0) for k in range(SIDE)], 1)
        mask = np.zeros(len(at), np.uint8)
        for o in range(SIDE + 1):  # windows inside the document
            mask |= np.where((at - o >= start) & (at - o + WINDOW <= end), 1 << o, 0).astype(np.uint8)
        ids, tags, key = b.column(0).to_numpy()[own], b.column(1).to_numpy()[own], w.keys[at].view(np.int64)
        found, least = tree_repeats(key, ids, left, right, mask)
        hit, on, sides = found > 0, (least > 0) & ~frequent, np.concatenate([left, right], 1)
        yield from _rows(0, ids[hit], own[hit], ids[hit], tags[hit], (at - start)[hit], found[hit], None)
        yield from _rows(1, key[on], own[on], ids[on], tags[on], (at - start)[on], least[on], sides[on])
        if frequent.any():
            windows = w.windows()
            for o in range(SIDE + 1):
                on = frequent & ((least >> o) & 1 == 1)
                yield from _rows(1, windows[at[on] - o].view(np.int64), own[on], ids[on], tags[on], (at - start)[on], np.full(on.sum(), 1 << o, np.uint8), sides[on], whole=True)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settle the open windows of each prefix's group; rows come sorted by route, groups are handled some at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids = t.column("route").to_numpy(), t.column("id").to_numpy()
        sides = np.frombuffer(b"".join(t.column("sides").to_pylist()), np.uint32).reshape(-1, 2 * SIDE)
        found, _ = tree_repeats(key, ids, sides[:, :SIDE], sides[:, SIDE:], t.column("mask").to_numpy().astype(np.uint8))
        hit = found > 0
        t, n = t.filter(pa.array(hit)), int(hit.sum())
        out = [pa.array(np.zeros(n, np.int8)), t.column("id"), t.column("id"), t.column("tag"), pa.array(found[hit].astype(np.int16)), t.column("places"), pa.nulls(n, pa.binary())]
        yield from pa.table(out, schema=_OUT_ARROW).to_batches()

    for b in batches:
        kind = b.column("kind").to_numpy()
        yield b.filter(pa.array(kind == 0))
        if not (kind == 1).any():
            continue
        held.append(b.filter(pa.array(kind == 1)))
        size += held[-1].num_rows
        if size >= 300_000:
            t = pa.Table.from_batches(held)
            k = t.column("route").to_numpy()
            whole = int(np.searchsorted(k, k[-1]))
            if whole:
                yield from settle(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                size = len(k) - whole
    if held:
        yield from settle(pa.Table.from_batches(held))


def _word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end."""
    raw = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], (raw != 32) & (raw - np.uint8(9) > 4), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def _cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the marked words; white space between words that stay next to each other is kept."""
    stay = np.flatnonzero(~gone)
    if not len(stay):
        return b""
    start, end = _word_bounds(text)
    new = np.concatenate([[True], np.diff(stay) > 1])
    first, last = start[stay[new]].tolist(), end[stay[np.append(new[1:], True)]].tolist()
    out = [text[first[0] : last[0]]]
    for a, z, before in zip(first[1:], last[1:], last):
        out += (b"\n" if b"\n" in text[before:a] else b" ", text[a:z])
    return b"".join(out)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_words", "n_removed", "text", "rest"]
    for b in text_chunks(batches, 1, 2 << 20):
        ids, texts, copies, hits = b.column(0), bytes_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()
        total, removed, out = [], [], []
        for t, copy, found in zip(texts, copies, hits):
            n = len(t.split())
            total.append(n)
            if copy and n >= WINDOW:
                removed.append(n)
                t = b""
            elif found:
                raw = [x["places"] for x in found]
                places = np.frombuffer(b"".join(raw), np.int32)
                masks = np.repeat(np.array([x["mask"] for x in found]), [len(r) // 4 for r in raw])
                starts = np.concatenate([places[masks >> o & 1 == 1] - o for o in range(SIDE + 1)])
                step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + WINDOW, minlength=n + 1)
                gone = np.cumsum(step)[:n] > 0
                removed.append(int(gone.sum()))
                t = _cut(t, gone)
            else:
                removed.append(0)
            out.append(t)
        yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.binary()).cast(pa.string()), b.column(4)], names=names)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), group: int = GROUP) -> DataFrame:
    """Cut out every word in a window of 13 words that also starts in a document with a smaller id.

    1. Anchors: of each window the 7-word prefix with the least hash. Their hashes are shuffled with the ids; a
       prefix that only one text holds drops out, and with it most of the corpus. Texts that repeat in a task count
       once, and what a task itself sees twice is sent on once, so frequent passages and copies make no hot key.
    2. Exact copies: only the least id of equal texts goes on; the others (of 13 words or more) go whole.
    3. Suffix trees: each suffix at a shared anchor carries the words around it as 32-bit hashes, beneath a 64-bit
       hash of its prefix. Suffixes are grouped by prefix; a prefix that more than ``group`` texts hold is lengthened to
       whole windows, so a group stays small enough for a task however frequent its words are. Alike suffixes of one
       text are one row, and a task's own repeats are settled before the shuffle,
       so that of a window only those of a task's least document reach a group. Sorted suffixes and their common prefixes give the
       nodes of each tree; the leaves below a node that lies a window deep are its occurrences (:func:`tree_repeats`).
    4. The marks go back to the documents by id.

    Windows are judged on the input. Null ids take no part (their text stays), null text counts as empty. Rows that
    repeat an id with the same text are the same document; other rows with that id are neither smaller nor larger.
    Returns id, n_words, n_removed, text (what is left; white space between neighbours that stay is kept) and the
    columns ``keep``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("tag"), text.alias("text"))
    known = d.where(F.col("id").isNotNull())

    shared = known.mapInArrow(_shared, "hash long, id long, tag int, sure byte")
    deal = F.when(F.col("sure") == 1, F.xxhash64("id", "tag")).otherwise(F.col("hash"))
    repeated = stage(shared.withColumn("deal", deal).repartition("deal").sortWithinPartitions("hash").select("hash", "id", "tag", "sure").mapInArrow(_repeated, "hash long, id long, tag int"), "anchors")

    prints = known.select("id", "tag", F.xxhash64("text").alias("print"), F.octet_length("text").alias("bytes"))
    first = stage(prints.groupBy("print", "bytes").agg(F.min("id").alias("first")), "originals")
    origin = stage(prints.join(first, ["print", "bytes"]).select("id", "tag", "first").distinct(), "copies")
    frequent = stage(repeated.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > group).select("hash", F.lit(True).alias("frequent")), "frequent")
    listed = repeated.join(frequent, "hash", "left").join(origin, ["id", "tag"])
    wanted = listed.groupBy(F.col("first").alias("id"), "tag").agg(F.collect_set("hash").alias("anchors"), F.collect_set(F.when(F.col("frequent"), F.col("hash"))).alias("frequent"))
    none = F.lit(None).cast("array<long>")
    todo = stage(origin.groupBy("id", "tag").agg(F.min("first").alias("first")).where("first <> id").select("id", "tag", F.lit(True).alias("copy"), none.alias("anchors"), none.alias("frequent")).unionByName(wanted.select("id", "tag", F.lit(False).alias("copy"), "anchors", "frequent")), "todo")

    found = known.join(todo.where("not copy").select("id", "tag", "anchors", "frequent"), ["id", "tag"]).select("id", "tag", "text", "anchors", "frequent").mapInArrow(_suffixes, _OUT)
    marks = found.repartition("route").sortWithinPartitions("route").mapInArrow(_trees, _OUT)
    # written, so that the shuffles behind it can go before the texts are shuffled once more
    marks = stage(marks.groupBy("id", "tag").agg(F.collect_list(F.struct("places", "mask")).alias("marks")), "marks")
    notes = todo.where("copy").select("id", "tag", "copy", F.lit(None).cast("array<struct<places:binary,mask:smallint>>").alias("marks")).unionByName(marks.select("id", "tag", F.lit(False).alias("copy"), "marks"))
    rest = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep])
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("tag"), text.alias("text"), rest.alias("rest")) if keep else d.withColumn("rest", rest)
    done = whole.join(notes, ["id", "tag"], "left").select("id", "text", "copy", "marks", "rest")
    out = done.mapInArrow(_finish, f"id long, n_words long, n_removed long, text string, rest {dict(done.dtypes)['rest']}")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("text").alias(text_col), *[F.col("rest").getField(c).alias(c) for c in keep])
