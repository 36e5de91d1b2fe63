"""Documents whose sets of word n-grams overlap: an exact Jaccard self-join in size-banded tiles with bitmap bounds."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, components, drop_staged, packed, release, runs, stage, text_chunks

#: Least bits of a bitmap signature; a larger set has the next power of two.
BITS = 1024
#: Words of 64 bits of the folded bitmap that tile rows carry; random sets of up to some 500 shingles already differ too much in it.
FOLD = 4
#: Shingles known to be frequent, kept by every task to order prefixes (at most so many, 16 bytes each).
FREQUENT = 1 << 20
#: Shingles with the least hashes by which likely partners are tried first, and sets of such a shingle that all others are tried against.
MINS, LEADERS = 3, 16
#: Rows of a tile up to which all its pairs are formed at once.
SMALL_TILE = 64
#: Partners of other components, nearest first, that each row of a larger tile tries in a turn, and most turns; what they leave is paired in whole.
NEAREST, TURNS = 8, 8

_C = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets of shingles as 64-bit hashes: all of them in a row (ascending within a text), and the sets' ends.

    Words are cut at ASCII white space and A-Z lower-cased; a text with fewer words than ``size`` has its whole
    sequence as one shingle, a text without words none.
    """
    names: defaultdict = defaultdict()
    names.default_factory = names.__len__
    rows = [np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in (t.lower().split() for t in texts)]
    sizes = np.array([len(r) for r in rows], np.int64)
    ids = np.concatenate([np.zeros(0, np.int64), *rows])
    words = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[ids]
    owner = np.repeat(np.arange(len(rows)), sizes)
    with np.errstate(over="ignore"):
        keys = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            keys = keys * _C + words[k : k + len(keys)]
    inside = owner[: len(keys)] == owner[size - 1 :] if len(keys) else np.zeros(0, bool)
    key, who = _mixed(keys[inside]), owner[: len(keys)][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < size))
    if len(short):
        start = np.cumsum(sizes) - sizes
        whole = [xxhash.xxh64_intdigest(words[start[i] : start[i] + sizes[i]].tobytes(), seed=int(sizes[i])) for i in short]
        key, who = np.concatenate([key, np.array(whole, np.uint64)]), np.concatenate([who, short])
    order = np.lexsort((key, who))
    key, who = key[order], who[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])[: len(key)]
    return key[once], np.cumsum(np.bincount(who[once], minlength=len(texts)))


def bitmaps(keys: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """A bitmap for each set, about a bit an element: every element toggles one bit, so two bitmaps differ in no more bits than their sets do."""
    sizes = np.diff(np.concatenate([[0], ends]))
    width = BITS << np.ceil(np.log2(np.maximum(sizes, BITS) / BITS)).astype(np.int64)
    stop = np.cumsum(width)
    bit = (keys >> np.uint64(7)).astype(np.int64) & np.repeat(width - 1, sizes)
    odd = np.bincount(np.repeat(stop - width, sizes) + bit, minlength=stop[-1] if len(stop) else 0) & 1
    return np.split(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), stop[:-1] // 64) if len(ends) else []


def _folded(bits: np.ndarray) -> np.ndarray:
    """A bitmap of :data:`FOLD` words of 64 bits, which differs from another folded one in no more bits than the whole ones do."""
    return np.bitwise_xor.reduce(bits.reshape(-1, FOLD), 0)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ; the wider one is folded to the width of the other."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _needed(n: int, m: int, percent: int) -> int:
    """The least overlap of sets of n and m with 100 * overlap >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    return sizes - -(-percent * sizes // 100) + 1


def _sets_of(lists: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    return np.split(lists[0], lists[1][:-1]) if len(lists[1]) else []


def _frequent(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 0):
            keys, n = np.unique(shingle_sets(bytes_of(b.column(0)), size)[0], return_counts=True)
            many = n >= 3
            yield pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64)), pa.array(n[many])], names=["key", "n"])

    return run


_PREP = "id long, tag int, n long, sig long, link long, mins array<long>, prefix binary, bits binary, fold binary"


def _prepare(size: int, percent: int, frequent: np.ndarray, counts: np.ndarray):
    """Per document: set size, signature of the set, and, once a set and chunk: prefix, bitmap, local links and least hashes."""
    schema = pa.schema([("id", pa.int64()), ("tag", pa.int32()), ("n", pa.int64()), ("sig", pa.int64()), ("link", pa.int64()), ("mins", pa.list_(pa.int64())), ("prefix", pa.binary()), ("bits", pa.binary()), ("fold", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 2, 6 << 20):
            keys, ends = shingle_sets(bytes_of(b.column(2)), size)
            sizes = np.diff(np.concatenate([[0], ends]))
            sets = _sets_of((keys, ends))
            sigs = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            first = np.zeros(len(sets), bool)
            first[np.unique(sigs, return_index=True)[1]] = True
            first &= sizes > 0
            # prefixes: rare shingles first
            who = np.repeat(np.arange(len(sets)), sizes)
            weight = np.zeros(len(keys), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
                weight = np.where(frequent[at] == keys, counts[at], 0)
            order = np.lexsort((keys, weight, who))
            place = np.arange(len(keys)) - np.repeat(ends - sizes, sizes)
            keep = first[who] & (place < np.repeat(_prefix(sizes, percent), sizes))
            prefix = packed(keys[order][keep], np.cumsum(np.bincount(who[keep], minlength=len(sets))))
            # likely partners within the chunk
            low = [sets[i][np.argsort(_mixed(sets[i]))[:MINS]] if first[i] else sets[i][:0] for i in range(len(sets))]
            bits = bitmaps(keys, ends)
            root = _local(sets, bits, low, percent)
            lead = first & (root == np.arange(len(sets)))
            some = sizes > 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(sigs, mask=~some), pa.array(sigs[root], mask=~(first & ~lead)), pa.array([x.view(np.int64) if k else None for x, k in zip(low, lead)], pa.list_(pa.int64())), pa.Array.from_buffers(pa.binary(), len(sets), [pa.py_buffer(np.packbits(first, bitorder="little").tobytes()), *prefix.buffers()[1:]]), pa.array([x.tobytes() if k else None for x, k in zip(bits, first)], pa.binary()), pa.array([_folded(x).tobytes() if k else None for x, k in zip(bits, first)], pa.binary())], schema=schema)

    return run


def _local(sets: list[np.ndarray], bits: list[np.ndarray], low: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set of a chunk the first one that it reaches by links; tried are, for each least hash, its first :data:`LEADERS` sets."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    leaders: dict[int, list[int]] = {}
    for i, mins in enumerate(low):
        for key in mins.tolist():
            group = leaders.setdefault(key, [])
            for j in group:
                a, z = find(i), find(j)
                if a != z and links(sets[i], sets[j], bits[i], bits[j], percent):
                    parent[max(a, z)] = min(a, z)
            if len(group) < LEADERS:
                group.append(i)
    return np.array([find(i) for i in range(len(sets))], np.int64)


def links(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets overlap enough; sizes, then bitmaps bound the overlap before it is counted."""
    n, m = len(a), len(b)
    need = _needed(n, m, percent)
    if min(n, m) < need or n + m - differing(x, y) < 2 * need:
        return False
    if n > m:
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) >= need


def _explode_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 500):
            s = b.slice(i, 500)
            keys = [np.frombuffer(x, np.int64) for x in s.column("prefix").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            if len(at):
                # next to the key: what follows is the same from row to row, and compresses
                room = np.concatenate([n - np.arange(len(k)) for n, k in zip(s.column("n").to_pylist(), keys)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(room), *(s.column(c).take(at) for c in ("n", "sig"))], names=["key", "room", "n", "sig"])


def _open_tiles(percent: int):
    """Rows of tiles that have a partner: another set, a size within the band, and room for the overlap.

    Most shingles have one set and drop out here. ``room`` is how many shingles of the set's order start at this
    one. Two sets that link meet in the tile of their first common shingle, where both have room for all of it.
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k, n, sig = (t.column(c).to_numpy() for c in ("key", "n", "sig"))
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (sig[1:] != sig[:-1])])  # copies in other tasks
        t = t.filter(pa.array(once))
        k, n, room = (t.column(c).to_numpy() for c in ("key", "n", "room"))
        wide = np.int64(1) << 40
        tile = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]])) * wide
        most = np.minimum(100 * n // percent, ((100 + percent) * room) // percent - n)
        lo, hi = np.searchsorted(tile + n, tile - (-percent * n // 100)), np.searchsorted(tile + n, tile + most, side="right")
        # rows are sorted by key and size: the sizes that fit are a range, which must hold more than the row itself
        own = (lo <= np.arange(len(k))) & (np.arange(len(k)) < hi)
        on = hi - lo > own
        _, inverse, count = np.unique(k[on], return_inverse=True, return_counts=True)
        yield from t.filter(pa.array(on)).append_column("rows", pa.array(count[inverse], pa.int64())).to_batches()

    return work


def _pairs(percent: int, nearest: bool = False):
    """The pairs of each tile (rows of one shingle, sorted by set size): different labels, sizes within the band, places and folded bitmaps that leave room for the overlap.

    ``nearest``: of the tiles with more than :data:`SMALL_TILE` rows, only each row's :data:`NEAREST` pairs with the most room, so their number grows with the rows.
    """

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k, n, s, label, room = (t.column(c).to_numpy() for c in ("key", "n", "sig", "label", "room"))
        bits = np.frombuffer(b"".join(t.column("fold").to_pylist()), np.uint64).reshape(-1, FOLD)
        out = []

        def keep(i: np.ndarray, j: np.ndarray, nearest: bool = False) -> None:
            on = (label[i] != label[j]) & (s[i] != s[j])
            i, j = i[on], j[on]
            total = n[i] + n[j]
            need = -(-percent * total // (100 + percent))
            on = np.minimum(room[i], room[j]) >= need
            i, j, total, need = i[on], j[on], total[on], need[on]
            spare = total - np.bitwise_count(bits[i] ^ bits[j]).sum(1).astype(np.int64) - 2 * need
            on = spare >= 0
            if nearest and on.sum() > NEAREST:
                on = np.argpartition(-spare, NEAREST)[:NEAREST]
            out.append(np.stack([s[i[on]], s[j[on]]], 1))

        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        length = np.diff(np.append(start, len(k)))
        i = np.flatnonzero(np.repeat(length <= SMALL_TILE, length)) if not nearest else start[:0]
        d = 1
        while len(i):
            i = i[i + d < len(k)]
            i = i[(k[i + d] == k[i]) & (percent * n[i + d] <= 100 * n[i])]
            keep(i, i + d)
            d += 1
        for a, m in zip(start[length > SMALL_TILE], length[length > SMALL_TILE]):
            names, inverse, count = np.unique(label[a : a + m], return_inverse=True, return_counts=True)
            nn = n[a : a + m]
            rest = inverse != count.argmax()  # every pair of different labels has a member outside the most frequent one
            for r in np.flatnonzero(rest):
                lo, hi = np.searchsorted(nn, -(-percent * nn[r] // 100)), np.searchsorted(nn, 100 * nn[r] // percent, side="right")
                other = np.arange(lo, hi)
                if not nearest:
                    other = other[~rest[lo:hi] | (other > r)]
                keep(np.full(len(other), a + r), a + other, nearest)
        both = np.sort(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=1)
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(1)])[: len(both)]]
        for at in range(0, len(both), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(both[at : at + 100_000, 0]), pa.array(both[at : at + 100_000, 1])], names=["a", "b"])

    return work


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 0):
            sets = _sets_of(shingle_sets(bytes_of(b.column(0)), size))
            for i in range(0, len(sets), 500):
                raw = [x.tobytes() for x in sets[i : i + 500]]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh64_intdigest(x) for x in raw], np.uint64).view(np.int64)), pa.array(raw, pa.binary())], names=["sig", "items"])

    return run


def _bounded(percent: int):
    """Pairs whose bitmaps leave room for the overlap that they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            need = -(-percent * n // (100 + percent))
            differ = np.array([differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist())], np.int64)
            yield b.filter(pa.array(n - differ >= 2 * need)).select(["a", "b"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(1, np.uint64)
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("a", "b", "x", "y")))
            hit = [(u, v) for u, v, x, y in rows if links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), none, none, percent)]
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hit)], names=["u", "v"])

    return run


def _likely(mins: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of signatures to try first: each set with the leaders of its least hashes that are of like size."""
    rank = F.xxhash64("sig", F.lit(0))
    leader = mins.groupBy("key", F.pmod(rank, F.lit(LEADERS)).alias("part")).agg(F.min(F.struct(rank.alias("rank"), "sig", "n")).alias("lead"))
    leader = stage(leader.select("key", F.col("lead.sig").alias("a"), F.col("lead.n").alias("n_a")), "leaders")
    several = leader.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least <> most").select("key")
    tried = stage(leader.join(several, "key"), "leaders")
    fit = (F.col("sig") != F.col("a")) & (percent * F.greatest("n", "n_a") <= 100 * F.least("n", "n_a"))
    out = stage(mins.join(tried, "key").where(fit).select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b")).distinct(), "likely")
    for t in (leader, tried):
        drop_staged(t)
    return out


def _near(bits: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of signatures whose bitmaps leave room for a link."""
    x, y = (bits.select(F.col("sig").alias(p), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}")) for p in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded(percent), "a long, b long")


def _confirm(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of signatures that link, as edges (u, v): their sets are made again from the texts and intersected."""
    near = stage(pairs, "near")
    named = near.select(F.col("a").alias("sig")).union(near.select(F.col("b").alias("sig"))).distinct()
    wanted = stage(named.join(classes, "sig").select("id", "tag").distinct(), "wanted")
    sets = stage(docs.join(wanted, ["id", "tag"], "left_semi").select("text").mapInArrow(_sets(size), "sig long, items binary"), "items")
    x, y = sets.select(F.col("sig").alias("a"), F.col("items").alias("x")), sets.select(F.col("sig").alias("b"), F.col("items").alias("y"))
    edges = stage(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_exact(percent), "u long, v long"), "links")
    for t in (near, wanted, sets):
        drop_staged(t)
    return edges


def _labelled(tiles: DataFrame, labels: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of tiles with their sets' components so far and folded bitmaps, sorted for :func:`_pairs`."""
    named = tiles.drop("rows").join(labels.select(F.col("node").alias("sig"), F.col("component").alias("label")), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    return named.join(bits.select("sig", "fold"), "sig").repartition("key").sortWithinPartitions("key", "n")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id that links reach (its own included).

    Two documents link when their sets of ``size``-word shingles have 100 * overlap >= ``percent`` * union. No link
    between different sets is lost; equal sets are one class, whose copies are never paired.

    1. Shingles that a task meets in three documents or more are counted; the most frequent of all tasks (all above a count, which is set so that they are at most :data:`FREQUENT`) order prefixes: rare shingles first. The order decides cost, not results.
    2. Each document gets its set's size and signature, and each set its prefix: two sets that link share a
       shingle among their first n - ceil(percent * n / 100) + 1.
    3. Likely partners first: sets with a least hash in common are tried within each task, then one set of each local
       group against leaders among the others. Their components label the sets.
    4. Tiles: the rows of a prefix shingle, sorted by set size, form pairs within the size band, unless they have one
       label and so are connected already. Where many rows share a tile, each first tries its nearest partners of other
       components, turn after turn until no new link is found (:data:`TURNS` at most): a group of near copies is joined by
       about as many pairs as it has rows, and only rows that may belong elsewhere are then paired in whole. In the tile the shingle's places in both sets and the pairs' bitmaps bound the overlap from above, and only
       pairs that may link leave it.
    5. The sets of the pairs that remain are intersected.

    (Size bands alone would compare all documents of like size; the shingle of a tile keeps the join subquadratic.)
    Null or wordless texts have an empty set and are linked with nothing. A null id takes no part and has a null
    component. Repeated rows keep a row each; rows that share an id but not a text are judged apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.hash(text).alias("tag"), text.alias("text"))
    known = d.where(F.col("id").isNotNull())

    counts = stage(known.select("text").mapInArrow(_frequent(size), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    level, room = F.floor(4 * F.log2("n")), FREQUENT
    least = 256
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundred levels at most
        if r["count"] > room:
            break
        least, room = r["level"], room - r["count"]
    top = counts.where(level >= least).toPandas()
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    prep = stage(d.mapInArrow(_prepare(size, percent, keys[order], top["n"].to_numpy(np.int64)[order]), _PREP), "sets")

    linkable = prep.where(F.col("id").isNotNull() & F.col("sig").isNotNull())
    classes = stage(linkable.groupBy("sig").agg(F.min(F.struct("id", "tag")).alias("m")).select("sig", "m.id", "m.tag"), "classes")
    bits = stage(linkable.where(F.col("bits").isNotNull()).select("sig", "n", "bits", "fold").dropDuplicates(["sig"]), "bitmaps")
    local = linkable.where(F.col("link").isNotNull()).select(F.col("sig").alias("u"), F.col("link").alias("v"))

    mins = stage(linkable.where(F.col("mins").isNotNull()).select("sig", "n", F.explode("mins").alias("key")).distinct(), "mins")
    likely = _likely(mins, percent)
    labels = components(local.union(_confirm(known, classes, _near(bits, likely, percent), size, percent)))

    rows = linkable.where(F.col("prefix").isNotNull()).select("n", "sig", "prefix")
    tiles = rows.mapInArrow(_explode_prefix, "key long, room long, n long, sig long").repartition("key").sortWithinPartitions("key", "n", "sig")
    mixed = stage(tiles.mapInArrow(runs(_open_tiles(percent)), "key long, room long, n long, sig long, rows long"), "tiles")
    edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    crowded = mixed.where(F.col("rows") > SMALL_TILE)
    for _ in range(0 if crowded.isEmpty() else TURNS):
        tried = stage(_labelled(crowded, labels, bits).mapInArrow(runs(_pairs(percent, nearest=True)), "a long, b long").distinct(), "tried")
        linked = _confirm(known, classes, _near(bits, tried, percent), size, percent)
        drop_staged(tried)
        if linked.isEmpty():
            break
        labels = components(edges.union(linked))
        drop_staged(linked)
        edges = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
    pairs = stage(_labelled(mixed, labels, bits).mapInArrow(runs(_pairs(percent)), "a long, b long").distinct(), "pairs")
    edges = edges.union(_confirm(known, classes, _near(bits, pairs, percent), size, percent))

    part = components(edges)
    member = classes.join(part.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "id", F.coalesce("component", "sig").alias("component"))
    least = member.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stage(member.join(least, "component").select("sig", "component_id"), "components")
    out = prep.select("id", F.col("n").alias("n_shingles"), "sig").join(named, "sig", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return release(out, "classes", prep, counts, classes, bits, mins, likely, mixed, pairs, named)
