"""Shared helpers: staged tables, word splitting, per-block inverted indexes, connected components."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of an inverted-index block, and the bytes of text after which a block ends sooner.
BLOCK_DOCS, BLOCK_BYTES = 8192, 24 << 20


def staging_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, the warehouse.

    On a cluster a warehouse in a machine's own file system is no shared folder, and an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match(r"file:|/", d):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return d.rstrip("/") + "/statloom"


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffle files that no plan needs any more; it looks when the driver's JVM collects garbage."""
    spark._jvm.System.gc()


def stage(df: DataFrame, name: str, by: str | None = None, **options: object) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder (a folder for each value of ``by``) and read it back: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").options(**options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    for d in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]*$", "", f) for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(d)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(result: DataFrame, name: str, *tables: DataFrame) -> DataFrame:
    """Write a result of small rows and delete the staged tables that it was made from."""
    out = stage(result, name)
    for t in tables:
        drop_staged(t)
    return out


def text_chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``most`` bytes of the column ``text`` (or one longer row)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(np.nan_to_num(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to


def bytes_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each value; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array whose i-th value holds the raw items of ``values`` from ends[i-1] to ends[i]."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.dtype.itemsize
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of packed values must stay under 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def unpacked(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The items of a binary array's values in a row, and how many each value has (null: none)."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype), np.diff(ends).astype(np.int64) // size


def runs(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task function that hands ``work`` whole runs of equal keys, some hundred thousand rows at a time; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 200_000:
                t = pa.Table.from_batches(held)
                k = t.column("key").to_numpy()
                whole = int(np.searchsorted(k, k[-1]))
                if whole:
                    yield from work(t.slice(0, whole))
                    held, rows = t.slice(whole).combine_chunks().to_batches(), len(k) - whole
        if rows:
            yield from work(pa.Table.from_batches(held))

    return run


# ---------------------------------------------------------------- inverted index by blocks

INDEX_SCHEMA = "block long, token binary, docs binary, freqs binary, ids binary, extra binary, marked long"
_INDEX_ARROW = pa.schema([("block", pa.int64()), ("token", pa.binary()), ("docs", pa.binary()), ("freqs", pa.binary()), ("ids", pa.binary()), ("extra", pa.binary()), ("marked", pa.int64())])


def block_index(docs: DataFrame, id_col: str, text_col: str, split: Callable[[bytes], list], extra: Callable[[bytes, object], float] | None = None, weight: Callable[[object], bool] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block of documents and token one row: the block's documents that hold the token and how often.

    ``split`` gives a text's tokens (bytes or str). ``docs`` holds uint16 places in the block, ``freqs`` uint32
    counts. One more row a block, with a null token, holds the document ids (int64, then a null flag byte each)
    and ``extra`` (float64 for each document). A posting costs a few bytes, however long the token is.
    ``weight`` marks documents by id: ``marked`` is how often the token occurs in those of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, held
            block = (part << 24) | seq
            seq += 1
            names: defaultdict = defaultdict()
            names.default_factory = names.__len__
            rows = [np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in map(split, texts)]
            n = len(texts)
            flags = np.array([x is None for x in ids], np.uint8)
            head = np.array([0 if x is None else x for x in ids], np.int64).tobytes() + flags.tobytes()
            more = np.array([extra(t, i) for t, i in zip(texts, ids)] if extra else [0.0] * n, np.float64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([head]), pa.array([more]), pa.nulls(1, pa.int64())], schema=_INDEX_ARROW)
            sizes = np.array([len(r) for r in rows])
            if sizes.sum():
                keys = np.concatenate(rows) * n + np.repeat(np.arange(n), sizes)
                keys.sort()
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                counts = np.diff(np.append(first, len(keys))).astype(np.uint32)
                token, doc = np.divmod(keys[first], n)
                ends = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
                words = [w.encode() if isinstance(w, str) else w for w in names]
                if weight:
                    w = np.array([weight(i) for i in ids], np.int64)
                    marked = np.add.reduceat(counts * w[doc], np.concatenate([[0], ends[:-1]])).astype(np.int64)
                for a in range(0, len(ends), 20000):
                    e, start = ends[a : a + 20000], int(ends[a - 1]) if a else 0
                    m = len(e)
                    d, f = doc[start : e[-1]].astype(np.uint16), counts[start : e[-1]]
                    mark = pa.array(marked[a : a + m]) if weight else pa.nulls(m, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(words[a : a + m], pa.binary()), packed(d, e - start), packed(f, e - start), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), mark], schema=_INDEX_ARROW)
            ids.clear()
            texts.clear()
            held = 0

        for b in text_chunks(batches, 1, 4 << 20):
            for i, t in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if len(ids) >= BLOCK_DOCS or held >= block_bytes:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX_SCHEMA)


PARTIAL_SCHEMA = "block long, docs binary, sums binary, ids binary, extra binary"


def partial_sums(batches: Iterator[pa.RecordBatch], values: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sum freq * value over a task's tokens, for each block and document; rows must come sorted by block.

    ``values`` gives one row of numbers for each token of a batch (shape tokens x k). A block's sums leave the task
    as one row, sparse (only documents that occur), so a later shuffle moves at most one entry a posting.
    """
    schema = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("ids", pa.binary()), ("extra", pa.binary())])
    now: int | None = None
    total: np.ndarray | None = None
    seen: np.ndarray | None = None
    heads: list[tuple[bytes, bytes]] = []

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(now, None, None, i, x) for i, x in heads]
        if seen is not None and seen.any():
            at = np.flatnonzero(seen)
            rows.append((now, at.astype(np.uint16).tobytes(), total[at].tobytes(), None, None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        blocks = b.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        v = values(b)
        for a, z in zip(cuts, cuts[1:]):
            if blocks[a] != now:
                if now is not None:
                    yield from out()
                now, total, seen, heads = int(blocks[a]), None, None, []
            part = b.slice(a, z - a)
            if part.column("extra").null_count < len(part):
                heads += [(i, x) for i, x in zip(part.column("ids").to_pylist(), part.column("extra").to_pylist()) if x is not None]
            docs, lengths = unpacked(part.column("docs"), np.uint16)
            if not len(docs):
                continue
            docs, freqs = docs.astype(np.int64), unpacked(part.column("freqs"), np.uint32)[0]
            w = np.repeat(v[a:z], lengths, axis=0) * freqs[:, None]
            if total is None:
                total, seen = np.zeros((BLOCK_DOCS, v.shape[1])), np.zeros(BLOCK_DOCS, bool)
            seen[docs] = True
            for k in range(v.shape[1]):
                total[:, k] += np.bincount(docs, w[:, k], BLOCK_DOCS)
    if now is not None:
        yield from out()


def document_sums(partials: DataFrame, k: int) -> DataFrame:
    """One row a document: doc_id, extra double and sums array<double> (k of them), from the tasks' partial sums."""
    schema = pa.schema([("doc_id", pa.int64()), ("extra", pa.float64()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        rows: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            total = np.zeros((BLOCK_DOCS, k))
            for docs, sums, _, _ in rows:
                if docs is not None:
                    total[np.frombuffer(docs, np.uint16)] += np.frombuffer(sums, np.float64).reshape(-1, k)
            for _, _, ids, extra in rows:
                if ids is not None:
                    n = len(extra) // 8
                    flags = np.frombuffer(ids, np.uint8, n, 8 * n).astype(bool)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64, n), mask=flags), pa.array(np.frombuffer(extra, np.float64)), pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(total[:n].ravel()))], schema=schema)

        for b in batches:
            for block, *rest in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "sums", "ids", "extra"))):
                if block != now:
                    if now is not None:
                        yield from out()
                    now, rows = block, []
                rows.append(tuple(rest))
        if now is not None:
            yield from out()

    return partials.repartition("block").sortWithinPartitions("block").mapInArrow(run, "doc_id long, extra double, sums array<double>")


# ---------------------------------------------------------------- connected components

#: Nodes of the forest that a task holds.
FOREST = 2_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's edges by spanning forests of stars (node, smallest node it reaches here), each over :data:`FOREST` nodes at most."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> Iterator[pa.RecordBatch]:
        rows = [(x, find(x)) for x in list(parent) if find(x) != x]
        for i in range(0, len(rows), 50000):
            u, v = zip(*rows[i : i + 50000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        parent.clear()

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, z = find(u), find(v)
            if a != z:
                parent[max(a, z)] = min(a, z)
        if len(parent) > FOREST:
            yield from stars()
    yield from stars()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge table (u long, v long); component is the smallest node reached.

    Large-star/small-star rounds on the edges, each written to the shared folder. Every task first cuts its own
    edges to a spanning forest, so dense groups shrink before the first shuffle. No labels reach the driver.
    """
    now = stage(edges.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long"), "edges")
    for _ in range(most_rounds):
        # large star: every neighbour above a node is tied to the smallest of its neighbourhood; small star: the rest
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # written, so that Spark may split or broadcast the join on a hub
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u <> m").select("u", F.col("m").alias("v")))
        nxt = stage(large.where("u <> v").distinct().repartition("u").mapInArrow(_forest, "u long, v long"), "edges")
        tops = nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        drop_staged(now)
        drop_staged(least)
        now = nxt
        # done when every edge goes straight to a node that has no smaller neighbour, one edge a node
        if tops.isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError("components did not settle")
