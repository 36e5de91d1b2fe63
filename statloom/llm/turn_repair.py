"""Repair of the turns of conversations with the fewest and least edits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Rows of a block: what one task holds of a conversation. Beyond it a conversation is several blocks, chained by their summaries.
BLOCK = 1 << 12

#: States of the rows kept so far, by initials: none, s, s?(ua)*u, s?(ua)+; where an initial leads; states that may end.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}
#: Costs: a row with another role, one deleted, one inserted, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = 1 << 60
#: What is left to insert at the end, by state.
_TAIL = ("", "ua", "a", "")
#: Pairs of initials that may be neighbours.
_PAIRS = ("su", "ua", "au")
_INSERTS = [(q, STEP[q, x]) for q in STATES for x in "ua" if (q, x) in STEP]

BLANK, DUPLICATE, CUT = 1, 2, 3


@lru_cache(maxsize=10_000)
def row_arcs(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """What can become of a row: (letter, state, state after, cost)."""
    out = [("D", q, q, DELETE) for q in STATES]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED * (fault == CUT)
        out += [("K", q, STEP[q, initial], more) for q in STATES if (q, initial) in STEP]
        out += [("R", q, STEP[q, x], REROLE + more) for q in STATES for x in ROLES if (q, x) in STEP]
    return out


def _settle(costs: list[int], arcs: list[tuple[int, int]]) -> list[int]:
    """Least costs when any number of inserts may follow (two reach every state)."""
    for _ in range(2):
        for a, z in arcs:
            costs[z] = min(costs[z], costs[a] + INSERT)
    return costs


def _ahead(costs: list[int], arcs: list[tuple[str, int, int, int]]) -> list[int]:
    """Least costs after a row, from those before it (inserts before the row included)."""
    before, out = _settle(list(costs), _INSERTS), [NEVER] * 4
    for _, a, z, c in arcs:
        out[z] = min(out[z], before[a] + c)
    return out


def _back(costs: list[int], arcs: list[tuple[str, int, int, int]]) -> list[int]:
    """Least costs from before a row to the end, from those after it."""
    out = [NEVER] * 4
    for _, a, z, c in arcs:
        out[a] = min(out[a], costs[z] + c)
    return _settle(out, [(z, a) for a, z in _INSERTS])


def block_matrix(rows: list[tuple[str, int]]) -> list[int]:
    """Least costs of a block from each state to each: 16 numbers. Rows are (initial, fault)."""
    m = [[0 if a == z else NEVER for z in STATES] for a in STATES]
    for initial, fault in rows:
        arcs = row_arcs(initial, fault)
        m = [_ahead(x, arcs) for x in m]
    return [min(c, NEVER) for x in m for c in x]


def chain(matrices: list[list[int]]) -> tuple[list[list[int]], list[list[int]]]:
    """Of a conversation's blocks in order: least costs from its start to before each, and from after each to its end."""
    ahead, now = [], [0, NEVER, NEVER, NEVER]
    for m in matrices:
        ahead.append(now)
        now = [min(min(now[a] + m[4 * a + z] for a in STATES), NEVER) for z in STATES]
    back, now = [], [INSERT * len(x) for x in _TAIL]
    for m in reversed(matrices):
        back.append(now)
        now = [min(min(m[4 * a + z] + now[z] for z in STATES), NEVER) for a in STATES]
    return ahead, back[::-1]


def walk(rows: list[tuple[str, int]], start: list[int], end: list[int]) -> dict[int, tuple[int, str]]:
    """For each state in which a cheapest repair can enter a block: the state it leaves in, and its letters within.

    Forward costs from ``start`` and backward costs from ``end`` tell which arcs lie on cheapest paths: those whose
    costs before, on and after them add up to the least of all. From the entry the least letter on such an arc is taken
    at each step by every state of the frontier together. No cheapest repair's letters begin another's, since letters
    fix costs and each insert costs something, so the least letter at each step gives the least word.
    """
    arcs = [row_arcs(*r) for r in rows]
    ahead, back = [start], [end]
    for x in arcs:
        ahead.append(_ahead(ahead[-1], x))
    for x in reversed(arcs):
        back.append(_back(back[-1], x))
    back.reverse()
    before = [_settle(list(c), _INSERTS) for c in ahead]
    least = min(b + c for b, c in zip(before[0], back[0]))
    out = {}
    for entry in STATES:
        if start[entry] + back[0][entry] != least:
            continue
        frontier, letters = {entry}, []
        for i, x in enumerate(arcs):
            while True:
                tight = [(n, z) for n, a, z, c in x if a in frontier and before[i][a] + c + back[i + 1][z] == least]
                tight += [("I", z) for a, z in _INSERTS if a in frontier and before[i][a] + INSERT + back[i][z] == least]
                letter = min(tight)[0]
                letters.append(letter)
                frontier = {z for n, z in tight if n == letter}
                if letter != "I":
                    break
        out[entry] = (min(frontier), "".join(letters))
    return out


def _by(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows that are equal in their first ``keys`` columns, one run at a time; rows come sorted."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for k, group in groupby(rows, key=lambda r: r[:keys]):
        yield k, list(group)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_LONGS = pa.list_(pa.int64())
_ARROW = {"string": pa.string(), "long": pa.int64(), "array<long>": _LONGS}


def _task(df: DataFrame, keys: int, work: Callable[[tuple, list[tuple]], Iterator[tuple]], columns: str) -> DataFrame:
    """Hand ``work`` one run of rows with equal first columns after another, and make a table of the rows it yields."""
    schema = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in columns.split(", "))])
    return df.mapInArrow(lambda batches: _batches((r for k, rows in _by(batches, keys) for r in work(k, rows)), schema), columns)


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.repartition("key", "block").sortWithinPartitions("key", "block", "at")


def _in_chains(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", "block", *more)


def _matrices(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(key, block), rows of (key, block, at, initial, fault): their summary."""
    inside = sum(a[3] + b[3] not in _PAIRS for a, b in zip(rows, rows[1:]))
    yield (*key, block_matrix([r[3:] for r in rows]), rows[0][3], rows[-1][3], inside)


def _chained(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(key), rows of (key, block, matrix, first, last, illegal): each block's costs before and after, and its illegal pairs with that to the next block."""
    ahead, back = chain([r[2] for r in rows])
    for i, r in enumerate(rows):
        seam = i + 1 < len(rows) and r[4] + rows[i + 1][3] not in _PAIRS
        yield (*key, r[1], ahead[i], back[i], r[5] + seam)


def _walked(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(key, block), rows of (key, block, at, initial, fault, start, end): a row for each state of entry."""
    for entry, (leaving, letters) in walk([r[3:5] for r in rows], rows[0][5], rows[0][6]).items():
        yield (*key, entry, leaving, letters)


def _entered(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(key), rows of (key, block, entry, leaving): the state in which each block is entered, and what the last one's end wants inserted."""
    state, blocks = 0, [(k, {r[2]: r[3] for r in group}) for k, group in groupby(rows, key=lambda r: r[1])]
    for i, (block, ways) in enumerate(blocks):
        entry, state = state, ways[state]
        yield (*key, block, entry, _TAIL[state] if i == len(blocks) - 1 else "")


def _edited(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
    """(key, block), rows of (key, block, at, role, text, fault, entry, letters, tail): a row for each edit."""
    _, _, at, *_, state, letters, tail = rows[0]
    todo, step = iter(rows), 0
    for step, letter in enumerate(letters + "I" * len(tail)):
        wanted = "u" if (state, "u") in STEP else "a"
        role, text, cost = ROLES[wanted], "", INSERT
        if letter != "I":
            _, _, at, was, text, fault, *_ = next(todo)
            if letter == "D":
                yield key[0], at, step, "D", None, None, DELETE
                continue
            cost = TRUNCATED * (fault == CUT) + REROLE * (letter == "R")
            if letter == "K":
                role, wanted = was, was[:1]
        state = STEP[state, wanted]
        yield key[0], at, step, letter, role, text, cost


def faults(text: Column, seen: Column) -> Column:
    """A row's first fault: 1 blank, 2 duplicate (``seen``: such a role and text came before), 3 truncated, 0 none."""
    ink = F.rtrim(text, F.lit(" \t\n\v\f\r"))
    return F.when(ink == "", BLANK).when(seen, DUPLICATE).when(~F.right(ink, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0).cast("long")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(edits, facts) of conversations, each taken by turn (null turns first; ties by role, then text).

    ``edits`` has a row for each edit of the cheapest repair: the conversation's id, ``at`` and ``step`` (its order),
    ``edit`` (K keep, R another role, D delete, I insert), ``role`` and ``text`` after it (null if deleted) and
    ``cost``. What stays has role initials ``(s?(ua)+)?``. Among cheapest repairs the one with the least letters, in
    ASCII order, is taken. ``facts`` has a row for each conversation: ``gaps`` in its turns, ``blank``, ``duplicate``
    and ``truncated`` rows, ``illegal`` neighbours.

    Rows are dealt by ranges of conversation, turn, role and text, so that a long conversation lies in several tasks,
    and at most :data:`BLOCK` rows of one are a block. A block's summary is the least cost from each of four states to
    each. Summaries are chained forward and backward (one row a block); then the arcs of cheapest paths are known, each
    block walks them from every state in which it can be entered, states are chained, and edits laid over the rows.
    Duplicates are found by an aggregate on conversation, role and text (by SHA-256). The staged tables serve both
    results and stay.

    Null roles and texts count as one space; rows with a null id are one conversation. A role's initial is its first
    character. Repeated rows are duplicates. Long texts are ordinary values. Other columns are left out; an empty table
    gives two empty ones.
    """
    space, kind = F.lit(" "), rows.schema[conv_col].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    conv = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias(conv_col)
    taken = rows.select(key.alias("key"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    order = ["key", F.asc_nulls_first("turn"), "role", "text"]
    dealt = taken.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order).drop("tie")
    base = stage(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", BLOCK.bit_length() - 1)), "turns")

    digest = F.sha2(F.concat_ws("\n", F.char_length("role").cast("string"), "role", "text"), 256).alias("digest")
    first = base.groupBy("key", digest).agg(F.min("at").alias("first"))
    seen = base.select("*", digest).join(first, ["key", "digest"])
    small = stage(seen.select("key", "block", "at", F.left("role", F.lit(1)).alias("initial"), faults(F.col("text"), F.col("at") > F.col("first")).alias("fault"), "turn"), "turn_faults")

    lines = small.drop("turn")
    summaries = _task(_in_blocks(lines), 2, _matrices, "key string, block long, matrix array<long>, first string, last string, illegal long")
    ends = stage(_task(_in_chains(summaries), 1, _chained, "key string, block long, start array<long>, end array<long>, illegal long"), "turn_ends")
    walks = stage(_task(_in_blocks(lines.join(ends.drop("illegal"), ["key", "block"])), 2, _walked, "key string, block long, entry long, leaving long, letters string"), "turn_walks")
    entries = _task(_in_chains(walks.drop("letters"), "entry"), 1, _entered, "key string, block long, entry long, tail string")
    ways = entries.join(walks.drop("leaving"), ["key", "block", "entry"])
    laid = base.join(small.select("at", "fault"), "at").join(ways, ["key", "block"]).select("key", "block", "at", "role", "text", "fault", "entry", "letters", "tail")
    edits = _task(_in_blocks(laid), 2, _edited, "key string, at long, step long, edit string, role string, text string, cost long")

    count = lambda f: F.count_if(F.col("fault") == f)
    facts = small.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT).alias("truncated")
    )
    facts = facts.join(ends.groupBy("key").agg(F.sum("illegal").alias("illegal")), "key")
    return edits.select(conv, *edits.columns[1:]), facts.select(conv, *facts.columns[1:])


def repair_digests(edits: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation: ``cost``, ``audit`` (the edits' letters) and ``repaired_sha256`` of its ``role:text`` lines, joined by line feeds.

    A digest is made in order, so that one task reads a conversation's edits; it hashes them as they come and holds one
    letter for each.
    """
    kind = edits.schema[conv_col].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    schema = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            every = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
            for k, group in groupby(every, key=lambda r: r[0]):
                made, letters, total, between = hashlib.sha256(), bytearray(), 0, b""
                for _, _, _, letter, role, text, cost in group:
                    letters += letter.encode()
                    total += cost
                    if role is not None:
                        made.update(between + role.encode() + b":")
                        made.update(text.encode())
                        between = b"\n"
                yield k, total, letters.decode(), made.hexdigest()

        yield from _batches(rows(), schema)

    taken = edits.select(key.alias("key"), "at", "step", "edit", "role", "text", "cost")
    out = taken.repartition("key").sortWithinPartitions("key", "at", "step").mapInArrow(run, "key string, cost long, audit string, repaired_sha256 string")
    return out.select(F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias(conv_col), "cost", "audit", "repaired_sha256")
