import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from statloom.llm import queries, turn_repair
from statloom.llm.turn_repair import block_matrix, chain, repair_conversations, repair_digests, walk

from ..oracle import connect, same

COLUMNS = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def conversation(rng, n, conv=0):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ubiquitous"]
    texts = ["Yes.", "No!", "why?", "cut off", " \t", "", None, "a. ", "b.\n", "Yes."]
    return [(conv, rng.choice([k, k, k, k // 2, None]), rng.choice(roles), rng.choice([*texts, f"text {k}."])) for k in range(n)]


def faults(rows):
    """Rows in order with their first fault."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    out, seen = [], set()
    for t, r, x in rows:
        ink = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
        out.append((t, r, x, 1 if not ink else 2 if (r, x) in seen else 3 if ink[-1] not in ".!?" else 0))
        seen.add((r, x))
    return out


def brute(rows):
    """The least (cost, letters) by a search over all edits, cheapest and least first; the states are the initials themselves."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, letters, i, initials, kept = heapq.heappop(heap)
        if i == len(rows) and GOOD.fullmatch(initials):
            return cost, letters, "\n".join(kept)
        state = (i, "s" if initials == "s" else initials[-2:] if len(initials) > 1 else initials)
        if (state, letters) in done or cost > 3 * len(rows):
            continue
        done.add((state, letters))
        nexts = [("I", x, 2, (x, "")) for x in ("user", "assistant")]
        if i < len(rows):
            _, r, x, fault = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, initials, kept))
            if fault not in (1, 2):
                nexts += [("K", r, fault == 3, (r, x)), *(("R", y, 2 + (fault == 3), (y, x)) for y in ("user", "assistant"))]
        for letter, role, c, line in nexts:
            made = initials + role[:1]
            if role[:1] and any(GOOD.fullmatch(made + z) for z in ("", "a", "ua")):
                heapq.heappush(heap, (cost + c, letters + letter, i + (letter != "I"), made, (*kept, f"{line[0]}:{line[1]}")))


def facts(rows):
    turns = {t for t, *_ in rows if t is not None}
    count = lambda k: sum(f == k for *_, f in rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0), count(1), count(2), count(3), illegal


@pytest.mark.parametrize("block", [2, 4096])
def test_equals_brute_force_in_one_or_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rng = random.Random(block)
    talks = {k: conversation(rng, rng.randrange(1, 9), k) for k in range(60)} | {None: conversation(rng, 6, None)}
    edits, found = repair_conversations(spark.createDataFrame([r for t in talks.values() for r in t], COLUMNS).withColumn("key", F.lit(1)).withColumn("at", F.lit(2)).repartition(5))
    digests = {r.conv_id: r for r in repair_digests(edits).collect()}
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) for r in found.collect()}
    assert set(digests) == set(found) == set(talks)
    for k, rows in talks.items():
        rows = faults(rows)
        cost, letters, text = brute(rows)
        assert (digests[k].cost, digests[k].audit, digests[k].repaired_sha256) == (cost, letters, hashlib.sha256(text.encode()).hexdigest()), k
        assert found[k] == facts(rows)


def test_blocks_of_any_size_give_the_same_walk():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.choice("uasx"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 12))]
        whole = walk(rows, [0] + [turn_repair.NEVER] * 3, [0, 4, 2, 0])[0]
        k = rng.randrange(1, 4)
        parts = [rows[i : i + k] for i in range(0, len(rows), k)]
        ahead, back = chain([block_matrix(p) for p in parts])
        state, letters = 0, ""
        for p, a, z in zip(parts, ahead, back):
            state, more = walk(p, a, z)[state]
            letters += more
        assert (state, letters) == whole


def test_one_long_conversation_and_long_texts(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(20_000) if k % 1000 != 5] + [(7, 20_000, "user", "x" * 300_000 + "."), (7, 20_001, "assistant", " " * 300_000 + "y")]
    edits, found = repair_conversations(spark.createDataFrame(rows, COLUMNS).repartition(6))
    r, f = repair_digests(edits).first(), found.first()
    assert (f.gaps, f.blank, f.duplicate, f.truncated, f.illegal) == (20, 0, 0, 1, 20)
    assert len(r.audit.replace("I", "")) == len(rows) and r.cost == 20 * 2 + 1 and r.audit.count("I") == 20
    assert edits.groupBy("edit").count().count() == 2


def test_repeated_rows_and_empty_tables(spark):
    edits, found = repair_conversations(spark.createDataFrame([(1, 1, "user", "a.")] * 3 + [(1, 2, "assistant", "b.")], COLUMNS))
    assert repair_digests(edits).first().audit == "KDDK" and found.first().duplicate == 2
    edits, found = repair_conversations(spark.createDataFrame([], COLUMNS))
    assert edits.count() == 0 and found.count() == 0 and repair_digests(edits).count() == 0


def test_text_ids(spark):
    edits, _ = repair_conversations(spark.createDataFrame([("x", 1, "user", "a."), ("", 1, "assistant", "b."), (None, 1, "user", "c.")], "conv_id string, turn int, role string, text string"))
    assert {r.conv_id: r.audit for r in repair_digests(edits).collect()} == {"x": "KI", "": "IK", None: "KI"}


def test_sql_on_awkward_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [r for k in range(40) for r in conversation(rng, rng.randrange(1, 8), k)] + conversation(rng, 5, None) + [(99, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    c = connect()
    c.execute("DROP VIEW conversations")
    c.register("conversations", df.toArrow())
    same(queries.op12_turn_repair(spark, str(tmp_path)), queries.oracle_sql()["op12_turn_repair"], c)
