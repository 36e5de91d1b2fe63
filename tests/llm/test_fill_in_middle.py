import hashlib
import re

import pytest
from pyspark.sql import functions as F

from statloom.llm.fill_in_middle import fill_in_middle, restored, two_ends

from ..oracle import connect, same
from .util import corpus, frame


def plain(doc_id, text, seed="7", rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, z = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [*corpus(3, 60), "\n", "\n\n\n", "a\r\nb\r\n", "x<P>y\nz", "ends <S", "<", "<P\n>S>\n<M", "é\n日本\n🙂", "line\n" * 100_000, "no line feed " * 50_000, None, ""]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 100), (0, 0)])
def test_equals_plain_version_and_comes_back(spark, rate, spm):
    docs = list(enumerate(TEXTS))
    out = fill_in_middle(frame(spark, docs, 4), rate=rate, spm_rate=spm)
    rows = {r.doc_id: r for r in out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()}
    assert set(rows) == {k for k, _ in docs}
    for k, t in docs:
        r = rows[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(k, t or "", rate=rate, spm=spm)
        assert r.back == (t or "")
    assert {r.form for r in rows.values()} >= ({"plain", "psm", "spm"} if (rate, spm) == (100, 50) else {"plain"})


def test_repeated_rows_null_ids_other_marks_and_empty_tables(spark):
    rows = fill_in_middle(frame(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "q\nr"), (2, None)], 2), marks=("⟨p⟩", "⟨s⟩", "⟨m⟩")).collect()
    assert len(rows) == 4 and len({r.output for r in rows if r.doc_id == 1}) == 1
    assert all("⟨s⟩" in r.output for r in rows if r.form != "plain")
    empty = fill_in_middle(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def test_marks_that_could_be_confused_are_refused(spark):
    for marks in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">S", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError, match="confused"):
            fill_in_middle(frame(spark, ["a"]), marks=marks)


def test_second_pass_stops_at_the_later_end():
    class Matches:
        taken = 0

        def finditer(self, text):
            for m in re.finditer(r"[^\n]*\n|[^\n]+", text):
                self.taken += 1
                yield m

    unit = Matches()
    assert two_ends(unit, "aa\nb\nccc\nd\n", 1, 3) == (3, 9) and unit.taken == 3
    assert two_ends(unit, "aa\nb\n", 0, 0) == (0, 0) and two_ends(unit, "aa\nb", 2, 2) == (4, 4)


def test_sql_on_awkward_rows(spark):
    from statloom.llm import queries

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t is None or "\x00" not in t] + [(None, "a\nb")], "doc_id long, text string")
    out = fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    c = connect()
    c.execute("DROP VIEW documents")
    c.register("documents", docs.toArrow())
    same(out, queries.oracle_sql()["op11_fill_in_middle"], c)
