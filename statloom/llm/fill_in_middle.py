"""Fill-in-middle rearrangement of texts, and back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

#: Units of a text: its lines, each with its line feed.
LINES = r"[^\n]*\n|[^\n]+"


def two_ends(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the units of ranks ``low`` and ``high`` (low <= high, counted from 1; 0: the start) end, by one lazy pass over the matches."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    return first, next(islice(matches, high - low - 1, None)).end() if high > low else first


def draws(seed: str, doc_id: object) -> tuple[int, ...]:
    """Four numbers below 2^32, drawn by the id alone (null: an empty one)."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in range(0, 32, 8))


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Three marks of which none holds, or begins with the end of, another or itself: so none can arise at a seam."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b) + (i != j))):
                raise ValueError(f"the marks {a!r} and {b!r} could be confused")
    return marks


def fill_in_middle(docs: DataFrame, seed: str = "7", rate: int = 100, spm_rate: int = 50, unit: str = LINES, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars`` (code points) and ``output``.

    A text falls into the units that ``unit`` matches (they must cover it); two of their ends, drawn by the id, cut it
    into prefix, middle and suffix. psm is prefix, suffix, middle, each after its mark of ``marks``; spm is suffix,
    prefix, middle; ``rate`` of 100 texts are cut, and ``spm_rate`` of 100 of these are spm. All else is plain: the text
    as it is, with null lengths. So are empty texts and texts that hold a mark.

    A first pass over the matches counts them, a second walks a lazy iterator to both ends, so that besides the text
    and its output a row takes constant memory, however many units it has. Null texts count as empty, with an empty
    output; null and repeated ids keep a row each; other columns are left out. No shuffle.
    """
    p, s, m = _checked(marks)
    units = re.compile(unit)
    schema = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def one(doc_id: object, text: str) -> tuple:
        n = sum(1 for _ in units.finditer(text))
        h1, h2, h3, h4 = draws(seed, doc_id)
        if not text or any(x in text for x in marks) or h3 % 100 >= rate:
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, z = two_ends(units, text, low, high)
        if h4 % 100 < spm_rate:
            return n, "spm", a, z - a, "".join((s, text[z:], p, text[:a], m, text[a:z]))
        return n, "psm", a, z - a, "".join((p, text[:a], s, text[z:], m, text[a:z]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, 1):
            rows = [one(i, t or "") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types))], names=["id", *schema.names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that :func:`fill_in_middle` rearranged, from its output and form (null if either is).

    Each mark occurs once in a rearranged output, since the text holds none and none can arise at a seam.
    """
    p, s, m = _checked(marks)

    def three(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(m) + 1)

    a, b, c = three(p, s)
    x, y, z = three(s, p)
    return F.when(form == "psm", F.concat(a, c, b)).when(form == "spm", F.concat(y, z, x)).when(form == "plain", output)
