"""Tables in HTML pages, those hidden in comments included."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType


def uncomment(html: Column) -> Column:
    """The page with its comment marks taken away, so that tables inside comments can be read."""
    return F.regexp_replace(html, "<!--|-->", "")


def comments(html: Column) -> Column:
    """The texts of a page's comments."""
    return F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))


def links(html: Column) -> Column:
    """The targets of a page's links."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def table_ids(html: Column) -> Column:
    """The ids of a page's tables, commented ones included."""
    return F.regexp_extract_all(uncomment(html), F.lit(r'<table\b[^>]*\bid="([^"]*)"'), F.lit(1))


def table_classes(html: Column) -> Column:
    """The classes of a page's tables that have any, commented ones included."""
    return F.regexp_extract_all(uncomment(html), F.lit(r'<table\b[^>]*\bclass="([^"]*)"'), F.lit(1))


class _Tables(HTMLParser):
    """Rows of cells of one table (by id; the first one without)."""

    def __init__(self, table_id: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.done = table_id, 0, False
        self.rows: list[list[tuple[str, str]]] = []
        self.cell: list[str] | None = None
        self.spans: dict[tuple[int, int], int] = {}
        self.kind, self.head, self.heads = "", False, set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table" and not self.done:
            if self.depth or self.wanted is None or dict(attrs).get("id") == self.wanted:
                self.depth += 1
        elif self.depth == 1:
            if tag == "tr":
                self._end_cell()
                self.rows.append([])
                if self.head:
                    self.heads.add(len(self.rows) - 1)
            elif tag in ("td", "th") and self.rows:
                self._end_cell()
                self.cell, self.kind = [], tag
                span = dict(attrs).get("colspan") or ""
                if span.isdecimal():
                    self.spans[len(self.rows) - 1, len(self.rows[-1])] = min(int(span), 1000)  # as in browsers
            elif tag == "thead":
                self.head = True

    def handle_endtag(self, tag: str) -> None:
        if not self.depth:
            return
        if tag == "table":
            self._end_cell()
            self.depth -= 1
            self.done = self.depth == 0
        elif self.depth == 1:
            if tag in ("td", "th", "tr"):
                self._end_cell()
            elif tag == "thead":
                self.head = False

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((self.kind, " ".join("".join(self.cell).split())))
            self.cell = None


def read_table(html: str, table_id: str | None = None) -> list[tuple[int, int, str, str, str]]:
    """(row, column, group, header, text) of each body cell.

    Headers are those of the last header row; a header's group is the cell of the row above that spans it, or empty.

    Header cells without a letter or digit are skipped, together with their column's name only: cells keep their
    place among the named headers of a row that has as many cells as there are named headers, else by position.
    """
    p = _Tables(table_id)
    p.feed(re.sub(r"<!--|-->", "", html or ""))
    p.close()
    heads = [i for i, r in enumerate(p.rows) if r and (i in p.heads or all(k == "th" for k, _ in r))]
    names = [t for _, t in p.rows[heads[-1]]] if heads else []
    groups = [t for j, (_, t) in enumerate(p.rows[heads[-2]]) for _ in range(p.spans.get((heads[-2], j), 1))] if len(heads) > 1 else []
    groups = [*groups[: len(names)], *[""] * (len(names) - len(groups))]
    head = list(zip(groups, names))
    named = [x for x in head if re.search(r"[^\W_]", x[1])]
    out, n = [], 0
    for i, cells in enumerate(p.rows):
        if i in heads or not cells:
            continue
        use = named if len(cells) == len(named) else head
        out += [(n, j, *(use[j] if j < len(use) else ("", f"col{j}")), text) for j, (_, text) in enumerate(cells)]
        n += 1
    return out


def extract_table(pages: DataFrame, html: str, table_id: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a body cell of each page's table: the kept columns, row, col, group, header, text. Pages without it have none."""
    src = pages.select(*keep, F.col(html).alias("_html"))
    schema = src.drop("_html").schema.add("row", IntegerType()).add("col", IntegerType()).add("group", StringType()).add("header", StringType()).add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [(i, *c) for i, h in enumerate(b.column(b.num_columns - 1).to_pylist()) for c in read_table(h, table_id)]
            at, row, col, group, header, text = zip(*cells) if cells else ([], [], [], [], [], [])
            kept = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(group, pa.string()), pa.array(header, pa.string()), pa.array(text, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
