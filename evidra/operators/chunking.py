"""From markup to chunks: tables and sections, splitting and packing, field records, validity and audits.

Markup is parsed by Python table functions (one document at a time, whole); everything after that is columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Cell tags, section tags, and what numbers a subtitle.
CELLS = ("th", "td", "te")
SECTION = re.compile(r"^section-\d+$", re.I)
SUBTITLE = re.compile(r"^\s*(?:\(\d+\)|\d+\)|[가-힣]\.|[가-힣]\))\s*")
#: Fixed values in characters: whole tables, table parts, sentences' target and limit, tail; sentences repeated; fields of a chunk.
TABLE_WHOLE, TABLE_PART = 1500, 1000
TARGET, LIMIT, TAIL, OVERLAP = 600, 900, 100, 1
FIELDS, LONG_VALUE = 12, 700
_BLANK = re.compile(r"\s+")


class _Markup(HTMLParser):
    """Collects tables (rows of cells with their spans) and paragraphs (with section titles), in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[tuple[str, Any]] = []
        self.tables: list[dict[str, Any]] = []
        self.titles: list[tuple[int, str]] = []
        self.buffer: list[str] = []
        self.kind: str | None = None
        self.skip = 0

    def _flush(self) -> None:
        text = _BLANK.sub(" ", "".join(self.buffer)).strip()
        self.buffer = []
        if text and not self.tables:
            if self.kind == "title":
                level = self.titles[-1][0] if self.titles else 1
                self.titles = [*[t for t in self.titles if t[0] < level], (level, text)]
            else:
                self.items.append(("text", (" > ".join(t for _, t in self.titles if t), text)))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        got = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self._flush()
            self.tables.append({"rows": [], "heads": 0, "head": False, "cell": None})
        elif self.tables:
            table = self.tables[-1]
            if tag == "thead":
                table["head"] = True
            elif tag == "tr":
                self._end_cell()
                table["rows"].append([])
                table["heads"] += table["head"]
            elif tag in CELLS:
                self._end_cell()
                if not table["rows"]:
                    table["rows"].append([])
                span = lambda k: max(1, int(v)) if (v := (got.get(k) or "").strip()).isdigit() else 1
                table["cell"] = [[], min(span("rowspan"), 1000), min(span("colspan"), 1000)]
            elif tag == "br" and table["cell"]:
                table["cell"][0].append(" ")
        elif SECTION.match(tag):
            self._flush()
            self.titles = [*[t for t in self.titles if t[0] < int(tag.split("-")[1])], (int(tag.split("-")[1]), "")]
        elif tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._flush()
            if tag[0] == "h":
                self.titles = [*[t for t in self.titles if t[0] < int(tag[1])], (int(tag[1]), "")]
            self.kind = "title"
        elif tag in ("p", "div", "li", "br", "section", "article", "body", "ul", "ol", "main", "header", "footer", "nav"):
            self._flush()
            self.kind = None

    def _end_cell(self) -> None:
        table = self.tables[-1]
        if table["cell"]:
            parts, down, across = table["cell"]
            table["rows"][-1].append((_BLANK.sub(" ", "".join(parts)).strip(), down, across))
            table["cell"] = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif self.tables:
            if tag == "thead":
                self.tables[-1]["head"] = False
            elif tag in CELLS or tag == "tr":
                self._end_cell()
            elif tag == "table":
                self._end_cell()
                done = self.tables.pop()
                if not self.tables:
                    self.items.append(("table", done))
        elif tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "li", "body", "section", "article"):
            self._flush()
            self.kind = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.tables:
            if self.tables[-1]["cell"]:
                self.tables[-1]["cell"][0].append(data)
        else:
            self.buffer.append(data)

    def close(self) -> None:
        super().close()
        while self.tables:
            self.handle_endtag("table")
        self._flush()


def parse_markup(markup: str | None) -> list[tuple[str, Any]]:
    """('text', (section path, paragraph)) and ('table', raw table) items; null gives none; tags left open are closed."""
    parser = _Markup()
    parser.feed(re.sub(r"(?s)<\?.*?\?>|<!--.*?-->", "", markup or ""))
    parser.close()
    return parser.items


def expand_grid(rows: Sequence[Sequence[tuple[str, int, int]]]) -> list[list[str]]:
    """The full grid of cells (text, rowspan, colspan): spans filled in, empty rows dropped, rows padded alike."""
    carried: dict[int, tuple[str, int]] = {}
    grid: list[list[str]] = []
    for row in rows:
        line: dict[int, str] = {}
        at = 0

        def fill(at: int, line: dict[int, str]) -> int:
            while at in carried:
                text, left = carried[at]
                line[at] = text
                if left > 1:
                    carried[at] = (text, left - 1)
                else:
                    del carried[at]
                at += 1
            return at

        for text, down, across in row:
            at = fill(at, line)
            for _ in range(across):
                line[at] = text
                if down > 1:
                    carried[at] = (text, down - 1)
                at += 1
        for k in sorted(k for k in carried if k >= at):
            at = fill(k, line)
        grid.append([line.get(k, "") for k in range(max(line, default=-1) + 1)])
    grid = [r for r in grid if any(r)]
    width = max(map(len, grid), default=0)
    return [r + [""] * (width - len(r)) for r in grid]


def split_table(grid: list[list[str]], heads: int, preamble: str = "", whole: int = TABLE_WHOLE, part: int = TABLE_PART) -> list[dict[str, Any]]:
    """Parts (first_row, last_row, oversized, rows): rows are never cut, the header is repeated, rows count from 1."""

    def size(rows: list[list[str]]) -> int:
        return len(preamble) + sum(len(" | ".join(r)) + 1 for r in rows)

    if size(grid) <= whole:
        return [{"first_row": 1, "last_row": len(grid), "oversized": False, "rows": grid}]
    header, out, held, start = grid[:heads], [], [], heads + 1

    def flush(last: int, oversized: bool = False) -> None:
        nonlocal held, start
        if held:
            out.append({"first_row": start, "last_row": last, "oversized": oversized, "rows": header + held})
        held, start = [], last + 1

    for k, row in enumerate(grid[heads:], heads + 1):
        if held and size(header + held + [row]) > whole:
            flush(k - 1)
        held.append(row)
        if len(held) == 1 and size(header + held) > whole:
            flush(k, True)
        elif size(header + held) >= part:
            flush(k)
    flush(len(grid))
    return out


class TableParts:
    """(table_index, part, first_row, last_row, heads, oversized, grid) of each meaningful table of a document."""

    def eval(self, markup: str | None) -> Iterator[tuple[Any, ...]]:
        for k, raw in enumerate((x for kind, x in parse_markup(markup) if kind == "table"), 1):
            grid = expand_grid(raw["rows"])
            full = [c for r in grid for c in r if c]
            if len(grid) < 2 or len(full) < 4 or sum(map(len, full)) < 10:
                continue
            heads = min(3, raw["heads"]) or 1
            for n, p in enumerate(split_table(grid, min(heads, len(grid) - 1)), 1):
                yield k, n, p["first_row"], p["last_row"], heads, p["oversized"], p["rows"]


class Paragraphs:
    """(number, section, subtitle, paragraph) of a document's running text."""

    def eval(self, markup: str | None) -> Iterator[tuple[Any, ...]]:
        subtitle = ""
        for k, (section, text) in enumerate((x for kind, x in parse_markup(markup) if kind == "text"), 1):
            if SUBTITLE.match(text) and len(text) <= 120:
                subtitle = text
            yield k, section, subtitle, text


TABLE_TYPE = "table_index int, part int, first_row int, last_row int, heads int, oversized boolean, grid array<array<string>>"
PARAGRAPH_TYPE = "number int, section string, subtitle string, paragraph string"


def register(spark: SparkSession) -> None:
    """Makes table_parts(markup) and paragraphs(markup) available to SQL and to the functions below."""
    spark.udtf.register("table_parts", F.udtf(TableParts, returnType=TABLE_TYPE))
    spark.udtf.register("paragraphs", F.udtf(Paragraphs, returnType=PARAGRAPH_TYPE))


def _lateral(docs: DataFrame, function: str, markup: str) -> DataFrame:
    register(docs.sparkSession)
    keep = ", ".join(f"d.`{c}`" for c in docs.columns if c != markup)
    return docs.sparkSession.sql(f"SELECT {keep}, t.* FROM {{d}} d, LATERAL {function}(d.`{markup}`) t", d=docs)


def table_parts(docs: DataFrame, markup: str) -> DataFrame:
    return _lateral(docs, "table_parts", markup)


def paragraphs(docs: DataFrame, markup: str) -> DataFrame:
    return _lateral(docs, "paragraphs", markup)


def split_sentences(c: Column, limit: int = LIMIT) -> Column:
    """Sentences after . ! ? and their wide form; longer ones are cut at the limit, at a blank where there is one."""
    parts = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"(?<=[.!?。])\s+"), lambda s: s != "")
    cut = F.transform(parts, lambda s: F.when(F.length(s) <= limit, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(rf"(?s)(.{{1,{limit}}})(?:\s+|$)|(.{{1,{limit}}})"), F.lit(0))))
    return F.filter(F.transform(F.flatten(cut), lambda s: F.trim(s)), lambda s: s != "")


def pack_sentences(sentences: Column, target: int = TARGET, limit: int = LIMIT, tail: int = TAIL, overlap: bool = True) -> Column:
    """Chunks of sentences: emitted at the target or before the limit, starting with the last sentence of the one before.

    A remainder is a chunk if it is long enough and holds more than the repeated sentence.
    """
    kind = "struct<out:array<string>,held:array<string>,fresh:int>"
    size = lambda a: F.length(F.array_join(a, " "))

    def step(acc: Column, s: Column) -> Column:
        over = (F.size(acc["held"]) > 0) & (size(acc["held"]) + 1 + F.length(s) > limit)
        last = F.slice(acc["held"], -1, 1) if overlap else F.array().cast("array<string>")
        base = F.when(~over, acc["held"]).when(size(last) + 1 + F.length(s) > limit, F.array().cast("array<string>")).otherwise(last)
        out = F.when(over & (acc["fresh"] > 0), F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"])
        held = F.concat(base, F.array(s))
        full = size(held) >= target
        rest = F.array(s) if overlap else F.array().cast("array<string>")
        return F.struct(
            F.when(full, F.concat(out, F.array(F.array_join(held, " ")))).otherwise(out).alias("out"),
            F.when(full, rest).otherwise(held).alias("held"),
            F.when(full, 0).otherwise(F.when(over, 1).otherwise(acc["fresh"] + 1)).alias("fresh"),
        ).cast(kind)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("fresh")).cast(kind)
    end = lambda acc: F.when((acc["fresh"] > 0) & (size(acc["held"]) >= tail), F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"])
    return F.aggregate(sentences, start, step, end)


def narrative_chunks(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, chunk_index, chunk_id, chunk): packed sentences of each text; the chunk's id is a digest of id and text."""
    chunks = docs.select(id_column, F.posexplode(pack_sentences(split_sentences(F.col(text)))).alias("chunk_index", "chunk"))
    return chunks.withColumn("chunk_id", F.sha1(F.concat_ws(":", F.col(id_column).cast("string"), F.col("chunk")).cast("binary")))


def grid_fields(grid: Column) -> Column:
    """(name, value) of rows: two full cells are name and value; of more, all but the last name the value."""
    rows = F.transform(grid, lambda r: X.compress_cells(r))
    pairs = F.transform(F.filter(rows, lambda r: F.size(r) >= 2), lambda r: F.struct(F.array_join(F.slice(r, F.lit(1), F.size(r) - 1), " > ").alias("name"), F.element_at(r, -1).alias("value")))
    return F.filter(pairs, lambda p: (F.trim(p["name"]) != "") & (F.trim(p["value"]) != ""))


def fields_usable(fields: Column, rows: Column) -> Column:
    return (F.size(fields) >= 2) & (F.size(fields) * 2 >= F.size(rows))


def field_groups(fields: Column, most: int = FIELDS, long: int = LONG_VALUE) -> Column:
    """Arrays of at most ``most`` fields; a field with a long value is alone."""
    kind = "array<array<struct<name:string,value:string>>>"
    alone = lambda g: F.exists(g, lambda p: F.length(p["value"]) >= long)

    def step(acc: Column, p: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (F.length(p["value"]) < long) & (F.size(last) < most) & ~alone(last)
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, F.array(p))))).otherwise(F.concat(acc, F.array(F.array(p)))).cast(kind)

    return F.aggregate(fields, F.array().cast(kind), step)


def chunk_reason(chunk_id: Column, text: Column, *required: Column) -> Column:
    """Why a chunk is unusable, the first that applies, or ok."""
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    out = F.when(blank(chunk_id), "no_id").when(blank(text), "no_text").when(F.length(F.trim(text)) < 10, "too_short")
    for k, c in enumerate(required):
        out = out.when(blank(c), f"no_field_{k + 1}")
    return out.otherwise("ok")


def first_of_id(chunks: DataFrame, chunk_id: str, order: str) -> DataFrame:
    """The first chunk of each id."""
    w = Window.partitionBy(chunk_id).orderBy(order)
    return chunks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def islands(rows: DataFrame, keys: Sequence[str], order: str, value: str, text: str) -> DataFrame:
    """(keys..., island, value, texts): consecutive rows with the same value, their texts in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    marked = rows.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(w))
    return marked.groupBy(*keys, "island", value).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]).alias("texts"))


def search_priority(text: Column, kind: Column, title: Column | None = None) -> Column:
    """high, medium or low: by the kind of table first, then by numbers, length and title of general ones."""
    body = F.coalesce(text, F.lit(""))
    numbers = F.regexp_count(body, F.lit(r"\d[\d,.]*"))
    plain = F.when(numbers >= 3, "medium").when(F.length(body) < 80, "low")
    if title is not None:
        plain = plain.when(F.trim(title).isin(*LOW_VALUE_TITLES), "low")
    return F.when(kind.isin("financial_table", "business_table"), "high").when(kind == "governance_table", "medium").when(kind == "document_admin", "low").otherwise(plain.otherwise("medium"))


#: Titles of tables without content.
LOW_VALUE_TITLES = ("목 차", "목차")
GRID = T.ArrayType(T.ArrayType(T.StringType()))
