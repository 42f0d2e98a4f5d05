"""Scalar text functions, all as column expressions. Null text counts as empty unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings dropped one after the other from a looked-up name.
LOOKUP_SUFFIXES = ("그룹", "계열사", "관계사", "업종", "산업", "섹터", "기업", "회사")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean(c: Column | str) -> Column:
    """Collapses every run of Unicode white space to one space and trims."""
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def clean_block(c: Column | str) -> Column:
    """Keeps lines: no-break spaces become spaces, blanks within a line collapse, and so do blank lines."""
    spaced = F.regexp_replace(F.translate(_text(c), " ", " "), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r" *\r?\n *", "\n"), r"\n{3,}", "\n\n"))


def match_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_text(c)), "[^0-9a-z가-힣]+", "")


def keys_overlap(a: Column, b: Column) -> Column:
    """Either contains the other; never when one is empty."""
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a))


def lookup_key(c: Column | str, suffixes: Sequence[str] = LOOKUP_SUFFIXES) -> Column:
    out = F.regexp_replace(F.lower(_text(c)), r"(?U)\s+", "")
    for s in suffixes:
        out = F.regexp_replace(out, f"(.+){s}$", "$1")
    return out


def alias_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(_text(c)), r"[\s\p{Punct}·]+", "")


def free_key(c: Column | str) -> Column:
    return clean(F.lower(_text(c)))


def strip_particles(c: Column | str, particles: Sequence[str]) -> Column:
    ordered = sorted(particles, key=len, reverse=True)
    return F.regexp_replace(_text(c), f"(?<=.)(?:{'|'.join(ordered)})$", "")


def tokens(c: Column | str, least: int = 2) -> Column:
    """Ordered distinct tokens of letters, digits and percent signs of at least that length, lowered."""
    found = F.regexp_extract_all(F.lower(_text(c)), F.lit("[가-힣A-Za-z0-9%]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= least))


def dense_key(c: Column | str) -> Column:
    """Lowered, without blanks and separators, so that spaced and unspaced forms of a term meet."""
    return F.regexp_replace(F.lower(_text(c)), r"[\s\-_()/\[\]{}]+", "")


def field_name(c: Column | str) -> Column:
    """Without leading bullets or numbering."""
    return clean(F.regexp_replace(_text(c), r"^[\s\-*•※▶■□○●]*(?:\(?\d{1,2}[.)]\s*)?", ""))


def field_key(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(field_name(c), "ㆍ‧・•", "····"), r"(?U)\s+", "")


def first_rule(c: Column | str, rules: Sequence[tuple[str, str]], default: Column | None = None) -> Column:
    """The value of the first rule whose text is contained."""
    text = _text(c)
    out = None
    for part, value in rules:
        hit = F.contains(text, F.lit(part))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return text if out is None else out.otherwise(text if default is None else default)


def mapped(c: Column | str, names: Mapping[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), _text(c)), default) if pairs else default


def metadata_text(values: Column) -> Column:
    """An array as one text, entries divided by bars; null entries are empty."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v.cast("string"), F.lit(""))), " | ")


def table_number(chunk_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_text(chunk_id), r"_table_(\d+)(?:_part_(\d+))?$", 1), F.lit("")).try_cast("int")


def part_number(chunk_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_text(chunk_id), r"_table_(\d+)_part_(\d+)$", 2), F.lit("")).try_cast("int")


def narrative_number(chunk_id: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_text(chunk_id), r"_narrative_(\d+)$", 1), F.lit("")).try_cast("int")


def receipt_number(c: Column | str) -> Column:
    """The first run of exactly 14 digits; null without one."""
    return F.nullif(F.regexp_extract(_text(c), r"(?<!\d)(\d{14})(?!\d)", 1), F.lit(""))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def common_prefix(texts: Column, least: int = 20, most: int = 400) -> Column:
    """Longest common beginning of at most that many characters, cut at its last blank; empty if shorter than least."""

    def shared(heads: Column, first: Column) -> Column:
        alike = F.filter(F.sequence(F.lit(0), F.length(first)), lambda n: once(F.substring(first, F.lit(1), n), lambda own: F.forall(heads, lambda t: F.startswith(t, own))))
        return once(F.substring(first, F.lit(1), F.array_max(alike)), lambda head: F.when(F.forall(heads, lambda t: t == head), head).otherwise(F.regexp_extract(head, r"(?s)^(.*\s)", 1)))

    cut = once(F.transform(texts, lambda t: F.substring(t, 1, most)), lambda heads: once(F.element_at(heads, 1), lambda first: shared(heads, first)))
    return once(cut, lambda c: F.when((F.size(texts) > 1) & (F.length(c) >= least), c).otherwise(F.lit("")))


def join_parts(texts: Column, most: int = 10_000, mark: str = "\n…") -> Column:
    """Parts in order, one a line, each but the first without the beginning they share; cut with a mark if too long."""
    rest = lambda t, lead: F.when((F.length(lead) > 0) & F.startswith(t, lead), F.substring(t, F.length(lead) + 1, F.length(t))).otherwise(t)
    joined = once(common_prefix(texts), lambda lead: F.array_join(F.transform(texts, lambda t, i: F.when(i > 0, rest(t, lead)).otherwise(t)), "\n"))
    return once(joined, lambda j: F.when(F.length(j) > most, F.concat(F.substring(j, 1, most), F.lit(mark))).otherwise(j))


def snippet(c: Column | str, term: str | Column, width: int = 180) -> Column:
    """The text around the first hit of the term, case ignored; empty without a hit."""
    text, term = _text(c), F.lit(term) if isinstance(term, str) else term
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(at - width, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + F.length(term) + width - start)).otherwise(F.lit(""))


def row_line(cells: Column) -> Column:
    return F.array_join(cells, " | ")


def compress_cells(cells: Column) -> Column:
    """Without empty cells and without cells equal to the one before."""
    full = F.filter(cells, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.filter(full, lambda x, i: (i == 0) | (x != F.get(full, F.greatest(i - 1, F.lit(0)))))


def grid_text(rows: Column, preamble: Column | None = None) -> Column:
    lines = F.array_join(F.transform(rows, lambda r: F.array_join(compress_cells(r), " | ")), "\n")
    return lines if preamble is None else F.concat_ws("\n", preamble, lines)


def flatten_headers(rows: Column, count: Column) -> Column:
    """One name a column: its header cells, equal neighbours once, joined by underscores."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    heads = F.slice(rows, F.lit(1), count)
    columns = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(columns, lambda k: F.array_join(compress_cells(F.transform(heads, lambda r: F.get(r, k))), "_"))


def unique_texts(values: Column) -> Column:
    """Trimmed, non-empty, distinct, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != ""))


def safe_file_name(c: Column | str, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(_text(c), r"[^0-9A-Za-z가-힣._-]+", "_"), 1, most)


def json_object(c: Column | str, schema: str) -> Column:
    """The first object of a model's reply: fences and prose around it are dropped; null if nothing parses."""
    bare = F.regexp_replace(_text(c), r"```(?:json)?", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema)


def thousands(value: Column, unit: Column | None = None) -> Column:
    shown = F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, 2))
    return shown if unit is None else F.concat(shown, F.coalesce(unit, F.lit("")))
