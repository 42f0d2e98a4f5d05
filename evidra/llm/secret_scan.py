"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regex yields a Boolean trigram query (an OR of ANDs). The index holds, for every trigram that some rule
asks for, the documents that contain it; intersecting postings gives each rule's candidates, and only those are
verified by the regex itself. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from re import _parser as sre  # the standard library's own regex parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import named
from .common import stored


@dataclass(frozen=True)
class Rule:
    """kind, regex (same meaning in Java and Python), and the least length in code points of the given group."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The three base kinds, in the order that breaks ties between spans; then what this scan adds.
BASE = (Rule("assign", _ASSIGN, 2, 12), Rule("access", "AKIA[A-Z0-9]+", 0, 18), Rule("hex", "[0-9a-f]+", 0, 16))
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = BASE + ADDED
#: Alternatives followed at most before a part of a regex counts as "anything", which only widens the candidates.
MOST = 64

Conjunctions = frozenset[frozenset[str]]
ANY: Conjunctions = frozenset([frozenset()])


def _least(query: Conjunctions) -> Conjunctions:
    """Without conjunctions that another one implies."""
    return frozenset(c for c in query if not any(d < c for d in query))


def _both(a: Conjunctions, b: Conjunctions) -> Conjunctions:
    return _least(frozenset(x | y for x, y in product(a, b))) if len(a) * len(b) <= MOST**2 else min(a, b, key=len)


def _of(strings: set[str]) -> Conjunctions:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _walk(items: Sequence) -> tuple[set[str] | None, Conjunctions]:
    """(all strings of a parsed part, or None) and its trigram query."""
    run, query, exact = {""}, ANY, True
    for op, arg in items:
        name, strings, inner = str(op), None, ANY
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN":
            chars: set[str] | None = set()
            for kind, value in arg:
                span = {"LITERAL": lambda v: (v, v), "RANGE": lambda v: v}.get(str(kind))
                if span is None or span(value)[1] - span(value)[0] >= 16 or chars is None:
                    chars = None
                else:
                    lo, hi = span(value)
                    chars |= {chr(c).lower() for c in range(lo, hi + 1)}
            strings = chars if chars and len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            strings, inner = _walk(arg[3])
        elif name == "BRANCH":
            parts = [_walk(x) for x in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*[s for s, _ in parts])
            inner = _least(frozenset().union(*[q for _, q in parts]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            got, least = _walk(body)
            inner = least if low else ANY
            if got is not None and len(got) ** max(1, int(low)) <= MOST:
                fixed = {"".join(x) for x in product(got, repeat=int(low))}
                if low == high:
                    strings = fixed
                elif (low, high) == (0, 1):
                    strings = {""} | got
                elif low:
                    inner = _of(fixed)
        if strings is not None and len(strings) > MOST:
            strings, inner = None, _both(inner, _of(strings))
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        query, exact = _both(query, _both(_of(run), inner if strings is None else _of(strings))), False
        run = {""}
    return (run if exact else None), _both(query, _of(run))


def trigram_query(regex: str) -> list[list[str]] | None:
    """The lower-case trigrams any match must contain, as an OR of ANDs; None if some match needs none."""
    query = _walk(sre.parse(regex))[1]
    return None if frozenset() in query else sorted(sorted(c) for c in query)


def _one_of(grams: Sequence[str]) -> str:
    """A regex that finds every overlapping occurrence of the trigrams, branching by their first character."""
    by: dict[str, list[str]] = {}
    for g in sorted(grams):
        by.setdefault(g[0], []).append(g[1:])
    return "(?=(" + "|".join(f"{re.escape(a)}(?:{'|'.join(map(re.escape, rest))})" for a, rest in by.items()) + "))"


#: Candidate ids (with the names of their rules) that are broadcast; with more, texts are shuffled to them.
SENT = 200_000


def index(docs: DataFrame, rules: Sequence[Rule], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, id) of the trigrams the rules ask for; one row for each trigram of a text at most."""
    grams = sorted({g for r in rules for c in trigram_query(r.regex) or [] for g in c})
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(_one_of(grams)), F.lit(1)) if grams else F.array().cast("array<string>")
    return docs.select(F.col(id_column).alias("id"), F.explode(F.array_distinct(found)).alias("gram"))


def candidates(postings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(id, kinds): the rules whose trigram query the postings of id satisfy."""
    terms = [(g, r.kind, k, len(c)) for r in rules for k, c in enumerate(trigram_query(r.regex) or []) for g in c]
    asked = postings.sparkSession.createDataFrame(terms, "gram string, kind string, part int, need int")
    met = postings.join(F.broadcast(asked), "gram").groupBy("id", "kind", "part", "need").count().where("count >= need")
    return met.groupBy("id").agg(F.collect_set("kind").alias("kinds"))


#: Values that are folded one by one within a block, and how often blocks are blocked again: a million spans of a text
#: take some 100 million steps. Another level would cost every query's planning more than it saves such a text.
BLOCK, LEVELS = 128, 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(values: Column, step: Callable[[Column, Column], Column], zero: int = 0, levels: int = LEVELS) -> Column:
    """For each place of an array of whole numbers the fold of all values before it; step is associative, zero its unit.

    Blocks are folded, the folds of the blocks before each are found in the same way, and only within a block is every
    place folded by itself, so the work grows with the array and not with its square.
    """
    fold = lambda part: F.aggregate(part, F.lit(zero), step)
    within = lambda part, base: F.transform(part, lambda _, i: step(base, fold(F.slice(part, F.lit(1), i))))
    if not levels:
        return _let(values, lambda v: within(v, F.lit(zero)))
    cut = lambda v: F.when(F.size(v) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
    joined = lambda blocks: F.flatten(F.zip_with(blocks, before_each(F.transform(blocks, fold), step, zero, levels - 1), within))
    return _let(values, lambda v: F.when(F.size(v) <= BLOCK, within(v, F.lit(zero))).otherwise(_let(cut(v), joined)))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) in code points of the rule's matches, leftmost and non-overlapping."""
    regex = F.lit(rule.regex)
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    hits = lengths(F.regexp_extract_all(text, regex, F.lit(0)))
    sizes = lengths(F.regexp_extract_all(text, regex, F.lit(rule.group))) if rule.group else hits
    parts = F.struct(lengths(F.split(text, rule.regex, -1)).alias("gaps"), hits.alias("hits"), sizes.alias("sizes"))

    def placed(p: Column) -> Column:
        steps = F.transform(p["hits"], lambda h, i: F.get(p["gaps"], i) + h)
        start = lambda before, i: F.get(before, i) + F.get(p["gaps"], i)
        span = lambda before: F.transform(p["hits"], lambda h, i: F.struct(start(before, i).alias("start"), F.lit(order).alias("order"), (start(before, i) + h).alias("end"), F.get(p["sizes"], i).alias("size")))
        return F.filter(_let(before_each(steps, lambda a, b: a + b), span), lambda x: x["size"] >= rule.least)

    return _let(parts, placed)


def _quick(rule: Rule) -> str:
    """The regex, with a final class run stretched to the least length where that finds the same spans."""
    run = re.fullmatch(r"([A-Za-z]*)(\[[^\]]+\])\+", rule.regex)
    return f"{run[1]}{run[2]}{{{rule.least - len(run[1])},}}" if run and not rule.group else rule.regex


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., found): found is the sorted array of (start, order, end), order being the rule's position.

    One row for each input row. Null and empty texts have no spans. Rows that repeat an id share its candidates (a
    wider set), and each is verified by itself. Kinds may overlap; spans of one kind never do. Columns of docs other
    than those named are not read, so their names cannot clash.
    """
    source = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), *[named(c).alias(f"_keep_{c}") for c in keep])
    indexed = [r for r in rules if trigram_query(r.regex) is not None]
    postings = stored(index(source, indexed, "_id", "_text"), "secret-postings")
    chosen = stored(candidates(postings, indexed), "secret-candidates")
    if chosen.count() <= SENT:  # the texts stay where they are
        chosen = F.broadcast(chosen)
    joined = source.join(chosen, F.col("_id").eqNullSafe(F.col("id")), "left").drop("id")
    empty = F.array().cast("array<struct<start:int,order:int,end:int>>")
    spans = []
    for order, rule in enumerate(rules):
        quick = Rule(rule.kind, _quick(rule), rule.group, rule.least)
        asked = F.col("_text").rlike(quick.regex)
        if rule in indexed:
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & asked
        spans.append(F.when(asked, F.transform(_spans(F.col("_text"), quick, order), lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end")))).otherwise(empty))
    return joined.select(F.col("_id").alias(id_column), *[named(f"_keep_{c}").alias(c) for c in keep], F.sort_array(F.concat(*spans)).alias("found"))


def _listed(found: Column, rules: Sequence[Rule]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(kinds, x["order"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span (overlapping ones merged) replaced by the mark; all columns and rows stay, whatever their names.

    Null and empty texts stay as they are; rows that repeat an id or a text are each rebuilt from their own spans. Texts
    of any length and number of spans take time in proportion. An empty table gives an empty one.
    """
    packed = docs.select(id_column, text, F.struct(*[named(c) for c in docs.columns]).alias("_row"))
    hits = scan(packed, rules, id_column, text, ["_row"])
    body = named(text, "_row")

    def rebuilt(x: Column) -> Column:
        """The text between the spans: four bytes a code point, so that every cut costs its own length only."""
        piece = lambda start, end: F.decode(F.concat(F.lit(bytes.fromhex("0000feff")), F.substring(x["wide"], 4 * start + 1, 4 * (end - start))), "UTF-32")
        marked = F.transform(x["found"], lambda s, i: F.when(s["start"] >= F.get(x["reached"], i), F.concat(piece(F.get(x["reached"], i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(marked, ""), piece(F.array_max(F.transform(x["found"], lambda s: s["end"])), F.length(body)))

    reached = before_each(F.transform("found", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    done = _let(F.struct("found", reached.alias("reached"), F.encode(body, "UTF-32").alias("wide")), rebuilt)
    return hits.select(*[F.when(F.size("found") > 0, done).otherwise(body).alias(c) if c == text else named(c, "_row").alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda x: x["order"] == k)).cast("long")
    base = F.filter(found, lambda x: x["order"] < len(BASE))
    return scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(base, BASE).cast("binary"), 256).alias("base_sha256"), _listed(found, RULES).alias("spans"),
    )


def _sql() -> str:
    """The same by whole scans: matches and the gaps between them, per kind."""
    parts = []
    for order, r in enumerate(RULES):
        regex = _quick(r).replace("(?i:(password|passwd|secret|token|api_?key))", "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])").replace("'", "''")
        parts.append(
            f"SELECT row, {order} AS k, '{r.kind}' AS kind, string_split_regex(text, '{regex}') AS gaps, regexp_extract_all(text, '{regex}', 0) AS hits, "
            f"regexp_extract_all(text, '{regex}', {r.group}) AS sized, {r.least} AS least FROM d WHERE regexp_matches(text, '{regex}')"
        )
    return (
        "WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents), m AS ("
        + " UNION ALL ".join(parts)
        + """), one AS (SELECT row, k, kind, hits, sized, least, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
spans AS (SELECT row, k, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n
  FROM one WHERE length(sized[i]) >= least),
texts AS (SELECT row, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k) AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN texts USING (row)"""
    )


SQL = _sql()
