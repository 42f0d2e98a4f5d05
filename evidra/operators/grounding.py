"""Checks of answers against evidence, evidence lines, source budgets and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T

#: The answer given without evidence, wordings that mean the same, and how long such an answer may be.
INSUFFICIENT = "제공된 공시 근거만으로 답변을 확정할 수 없습니다."
INSUFFICIENT_WORDS = r"확정할\s*수\s*없|확정하기\s*(?:는\s*)?어렵|답변\s*(?:이|을)?\s*불가"
INSUFFICIENT_CHARS = 80
#: What asks for a calculation, and what shows one.
CALCULATION_ASKED = ("계산", "환산", "합계", "평균", "차이", "증감", "몇 배", "비율을 구")
CALCULATION_SHOWN = ("=", "+", "×", "x", "÷", "/", "계산", "합계", "평균", "차이", "증가", "감소")


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of the answer that are no whole number token of the evidence, with or without a percent sign."""
    bare = F.transform(N.number_tokens(evidence), lambda x: F.regexp_replace(x, "%", ""))
    return F.array_except(N.answer_numbers(answer), bare)


def insufficient(answer: Column) -> Column:
    text = F.trim(F.coalesce(answer, F.lit("")))
    return (text == INSUFFICIENT) | ((F.length(text) <= INSUFFICIENT_CHARS) & text.rlike(INSUFFICIENT_WORDS))


def verdict(answer: Column, evidence: Column, unsupported: Column, claims_hold: Column, compares: Column) -> Column:
    """RETRY for an empty side, an unsupported number (unless the task compares), or a claim that fails; else PASS."""
    empty = (F.trim(F.coalesce(answer, F.lit(""))) == "") | (F.trim(F.coalesce(evidence, F.lit(""))) == "")
    return F.when(empty, "RETRY").when(~compares & (F.size(unsupported) > 0), "RETRY").when(~F.coalesce(claims_hold, F.lit(True)), "RETRY").otherwise("PASS")


def claims_hold(claims: DataFrame, keys: Sequence[str]) -> DataFrame:
    return claims.groupBy(*keys).agg(F.bool_and("supported").alias("claims_hold"))


def term_coverage(text: Column, terms: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))).cast("double"), F.size(terms)), F.lit(0.0))


#: Fixed value: the task type of calculations.
CALCULATION_TASK = "계산"


def unexplained_calculation(question: Column, answer: Column, evidence: Column, task: Column | None = None) -> Column:
    """A calculation was asked for, by the task's type or the question's words, but the answer is one number of the evidence without any sign of calculating."""
    some = lambda text, parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))
    numbers = N.number_tokens(answer)
    asked = some(question, CALCULATION_ASKED)
    asked = asked if task is None else asked | F.coalesce(task == CALCULATION_TASK, F.lit(False))
    return asked & ~some(answer, CALCULATION_SHOWN) & (F.size(numbers) == 1) & (F.size(F.array_except(numbers, N.number_tokens(evidence))) == 0)


def evidence_lines(rows: DataFrame, keys: Sequence[str], text: str, numbers: str, terms: str, most: int = 5) -> DataFrame:
    """(keys..., lines): the lines that carry a number of the answer, their last two headings, then the best others.

    At most ``most`` lines unless more carry a number; in the order of the text; the first ones if nothing scores.
    """
    lines = rows.select(*keys, numbers, terms, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line")).where(F.trim("line") != "")
    own = N.number_tokens(F.col("line"))
    direct = F.arrays_overlap(F.transform(own, lambda x: F.regexp_replace(x, "%", "")), F.col(numbers))
    hits = F.filter(F.col(terms), lambda t: F.contains(F.lower(F.col("line")), F.lower(t)))
    points = 20 * direct.cast("double") + F.aggregate(hits, F.lit(0.0), lambda acc, t: acc + 2 + F.when(F.length(t) >= 4, 0.5).otherwise(0.0)) + F.when(F.contains("line", F.lit("|")), 0.5).otherwise(0.0)
    w = Window.partitionBy(*keys).orderBy("at")
    scored = lines.select(*keys, "at", "line", F.coalesce(direct, F.lit(False)).alias("direct"), F.coalesce(points, F.lit(0.0)).alias("points"), (F.size(own) == 0).alias("heading"))
    after = F.count(F.when(F.col("heading"), 1)).over(w)
    marked = scored.withColumn("_h", after).withColumn("_next", F.min(F.when(F.col("direct"), F.col("_h"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    tier = F.when(F.col("direct"), 0).when(F.col("heading") & (F.col("_next") - F.col("_h") < 2), 1).when(F.col("points") > 0, 2).otherwise(3)
    placed = marked.withColumn("tier", tier).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("tier", F.when(F.col("tier") == 2, -F.col("points")).otherwise(F.lit(0.0)), "at")))
    total = Window.partitionBy(*keys)
    scores = placed.withColumn("_some", F.max((F.col("tier") < 3).cast("int")).over(total))
    kept = scores.where(F.when(F.col("_some") == 0, F.col("place") <= most).otherwise((F.col("tier") == 0) | ((F.col("tier") < 3) & (F.col("place") <= most))))
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))


def within_budget(sources: DataFrame, question: str, order: str, text: str, each: int, total: int, most: int) -> DataFrame:
    """The first sources, each cut, until their number or their characters reach the budget."""
    w = Window.partitionBy(question).orderBy(order)
    cut = sources.withColumn(text, F.substring(F.col(text), 1, each)).withColumn("_n", F.row_number().over(w))
    used = cut.withColumn("_used", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return used.where((F.col("_n") <= most) & (F.col("_used") <= total)).drop("_n", "_used")


def valid_source_ids(ids: Column, count: Column) -> Column:
    """Distinct whole numbers from 1 to count, in their order."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: x.try_cast("int")), lambda x: x.isNotNull() & (x >= 1) & (x <= count)))


def choose_attempt(attempts: DataFrame, question: str) -> DataFrame:
    """The attempt with the highest rank (0 unanswerable, 1 failed its check, 2 good); the earlier one on a tie."""
    rank = F.when(~F.col("answerable"), 0).when(~F.col("valid"), 1).otherwise(2)
    w = Window.partitionBy(question).orderBy(F.desc("attempt_rank"), "attempt")
    return attempts.withColumn("attempt_rank", rank).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def repaired_quote(quote: Column, context: Column) -> Column:
    """The quote if the context holds it; else the first context line that holds its text after the colon."""
    value = F.trim(F.element_at(F.split(quote, ":"), -1))
    lines = F.filter(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: (F.length(value) > 0) & F.contains(x, value))
    return F.when(F.contains(context, quote), quote).otherwise(F.try_element_at(lines, F.lit(1)))


def qa_reason(rows: DataFrame, question: str, answer: str, evidence: str, task: str, documents: str, comparing: Sequence[str]) -> DataFrame:
    """Adds reason: missing_field, duplicate_question, no_evidence, too_few_documents or ok, the first that applies."""
    key = F.regexp_replace(F.lower(F.coalesce(question, F.lit(""))), r"[^0-9\p{L}]+", "")
    seen = F.row_number().over(Window.partitionBy("_key").orderBy(question, answer))
    marked = rows.withColumn("_key", key).withColumn("_n", seen)
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = F.when(blank(question) | blank(answer), "missing_field").when(F.col("_n") > 1, "duplicate_question").when(blank(evidence), "no_evidence")
    reason = reason.when(F.col(task).isin(*comparing) & (F.col(documents) < 2), "too_few_documents").otherwise("ok")
    return marked.withColumn("reason", reason).drop("_key", "_n")


def topics_covered(evidence: Column, terms: Column) -> Column:
    """Whether the evidence names at least one of the question's terms, blanks and separators ignored; true without terms."""
    text = T.dense_key(evidence)
    kept = F.filter(F.transform(terms, T.dense_key), lambda t: t != "")
    return (F.length(text) > 0) & ((F.size(kept) == 0) | F.exists(kept, lambda t: F.contains(text, t)))


def context_block(number: Column, title: Column, text: Column) -> Column:
    """One numbered source of a context: its number and title on a line, then its text."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
