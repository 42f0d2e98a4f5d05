"""Classifying and checking chunks: kinds of tables, what is worth searching, one form for all chunks, audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import LOW_VALUE_TITLES

Rules = Sequence[tuple[str, Sequence[str]]]
#: Words of a table's title or body that give its kind, in this order.
TABLE_KINDS: Rules = (
    ("financial_table", ("재무상태표", "손익계산서", "포괄손익", "현금흐름표", "재무제표", "매출액", "매출", "영업이익", "당기순이익", "순이익", "자산", "부채", "자본", "매출채권", "재고자산", "유형자산", "무형자산", "금융자산", "금융부채", "차입금", "영업활동", "투자활동", "재무활동")),
    ("business_table", ("사업의 내용", "주요 제품", "주요제품", "제품", "수주", "계약", "생산능력", "생산실적", "가동률", "판매", "시장점유율", "연구개발", "설비투자", "원재료")),
    ("governance_table", ("이사회", "감사위원회", "감사제도", "주주총회", "임원", "보수", "최대주주", "주주")),
    ("document_admin", ("회사명", "회 사 명", "대표이사", "본점 소재지", "본 점 소 재 지", "주소", "주 소", "전화번호", "홈페이지", "작성책임자", "작 성 책 임 자")),
)


def table_kind(title: Column, body: Column, rules: Rules = TABLE_KINDS, default: str = "general_table") -> Column:
    """The first kind of which a word stands in title or body."""
    both = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    out = F.lit(default)
    for kind, words in reversed(list(rules)):
        out = F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(both, w)), kind).otherwise(out)
    return out


def searchable_table(title: Column, rows: Column, body: Column) -> Column:
    """At least two rows and ten signs, no contents list, fewer than three long rules, and five signs beside rules and bars."""
    text = F.coalesce(body, F.lit(""))
    useful = F.length(F.regexp_replace(text, r"[-|\s]", ""))
    return (rows >= 2) & (F.length(text) >= 10) & ~F.trim(F.coalesce(title, F.lit(""))).isin(*LOW_VALUE_TITLES) & (F.regexp_count(text, F.lit("-{5,}")) < 3) & (useful >= 5)


def chunk_text(preamble: Sequence[tuple[str, Column]], body: Column) -> Column:
    """A chunk's text: one line 'name: value' for each value that is there, then the body."""
    lines = [F.when(F.length(F.trim(v.cast("string"))) > 0, F.concat(F.lit(f"{name}: "), F.trim(v.cast("string")))) for name, v in preamble]
    return F.concat_ws("\n", *lines, body)


def normal_chunk(df: DataFrame, columns: dict[str, Column], text: Column) -> DataFrame:
    """Chunks of any builder in one form: the named columns cleaned to texts (blank ones null), text and its length."""
    shown = [F.nullif(T.clean(c.cast("string")), F.lit("")).alias(name) for name, c in columns.items()]
    return df.select(*shown, T.clean_block(text).alias("text"), F.length(T.clean_block(text)).alias("chars"))


def union_first(parts: Sequence[DataFrame], id_column: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, repeats): the union of the builders' chunks, of a repeated id that of the earliest builder; and the ids repeated."""
    marked = [p.withColumn("_builder", F.lit(k)) for k, p in enumerate(parts)]
    every = marked[0]
    for p in marked[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in (id_column, "_builder")]
    n = F.row_number().over(Window.partitionBy(id_column).orderBy("_builder", *rest))
    placed = every.withColumn("_n", n)
    return placed.where("_n = 1").drop("_n", "_builder"), every.groupBy(id_column).agg(F.count("*").alias("copies")).where("copies > 1")


def note_filter(text: Column, least: int = 10) -> Column:
    """Notes worth a chunk: long enough, and more than a number or a page mark."""
    body = T.clean(text)
    return (F.length(body) >= least) & ~body.rlike(r"^[\d\s.,()\-/%]*$")


def audit(df: DataFrame, keys: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """(keys..., rows, one count for each check): how many rows fail each check."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))
