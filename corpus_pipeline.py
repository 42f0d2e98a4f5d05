"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, pieces; each stage reads what the one before wrote.

Null, empty and very long texts, repeated rows and empty tables go through every stage; extra columns stay until the last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import jaccard_join, language_id, mixing, pieces, secret_scan
from evidra.shared import named, stored

#: Texts whose language is no clearer than this go, as do texts without letters.
LEAST_CLEAR = 0.35
#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
NEAR = jaccard_join.Join(width=5, percent=80)

#: Ids and text digests of rows that are alike, which are broadcast up to so many.
FEW_ALIKE = 100_000


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as one column, so that no column of docs can clash with an operator's own."""
    return docs.select("doc_id", "text", F.struct(*[named(c) for c in docs.columns]).alias("_row"))


def unpacked(columns: Sequence[str]) -> list[Column]:
    """The columns of :func:`packed` docs again."""
    return [named(c, "_row").alias(c) for c in columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or a clear language (null and empty ones too); the model learns from docs' lang."""
    found = language_id.predict(packed(docs), language_id.fit(docs), keep=["_row"])
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_CLEAR)).select(*unpacked(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the one with the smallest id (null last), and of equal ids by the text's digest.

    Classes are decided by row, so rows that repeat an id with other texts stay or go by their own class. Of rows alike
    in id and text one stays, also where the text has no words; other wordless texts stay.
    """
    rows = packed(docs).withColumn("_mark", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    classes = stored(jaccard_join.classed_rows(rows.select("doc_id", "text", "_mark"), NEAR, keep=["_mark"]), "pipeline-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_mark")).alias("first")
    kept = classes.where("class_id IS NOT NULL").groupBy("class_id").agg(first).select(F.col("first.doc_id").alias("_kept"), F.col("first._mark").alias("_kept_mark"))
    alone = classes.where("class_id IS NULL").select(F.col("doc_id").alias("_kept"), F.col("_mark").alias("_kept_mark")).distinct()
    chosen = rows.join(kept.unionByName(alone), F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_mark") == F.col("_kept_mark")), "left_semi")
    alike = stored(classes.groupBy(F.col("doc_id").alias("_same"), F.col("_mark").alias("_same_mark")).count().where("count > 1").drop("count"), "pipeline-alike")
    n = alike.count()
    if 0 < n <= FEW_ALIKE:  # only rows that have others like them are moved once more
        same = F.col("doc_id").eqNullSafe(F.col("_same")) & (F.col("_mark") == F.col("_same_mark"))
        once = chosen.join(F.broadcast(alike), same, "left_semi").dropDuplicates(["doc_id", "_mark"])
        chosen = chosen.join(F.broadcast(alike), same, "left_anti").unionByName(once)
    elif n:
        chosen = chosen.dropDuplicates(["doc_id", "_mark"])
    return chosen.select(*unpacked(docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all rows stay."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it."""
    return mixing.emit(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their piece ids, counts and the verdict of decoding them again.

    A column of docs that has the name of one of those gives way to it.
    """
    out = pieces.encode_texts(packed(docs), pieces.vocabulary(), keep=["_row"], ids=True)
    new = [c for c in out.columns if c not in ("doc_id", "_row")]
    return out.select(*unpacked([c for c in docs.columns if c not in new]), *new)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]
#: Trained and iterative stages have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
