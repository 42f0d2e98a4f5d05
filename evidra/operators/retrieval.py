"""Vector search, rank fusion, reranking, qualification and merging, for many questions at once.

Rows are keyed by question and request; rankings end with the chunk's id, so ties are settled alike everywhere.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .vectors import top_k as search

#: The constant of reciprocal ranks, weights of query and keyword scores, thresholds of qualification.
RRF_K = 60
QUERY_WEIGHT, KEYWORD_WEIGHT = 0.8, 0.2
LEAST_QUERY, NEAR_BEST_QUERY, NEAR_BEST_FINAL = 0.55, 0.85, 0.90
#: Chunks by query and by keyword, and kept per document and request.
DENSE, KEYWORD, KEPT = 24, 12, 10
#: Units that mark a text as evidence.
EVIDENCE_UNITS = ("백만원", "억원", "천원", "원", "%", "명", "주")


def unit(v: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def hashed_vector(c: Column, size: int = 256) -> Column:
    """A unit vector of hashed letter pairs and triples of each padded word: a stand-in embedder without a model."""
    padded = F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda n: F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))))
    slots = F.transform(F.concat(grams(2), grams(3)), lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int"))
    return unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(slots, lambda s: s == k)).cast("double")))


def merged_ranks(found: DataFrame, keys: Sequence[str], limit: int | None = None, chunk: str = "chunk_id") -> DataFrame:
    """Results of several partitions in one order: adds global_rank beside the local one."""
    out = found.withColumn("global_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), chunk)))
    return out if limit is None else out.where(F.col("global_rank") <= limit)


def fuse(ranked: DataFrame, question: str = "question_id", request: str = "request_id", chunk: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(question, chunk, fusion): by channel the best rank, by request the sum of 1/(k+rank), then the largest request."""
    best = ranked.groupBy(question, request, chunk, "channel").agg(F.min("rank").alias("rank"))
    per_request = best.groupBy(question, request, chunk).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fusion"))
    return per_request.groupBy(question, chunk).agg(F.max("fusion").alias("fusion"))


def candidates(chunks: DataFrame, requests: DataFrame, keywords: DataFrame, groups: Sequence[str], dense: int = DENSE, keyword: int = KEYWORD, chunk: str = "chunk_id", vector: str = "vector", query_vector: str = "query_vector") -> DataFrame:
    """(question_id, request_id, groups..., chunk, channel, rank, score): for every group of a request's documents (company,
    period bucket and source, say) the best chunks by the request's vector, and fewer by each keyword's.

    chunks: chunk, vector, groups. requests: question_id, request_id, query_vector. keywords: the same and keyword_no.
    """
    named = lambda found, channel: found.withColumn("channel", channel)
    by_query = named(search(chunks, requests.select("question_id", "request_id", query_vector), [], dense, vector, query_vector, chunk, per=groups), F.lit("query_dense"))
    by_word = search(chunks, keywords.select("question_id", "request_id", "keyword_no", query_vector), [], keyword, vector, query_vector, chunk, per=groups)
    by_word = named(by_word, F.concat(F.lit("keyword_dense:"), F.col("keyword_no"))).drop("keyword_no")
    return by_query.unionByName(by_word)


def fuse_merged(found: DataFrame, doc: str = "doc_id", text: str = "text", chunk: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(question_id, chunk, requests, fusion): chunks of a document with equal whitespace-normalised texts are one.

    The one with the smallest id stands for all of them with the best rank of each request and channel; its fusion is the
    largest over its requests of the sum of 1 / (k + rank). Only digests of texts are grouped.
    """
    marked = found.withColumn("_digest", F.sha1(T.clean(F.col(text)).cast("binary")))
    first = marked.groupBy("question_id", doc, "_digest").agg(F.min(chunk).alias("_first"))
    named = marked.join(first, ["question_id", doc, "_digest"]).withColumn(chunk, F.col("_first"))
    best = named.groupBy("question_id", "request_id", chunk, "channel").agg(F.min("rank").alias("rank"))
    per_request = best.groupBy("question_id", "request_id", chunk).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("fusion"))
    return per_request.groupBy("question_id", chunk).agg(F.array_sort(F.collect_set("request_id")).alias("requests"), F.max("fusion").alias("fusion"))


def channel_score(scores: Column, request: Column) -> Column:
    """The largest score of a map of channels whose name starts with the request; of all channels if none does; else 0."""
    own = F.map_values(F.map_filter(scores, lambda c, _: F.startswith(c, F.concat(request, F.lit(":")))))
    return F.coalesce(F.array_max(own), F.array_max(F.map_values(scores)), F.lit(0.0))


def searchable_text(text: Column, metadata: Sequence[Column]) -> Column:
    """The text, and below it the values that are there, on one line."""
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.concat_ws(" ", *[m.cast("string") for m in metadata]))


def first_of_content(df: DataFrame, keys: Sequence[str], text: str, order: Sequence[Column]) -> DataFrame:
    """The first row of those that share keys and whitespace-normalised text."""
    w = Window.partitionBy(*keys, F.sha1(T.clean(F.col(text)).cast("binary"))).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rerank(scored: DataFrame, keep: int = KEPT, question: str = "question_id", request: str = "request_id", doc: str = "doc_id", chunk: str = "chunk_id") -> DataFrame:
    """scored: query_score, keyword_score (null without keywords). Adds final_score and rerank_score; keeps per document.

    A chunk that any of its requests keeps stays for all of them.
    """
    q = F.coalesce("query_score", F.lit(0.0))
    final = F.when(F.col("keyword_score").isNull(), q).otherwise((F.lit(QUERY_WEIGHT) * q + F.lit(KEYWORD_WEIGHT) * F.col("keyword_score")) / (QUERY_WEIGHT + KEYWORD_WEIGHT))
    rows = scored.withColumn("final_score", final)
    place = F.row_number().over(Window.partitionBy(question, request, doc).orderBy(F.desc("final_score"), chunk))
    marked = rows.withColumn("_kept", (place <= keep).cast("int"))
    all_of = Window.partitionBy(question, chunk)
    out = marked.withColumn("rerank_score", F.max("final_score").over(all_of)).withColumn("_any", F.max("_kept").over(all_of))
    return out.where("_any = 1").drop("_kept", "_any")


def term_match(text: Column, terms: Column) -> Column:
    """Mean over terms: 1 if contained, else 0.7 times the share of its tokens that are; at most 1; 0 without terms."""
    low = T.dense_key(text)

    def one(term: Column) -> Column:
        parts = T.tokens(term)
        hits = F.size(F.filter(parts, lambda t: F.contains(low, t)))
        return F.when(F.contains(low, T.dense_key(term)), 1.0).otherwise(F.coalesce(F.try_divide(0.7 * hits, F.size(parts)), F.lit(0.0)))

    total = F.aggregate(F.transform(terms, one), F.lit(0.0), lambda acc, x: acc + x)
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(total, F.size(terms)), F.lit(0.0)))


def question_overlap(text: Column, question: Column) -> Column:
    low, parts = T.dense_key(text), T.tokens(question)
    return F.coalesce(F.try_divide(F.size(F.filter(parts, lambda t: F.contains(low, t))).cast("double"), F.size(parts)), F.lit(0.0))


def evidence_bonus(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("|")), 0.5).otherwise(0.0) + F.when(text.rlike(r"\d"), 0.3).otherwise(0.0) + F.when(text.rlike("|".join(EVIDENCE_UNITS)), 0.2).otherwise(0.0)


def hybrid_score(distance: Column, text: Column, topics: Column, metrics: Column, question: Column) -> Column:
    """The weighted sum of vector, keyword, metric and evidence scores, weights divided by their sum, to six digits."""
    keyword = F.least(F.lit(1.0), 0.8 * term_match(text, topics) + 0.2 * question_overlap(text, question))
    weighted = [(0.60, similarity(distance)), (0.25, keyword), (0.15, term_match(text, metrics)), (0.05, evidence_bonus(text))]
    total = functools.reduce(operator.add, [F.lit(w) * s for w, s in weighted])
    return F.round(total / sum(w for w, _ in weighted), 6)


def qualify(scored: DataFrame, question: str = "question_id", request: str = "request_id") -> DataFrame:
    """Adds qualified: near the best query and final score of the request, and above the least query score."""
    w = Window.partitionBy(question, request)
    q, f = F.col("query_score"), F.col("final_score")
    good = (q >= F.greatest(F.lit(LEAST_QUERY), F.lit(NEAR_BEST_QUERY) * F.max(q).over(w))) & (f >= F.lit(NEAR_BEST_FINAL) * F.max(f).over(w))
    return scored.withColumn("qualified", F.coalesce(good, F.lit(False)))


def merge_tables(parts: DataFrame, keys: Sequence[str], part: str, text: str, score: str, most: int = 10_000) -> DataFrame:
    """One row a table (keys should hold the file too): its parts in order as one text, and its best score."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(part), F.col(text)))), lambda x: x[text])
    rows = parts.groupBy(*keys).agg(ordered.alias("_texts"), F.max(score).alias(score), F.count("*").alias("parts"))
    return rows.select(*keys, T.join_parts(F.col("_texts"), most).alias(text), score, "parts")


def with_neighbours(chunks: DataFrame, keys: Sequence[str], number: str, text: str, reach: int = 1) -> DataFrame:
    """Adds context: the texts of the chunk and of those whose number is at most reach away, in order."""
    w = Window.partitionBy(*keys).orderBy(number).rangeBetween(-reach, reach)
    near = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number), F.col(text))).over(w)), lambda x: x[text])
    return chunks.withColumn("context", F.array_join(near, "\n"))


def combine_results(primary: DataFrame, auxiliary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a chunk of either side: the smaller distance, and where it came from."""
    both = primary.withColumn("origin", F.lit("primary")).unionByName(auxiliary.withColumn("origin", F.lit("auxiliary")), allowMissingColumns=True)
    rest = [c for c in primary.columns if c not in (*keys, "distance")]
    return both.groupBy(*keys).agg(F.min("distance").alias("distance"), *[F.min_by(c, "distance").alias(c) for c in rest], F.array_sort(F.collect_set("origin")).alias("origins"))


def first_source(sources: DataFrame, question: str, columns: Sequence[str], order: str) -> DataFrame:
    """The first row for each coalesced source key (receipt, document, chunk: the first non-null)."""
    w = Window.partitionBy(question, F.coalesce(*[F.col(c).cast("string") for c in columns])).orderBy(order)
    return sources.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_per_document(df: DataFrame, keys: Sequence[str], number_hit: Column, coverage: Column, position: Column, chunk: str) -> DataFrame:
    value = 100 * number_hit.cast("double") + 10 * coverage + F.greatest(F.lit(0.0), 5 - 0.1 * position)
    w = Window.partitionBy(*keys).orderBy(F.desc("evidence_score"), chunk)
    return df.withColumn("evidence_score", value).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def terms_by_year(docs: DataFrame, terms: Sequence[str], doc: str, text: str, year: Column) -> DataFrame:
    """(term, year, chunks, documents) of the chunks that contain the term, case ignored."""
    hits = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(F.col(text)), F.lower(t)))
    return docs.select(F.explode(hits).alias("term"), year.alias("year"), doc).groupBy("term", "year").agg(F.count("*").alias("chunks"), F.count_distinct(doc).alias("documents"))
