"""Readers with stated schemas, and sinks. Nothing is inferred from data; damaged records are kept apart or refused."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .versions import VersionedTable

UNIVERSE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("corp_code", "stock_code", "corp_name", "listed_name", "corp_eng_name", "market", "industry")]
    + [T.StructField("sector_no", T.IntegerType()), T.StructField("sector", T.StringType()), T.StructField("listing_date", T.DateType()), T.StructField("fiscal_month", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("market_cap", "n_periodic", "n_major", "n_exchange", "n_holding")]
    + [T.StructField("note", T.StringType())]
)
MANIFEST = "doc_id string, corp_code string, corp_name string, listed_name string, stock_code string, industry string, sector string, doc_group string, doc_subtype string, report_nm string, rcept_no string, rcept_dt string, flr_nm string, is_correction string, base_year int, base_month int, file_path string, file_format string, n_files int, normalized_report_type string, event_date string, disclosure_chain_id string"
CHUNKS = "chunk_id string, text string, metadata map<string,string>"
CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str, schema: str, damaged: str = "refuse") -> DataFrame:
    """JSON lines; damaged records are refused (an action that meets one fails), dropped, or kept in _corrupt_record."""
    modes = {"refuse": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}
    full = f"{schema}, {CORRUPT} string" if damaged == "keep" else schema
    return spark.read.schema(full).option("mode", modes[damaged]).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Whole-file JSON: an array of records, or records under data, items, records, examples or samples."""
    wrapped = ", ".join(f"{k} array<struct<{record}>>" for k in ("data", "items", "records", "examples", "samples"))
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{record}>>")
    inside = F.from_json("value", f"struct<{wrapped}>")
    one = F.array(F.from_json("value", f"struct<{record}>"))
    rows = F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(*[inside[k] for k in ("data", "items", "records", "examples", "samples")], one))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def csv_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header (a byte-order mark is fine); every value as stated by the schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All values as text, nulls empty."""
    return csv_table(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in columns])).na.fill("")


def raw_files(spark: SparkSession, path: str, suffix: str = "*.xml") -> DataFrame:
    """(path, receipt, content): whole files below a folder; the receipt number is read from the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path)
    receipt = F.nullif(F.regexp_extract("path", r"(?<!\d)(\d{14})(?!\d)", 1), F.lit(""))
    return files.select("path", receipt.alias("receipt"), F.decode("content", "UTF-8").alias("content"))


def escape_markup(c):
    """Escapes ampersands that start no entity, and angle brackets around names that are no tags."""
    amp = F.regexp_replace(c, r"&(?!(?:[A-Za-z]+|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    return F.regexp_replace(amp, r"<(?=/?[^A-Za-z/!?])([^<>]*)>", "&lt;$1&gt;")


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_training(df: DataFrame, path: str, kind: str = "csv", system_prompt: str | None = None) -> None:
    """Training rows as CSV with a header, or as JSON lines; a system prompt becomes a column of every row."""
    out = df if system_prompt is None else df.withColumn("System_Prompt", F.lit(system_prompt))
    writer = out.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.json(path)


def write_vectors(chunks: DataFrame, path: str, company: str = "corp_name", expected: int | None = None) -> DataFrame:
    """The vector table, one row for each chunk id, in folders by company; a row count that differs from expected raises."""
    chunks.dropDuplicates(["chunk_id"]).write.mode("overwrite").partitionBy(company).parquet(path)
    stored = chunks.sparkSession.read.parquet(path)
    if expected is not None and (found := stored.count()) != expected:
        raise ValueError(f"expected {expected} vectors, stored {found}")
    return stored


def upsert_vectors(chunks: DataFrame, path: str, company: str = "corp_name", name: str | None = None) -> DataFrame:
    """Adds the chunks whose ids the versioned vector table at ``path`` lacks, as one batch, and returns the table.

    A batch that is there by its name (unless given: by the checksum of its rows) is not added again, and of an id that
    two racing batches hold the table shows one row, so lost, repeated and racing runs leave one copy. For rows that are
    to replace older ones, commit to the table itself.
    """
    table = VersionedTable(chunks.sparkSession, path, "chunk_id", company)
    name = name or "-".join(map(str, table.measure(chunks)))
    fresh = chunks.join(table.read().select("chunk_id"), "chunk_id", "left_anti") if table.versions() else chunks
    table.commit(fresh, name)
    return table.read()


def found_path(spark: SparkSession, path: str) -> str | None:
    """The path as it exists in the file system it names: composed, else decomposed letters; None if neither does."""
    for form in ("NFC", "NFD"):
        shown = unicodedata.normalize(form, path)
        place = spark._jvm.org.apache.hadoop.fs.Path(shown)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return shown
    return None


def lenient_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without the damaged ones; a missing file counts as an empty one."""
    found = found_path(spark, path)
    return json_lines(spark, found, schema, "drop") if found else spark.createDataFrame([], schema)


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.join(cache.select(key).distinct(), key, "left_anti")


def collection_catalog(vectors: DataFrame, company: str = "corp_name") -> DataFrame:
    return vectors.groupBy(company).agg(F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("ids"))


def _shown(markup: Column) -> Column:
    """The text of a piece of markup, the commonest entities resolved."""
    text = F.regexp_replace(markup, "<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def html_fields(docs: DataFrame, id_column: str, markup: str) -> DataFrame:
    """(id, title, fields): label and value of every table row of a page, as an array in page order.

    The last two cells of a row are label and value. A row of one cell is a heading, whose value is the next row of one
    cell; a row of more cells ends it. Rows with a blank label or value are left out. A label met before gets the number
    of fields so far behind it. Null and empty pages have a blank title and no fields.
    """
    page = F.regexp_replace(F.coalesce(F.col(markup), F.lit("")), r"(?s)<!--.*?-->|<[?!][^>]*>", "")
    rows = F.transform(F.regexp_extract_all(page, F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td(?:\s[^>]*)?>(.*?)</td>"), F.lit(1)), _shown))
    empty = F.struct(F.lit("").alias("heading"), F.array().cast("array<struct<label:string,value:string>>").alias("fields"))

    def step(state: Column, cells: Column) -> Column:
        n = F.size(cells)
        only = F.try_element_at(cells, F.lit(1))
        heading, fields = state["heading"], state["fields"]
        label = F.when(n >= 2, F.try_element_at(cells, F.lit(-2))).when((n == 1) & (heading != ""), heading).otherwise("")
        value = F.when(n >= 1, F.try_element_at(cells, F.lit(-1))).otherwise("")
        named = F.when(F.exists(fields, lambda f: f["label"] == label), F.concat(label, F.lit(" "), F.size(fields))).otherwise(label)
        more = F.concat(fields, F.array(F.struct(named.alias("label"), value.alias("value"))))
        ahead = F.when(n == 0, heading).when((n == 1) & (heading == ""), only).otherwise("")
        return F.struct(ahead.alias("heading"), F.when((label != "") & (value != ""), more).otherwise(fields).alias("fields"))

    title = _shown(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return docs.select(id_column, title.alias("title"), F.aggregate(rows, empty, step)["fields"].alias("fields"))
