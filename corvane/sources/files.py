"""Readers: document files, uploads, evaluation sets, traces, index artefacts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MEDIA_TYPES = {"txt": "text/plain", "md": "text/markdown", "pdf": "application/pdf"}
#: Encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-16", "gb18030")


def scan_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md,pdf}") -> DataFrame:
    """(path, filename, suffix, media_type, length, content) of the matching files; content
    is only read when used.  Files of no bytes are not listed: Spark's file scan skips them."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    media = F.lit(None).cast("string")
    for s, m in MEDIA_TYPES.items():
        media = F.when(suffix == s, F.lit(m)).otherwise(media)
    return rows.select("path", name.alias("filename"), suffix.alias("suffix"), media.alias("media_type"), "length", "content")


def validate_uploads(files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """Adds content_hash and reject_reason (null when accepted): unsupported type, empty,
    too large, or a PDF without its signature."""
    reason = (
        F.when(F.col("media_type").isNull(), "unsupported_type")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > most_bytes, "too_large")
        .when((F.col("media_type") == "application/pdf") & (F.substring("content", 1, 5) != F.lit(b"%PDF-")), "bad_signature")
    )
    return files.withColumn("reject_reason", reason).withColumn("content_hash", F.sha2("content", 256))


@F.pandas_udf(StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Text of each content in the first encoding that fits; null if none does."""

    def one(content: bytes | None) -> str | None:
        for encoding in ENCODINGS:
            try:
                return None if content is None else bytes(content).decode(encoding)
            except UnicodeError:
                continue
        return None

    return contents.map(one)


def load_texts(files: DataFrame) -> DataFrame:
    """(doc_id, filename, media_type, text) of accepted text and Markdown files."""
    ok = validate_uploads(files).where("reject_reason is null and media_type <> 'application/pdf'")
    return ok.select(F.col("content_hash").alias("doc_id"), "filename", "media_type", decoded("content").alias("text"))


def read_evaluation(spark: SparkSession, path: str) -> DataFrame:
    """Examples of evaluation sets (JSON: name, version, examples); repeated ids fail."""
    rows = spark.read.option("multiLine", True).json(path).select("name", "version", F.explode("examples").alias("e")).select("name", "version", "e.*")
    w = F.count("*").over(Window.partitionBy("name", "id"))
    return rows.withColumn("_n", w).withColumn("id", F.when(F.col("_n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated example "), F.col("id"))))).drop("_n")


def read_trace_steps(spark: SparkSession, path: str) -> DataFrame:
    """(trace_id, sequence, name, attributes) of the step events of JSON-lines traces; lines
    that are no JSON are skipped."""
    schema = "event string, trace_id string, sequence int, name string, attributes map<string,string>"
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("e"))
    return rows.where("e.event = 'step'").select("e.trace_id", "e.sequence", "e.name", "e.attributes")


def classify_pdf_pages(pages: DataFrame, least_chars: int = 5, text_share: float = 0.9) -> DataFrame:
    """(doc_id, pages, text_pages, kind): text, hybrid or scanned by the share of pages with
    text.  ``pages``: doc_id, page_number, text from any parser."""
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) >= least_chars).alias("text_pages"))
    share = F.col("text_pages") / F.col("pages")
    return rows.withColumn("kind", F.when(share >= text_share, "text").when(share > 0, "hybrid").otherwise("scanned"))


def merge_ocr(pages: DataFrame, ocr: DataFrame, least_confidence: float = 0.75) -> DataFrame:
    """(doc_id, page_number, text, origin): pages without text are filled from OCR (doc_id,
    page_number, text, confidence) when the document's mean confidence reaches the
    least and every such page is covered; otherwise they stay empty (unresolved)."""
    bare = F.trim(F.coalesce(F.col("text"), F.lit(""))) == ""
    o = ocr.select("doc_id", "page_number", F.col("text").alias("o_text"), "confidence")
    joined = pages.join(o, ["doc_id", "page_number"], "left").withColumn("_bare", bare)
    verdict = joined.groupBy("doc_id").agg((F.coalesce(F.avg(F.when(F.col("_bare"), F.col("confidence"))), F.lit(1.0)) >= least_confidence).alias("sure"), F.bool_and(~F.col("_bare") | F.col("o_text").isNotNull()).alias("covered"))
    use = F.col("_bare") & F.col("sure") & F.col("covered")
    return joined.join(verdict, "doc_id").select("doc_id", "page_number", F.when(use, F.col("o_text")).otherwise(F.col("text")).alias("text"), F.when(use, "ocr").when(F.col("_bare"), "unresolved").otherwise("native").alias("origin"))
