"""Texts and descriptions that an index is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.ids import content_hash
from corvane.functions.text import token_count

_ONE = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]++|[^\s\x{3400}-\x{9fff}A-Za-z0-9_]"
OMITTED = "\n[… / omitted …]\n"


def compact_lines(text: Column) -> Column:
    """Lines with single blanks, trimmed, without empty ones."""
    lines = F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c  ]"), lambda l: F.regexp_replace(F.regexp_replace(l, "[\t 　]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def first_tokens(text: Column, n: int) -> Column:
    """The text up to the end of its n-th token."""
    return F.regexp_extract(text, rf"(?U)^(?:\s*+(?:{_ONE})){{{n}}}", 0)


def last_tokens(text: Column, n: int) -> Column:
    """The text from the beginning of its n-th last token: the first tokens read backwards."""
    return F.reverse(first_tokens(F.reverse(text), n))


def head_and_tail(text: Column, most: int = 384) -> Column:
    """The whole text, or its first two and last one thirds of ``most`` tokens around a mark."""
    head = most * 2 // 3
    cut = F.concat(F.rtrim(first_tokens(text, head)), F.lit(OMITTED), F.ltrim(last_tokens(text, most - head)))
    return F.when((F.length(text) > most) & (token_count(text) > most), cut).otherwise(text)


def index_texts(chunks: DataFrame, depth: int = 2, heading_chars: int = 96, most: int = 384) -> DataFrame:
    """(id, header, lexical_text, embedding_text, fingerprint) of chunks (id, text, heading_path,
    section_number).  The header names the deepest headings and the section number that
    the beginning of the text does not already show; null texts are empty."""
    body = compact_lines(F.coalesce("text", F.lit("")))
    path = F.coalesce("heading_path", F.array().cast("array<string>"))
    deepest = F.when(F.size(path) > depth, F.slice(path, F.size(path) - depth + 1, F.lit(depth))).otherwise(path)
    short = F.array_distinct(F.transform(deepest, lambda h: F.substring(compact_lines(h), 1, heading_chars)))
    start = lambda n: F.substring(F.coalesce("text", F.lit("")), 1, n)
    shown = F.filter(short, lambda h: (h != "") & ~F.contains(start(160), h))
    number = F.when((F.length("section_number") > 0) & ~F.contains(start(80), F.col("section_number")), F.concat(F.lit("[编号 / Section] "), "section_number"))
    header = F.concat_ws("\n", F.when(F.size(shown) > 0, F.concat(F.lit("[层级 / Heading] "), F.array_join(shown, " / "))), number)
    rows = chunks.select("id", body.alias("body"), header.alias("header"))
    lexical = F.concat_ws("\n", F.nullif("header", F.lit("")), F.nullif("body", F.lit("")))
    return rows.select("id", "header", lexical.alias("lexical_text"), head_and_tail(lexical, most).alias("embedding_text"), content_hash(F.col("body")).alias("fingerprint"))


def document_titles(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """(document_version_id, title, chunks, tokens): the last heading of the first chunk that
    has one, else the file name without suffix."""
    heading = F.when(F.size("heading_path") > 0, F.element_at("heading_path", -1))
    got = chunks.groupBy("document_version_id").agg(F.min_by(heading, F.when(heading.isNotNull(), F.struct("ordinal", "id"))).alias("heading"), F.count("*").alias("chunks"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    names = versions.select(F.col("id").alias("document_version_id"), F.regexp_replace("original_filename", r"\.[^.]*$", "").alias("stem"))
    return got.join(names, "document_version_id", "left").select("document_version_id", F.coalesce("heading", "stem").alias("title"), "chunks", "tokens")


def merged_locators(units: DataFrame, group: str) -> DataFrame:
    """(group, first_page, last_page, units, common_path, boundary): the span of each group of
    units (unit_no, page_number, heading_path, hard_boundary_key): pages, the longest common
    beginning of the heading paths and the boundary if all agree.  Paths are folded two
    at a time through their shortest and extreme members, so no list is collected."""
    joined = F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), "\x1f", "")
    rows = units.withColumn("_p", joined)
    got = rows.groupBy(group).agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("units"), F.min("_p").alias("lo"), F.max("_p").alias("hi"), F.min("hard_boundary_key").alias("k0"), F.max("hard_boundary_key").alias("k1"), F.count("hard_boundary_key").alias("kn"))
    # the common beginning of all strings is that of the least and the greatest
    lo, hi = F.split("lo", "\x1f"), F.split("hi", "\x1f")
    same = F.zip_with(lo, hi, lambda a, b: F.when(a.eqNullSafe(b) & (a != ""), a))
    common = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("xs")), lambda acc, x: F.struct((acc["on"] & x.isNotNull()).alias("on"), F.when(acc["on"] & x.isNotNull(), F.concat(acc["xs"], F.array(x))).otherwise(acc["xs"]).alias("xs")), lambda acc: acc["xs"])
    agreed = F.when((F.col("k0") == F.col("k1")) & (F.col("kn") == F.col("units")), F.col("k0"))
    return got.select(group, "first_page", "last_page", "units", F.array_join(common, " / ").alias("common_path"), agreed.alias("boundary"))


def degradation_codes(chunks: DataFrame, group: str, reasons: str) -> DataFrame:
    """(group, code, first_ordinal): comma-parted reasons, each at its first chunk."""
    codes = chunks.select(group, "ordinal", F.explode(F.split(reasons, ",")).alias("code")).withColumn("code", F.trim("code")).where("code <> ''")
    return codes.groupBy(group, "code").agg(F.min("ordinal").alias("first_ordinal"))


def population_version(chunks: DataFrame) -> DataFrame:
    """One row (chunker_version): the distinct versions, sorted, joined by +."""
    distinct = chunks.where("chunker_version is not null").select("chunker_version").distinct()
    return distinct.agg(F.array_join(F.array_sort(F.collect_list("chunker_version")), "+").alias("chunker_version"))


def shared_prefixes(chunks: DataFrame, chars: int = 320, bodies: int = 4) -> DataFrame:
    """(document_version_id, prefix_hash, bodies): leaves of one version whose search text
    begins alike for ``chars`` characters with at least ``bodies`` different bodies."""
    search = F.coalesce(F.nullif("retrieval_text", F.lit("")), "text")
    rows = chunks.where(F.length(search) >= chars).select("document_version_id", F.xxhash64(F.substring(search, 1, chars)).alias("prefix_hash"), F.xxhash64("text").alias("b")).distinct()
    return rows.groupBy("document_version_id", "prefix_hash").agg(F.count("*").alias("bodies")).where(F.col("bodies") >= bodies)


def with_neighbours(chunks: DataFrame) -> DataFrame:
    """Adds previous_id and next_id of leaves by ordinal within a version."""
    w = Window.partitionBy("document_version_id").orderBy("ordinal", "id")
    return chunks.withColumn("previous_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))
