"""Queries of the training-data operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import canonical, leakage, mixing, near_duplicates, quality, scanned, splitting

#: The shingle similarity that TESTDATA states for p5, and the least text length.
P5_THRESHOLD, P5_LEAST_CHARS = 0.7, 200


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    units = _read(spark, folder, "units").select(F.lit("units").alias("table_name"), F.col("document_id").alias("scope"), F.col("unit_id").alias("id"), "text")
    plans = _read(spark, folder, "query_plans").select(F.lit("query_plans").alias("table_name"), F.lit("").alias("scope"), F.col("query_id").alias("id"), F.col("core_query").alias("text"))
    return canonical.alike_pairs(units.unionByName(plans), ["table_name", "scope"]).select("table_name", "id_a", "id_b")


def p1_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in its one form, with the number of its characters before and after."""
    units = _read(spark, folder, "units").select(F.lit("units").alias("table_name"), F.col("unit_id").alias("id"), "text")
    plans = _read(spark, folder, "query_plans").select(F.lit("query_plans").alias("table_name"), F.col("query_id").alias("id"), F.col("core_query").alias("text"))
    rows = units.unionByName(plans)
    return rows.select("table_name", "id", F.length("text").alias("stored_chars"), canonical.canonical_column(F.col("text")).alias("text")).withColumn("chars", F.length("text"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.unit_pieces(_read(spark, folder, "units"), _read(spark, folder, "sources"), _read(spark, folder, "split_limits"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("pieces > 1 and piece_no = 0").select("unit_id")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.found_faults(scanned.repair_scans(_read(spark, folder, "ocr_results"), _read(spark, folder, "units")))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return scanned.repair_scans(_read(spark, folder, "ocr_results"), _read(spark, folder, "units")).select("origin", "row_id", "repaired", F.size("faults").alias("faults"))


def _p5_records(spark: SparkSession, folder: str) -> DataFrame:
    units = _read(spark, folder, "units").where(F.length("text") >= P5_LEAST_CHARS)
    leaves = _read(spark, folder, "chunks").where((F.col("chunk_level") == "leaf") & (F.length("retrieval_text") >= P5_LEAST_CHARS))
    return near_duplicates.with_set_ids(units, "units", "unit_id", "text").unionByName(near_duplicates.with_set_ids(leaves, "chunks", "id", "retrieval_text"))


def _p5_links(records: DataFrame) -> DataFrame:
    # links feed several joins: written once, small beside the texts
    return near_duplicates.materialize(near_duplicates.similar_texts(records, P5_THRESHOLD), "similar-links")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    records = _p5_records(spark, folder)
    return near_duplicates.expand_pairs(records, _p5_links(records))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    records = _p5_records(spark, folder)
    return near_duplicates.near_duplicate_groups(records, _p5_links(records))


#: A run of 50 common words scores 100 in the alignment.
P6_WORDS, P6_SCORE = 50, 100


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and passages whose alignment scores like 50 common words; of these the
    pairs that share 50 words in a row."""
    leaks = leakage.leaked_passages(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"), P6_WORDS)
    return leaks.where((F.col("score") >= P6_SCORE) & (F.col("longest_run") >= P6_WORDS)).select("doc_id", "item_id").distinct()


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """All leaks by their alignment, edited copies too: seeds lie in every 20 words."""
    leaks = leakage.leaked_passages(_read(spark, folder, "documents"), _read(spark, folder, "eval_items"), 20)
    return leaks.where(F.col("score") >= P6_SCORE)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that the mix leaves short of their share since their repeats are used up."""
    report = mixing.mix_sources(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))[1]
    return report.where((F.col("selected_tokens") < F.col("wanted_tokens")) & ~F.col("reachable")).select("source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, folder, "documents"), _read(spark, folder, "mix_targets"))[1]


def _shapes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify_shapes(_read(spark, folder, "documents"), _read(spark, folder, "shape_labels"), _read(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _shapes(spark, folder).where("shape <> 'prose'").select("doc_id")


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return _shapes(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_canonical, p2_found, p2_pieces, p4_found, p4_repaired, p5_found, p5_groups, p6_found, p6_leaks, p7_found, p7_mix, p7_shares, p8_found, p8_statistics)}


_BLANKS = r"\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{000b}\x{001c}-\x{001f}"
_TOKEN = rf"[\x{{3400}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^{_BLANKS}]"


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""
            SELECT DISTINCT u.unit_id FROM units u JOIN sources s ON u.source_id = s.id JOIN split_limits l USING (content_profile)
            WHERE len(regexp_extract_all(u.text, '{_TOKEN}')) > l.max_tokens""",
        "p5_found": f"""
            WITH r AS (
              SELECT DISTINCT 'units' AS table_name, unit_id AS id, lower(text) AS t FROM units WHERE length(text) >= 200
              UNION ALL
              SELECT DISTINCT 'chunks', id, lower(retrieval_text) FROM chunks WHERE chunk_level = 'leaf' AND length(retrieval_text) >= 200),
            k AS (SELECT table_name, id, t, regexp_extract_all(t, '{_TOKEN}') AS w FROM r),
            e AS (
              SELECT DISTINCT table_name, id, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS h
              FROM (SELECT table_name, id, w, unnest(range(1, len(w) - 3)) AS i FROM k WHERE len(w) >= 5)),
            n AS (SELECT table_name, id, count(*) AS c FROM e GROUP BY ALL),
            o AS (SELECT a.table_name, a.id AS id_a, b.id AS id_b, count(*) AS both_ FROM e a JOIN e b ON a.table_name = b.table_name AND a.h = b.h AND a.id < b.id GROUP BY ALL)
            SELECT o.table_name, id_a, id_b FROM o JOIN n x ON x.table_name = o.table_name AND x.id = id_a JOIN n y ON y.table_name = o.table_name AND y.id = id_b
            WHERE both_ * 10 >= 7 * (x.c + y.c - both_)
            UNION
            SELECT a.table_name, a.id, b.id FROM r a JOIN r b ON a.table_name = b.table_name AND a.t = b.t AND a.id < b.id""",
        "p7_found": f"""
            WITH m AS (SELECT source, max(target_share) AS share, max(max_repeats) AS reps FROM mix_targets GROUP BY source),
            t AS (SELECT m.source, share, reps, coalesce(sum(len(regexp_extract_all(d.text, '{_TOKEN}'))), 0) AS n FROM m LEFT JOIN documents d ON d.source = m.source GROUP BY ALL)
            SELECT source FROM t WHERE reps * n < share * (SELECT sum(n) FROM t)""",
    }
