"""Inverted index and BM25 search over a built index.

An index is made once per population of entries and read by every search: postings,
sorted by term and carrying what a hit needs, locators, and the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.storage import materialize, scratch
from corvane.functions.text import exact_anchors, lexical_tokens, normal

K1, B = 1.5, 0.75
LOCATOR_WEIGHT, LOCATOR_BONUS = 8.0, 100.0
LOCATOR = "^(?:clause|chapter|step):"


def postings(entries: DataFrame) -> DataFrame:
    """(id, term, tf) of entries (id, text); entries without terms have no row."""
    terms = entries.select("id", F.explode(lexical_tokens(normal(F.col("text")))).alias("term"))
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_lengths(posting: DataFrame) -> DataFrame:
    return posting.groupBy("id").agg(F.sum("tf").alias("dl"))


def term_statistics(posting: DataFrame) -> DataFrame:
    """(term, df, cf): entries that contain a term, and its occurrences."""
    return posting.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_weights(queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of queries (query_id, text): distinct terms, locators
    weigh more."""
    terms = queries.select("query_id", F.explode(F.array_distinct(lexical_tokens(normal(F.col("text"))))).alias("term"))
    return terms.withColumn("weight", F.when(F.col("term").rlike(LOCATOR), F.lit(LOCATOR_WEIGHT)).otherwise(F.lit(1.0)))


def _locators(rows: DataFrame, key: str, text: Column) -> DataFrame:
    return rows.select(key, F.explode(F.filter(exact_anchors(normal(text)), lambda a: a.rlike(LOCATOR))).alias("locator"))


def rank(scored: DataFrame, group: str, key: str, score: str, limit: int, name: str = "rank") -> DataFrame:
    """The ``limit`` best rows per group by (-score, key), numbered from 1."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= limit)


@dataclass(frozen=True)
class LexicalIndex:
    """postings (term, id, tf, dl, source_id), locators (locator, id, source_id), terms
    (term, df, cf) and totals (n, tokens), as read from their tables."""

    postings: DataFrame
    locators: DataFrame
    terms: DataFrame
    totals: DataFrame


_PARTS = ("postings", "locators", "terms", "totals")


def write_lexical_index(entries: DataFrame, folder: str, version: str = "") -> None:
    """Index of entries (id, text, section_number and, if there, source_id) as four tables.

    Postings are range-partitioned and sorted by term, so that a search reads the files and
    row groups of its terms only; a frequent term spreads over several ranges by id."""
    spark = entries.sparkSession
    source = F.col("source_id") if "source_id" in entries.columns else F.lit(None).cast("string")
    plain = entries.where("id is not null").select("id", normal(F.col("text")).alias("text"), normal(F.col("section_number")).alias("section"), source.alias("source_id"))
    # an entry is tokenised once: counts per term and the length are made inside its row
    counted = plain.select("id", "source_id", lexical_tokens(F.col("text")).alias("t")).select("id", "source_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    posting = counted.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("source_id").alias("source_id"))
    posting.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings")
    term_statistics(stored).sort("term").write.mode("overwrite").parquet(f"{folder}/terms")
    named = F.when(F.length("section") > 0, F.col("section")).otherwise(F.col("text"))
    located = plain.select(F.explode(F.filter(exact_anchors(named), lambda x: x.rlike(LOCATOR))).alias("locator"), "id", "source_id")
    located.repartitionByRange("locator", "id").sortWithinPartitions("locator").write.mode("overwrite").parquet(f"{folder}/locators")
    totals = plain.agg(F.count("*").alias("n")).crossJoin(stored.agg(F.sum("tf").alias("tokens")))
    totals.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{folder}/totals")


def read_lexical_index(spark: SparkSession, folder: str, pinned: str | None = None) -> LexicalIndex:
    """The index of a folder; ``pinned``, if given, must be the version it was written as."""
    index = LexicalIndex(*(spark.read.parquet(f"{folder}/{part}") for part in _PARTS))
    if pinned is not None and (found := index.totals.first()["version"]) != pinned:
        raise ValueError(f"the index is of version {found!r}, not {pinned!r}")
    return index


def bm25_search(index: LexicalIndex, queries: DataFrame, limit: int, scopes: DataFrame | None = None, most_terms: int = 500_000) -> DataFrame:
    """(query_id, id, score, rank) of the best entries per query (query_id, text).

    Statistics cover the whole index; ``scopes`` (query_id, source_id), if given, only
    restricts the result, inside the join of the postings.  A locator of the query that an
    entry's section number (its text, where it has none) names adds a bonus, also without
    any common term.  Scores are rounded to six places before ranking.  The terms of the
    queries are broadcast up to ``most_terms`` rows; beyond, they are joined by a shuffle.
    """
    wanted = query_weights(queries).join(index.terms.select("term", "df"), "term")
    asked = _locators(queries, "query_id", F.col("text"))
    if scopes is not None:
        scopes = scopes.select("query_id", F.col("source_id").alias("in_source")).distinct()
        wanted, asked = wanted.join(scopes, "query_id"), asked.join(scopes, "query_id")
    wanted, asked = materialize(wanted, "query-terms"), materialize(asked, "query-locators")
    small = F.broadcast if wanted.count() <= most_terms else (lambda x: x)
    within = (lambda q: F.col("source_id") == q["in_source"]) if scopes is not None else (lambda q: F.lit(True))
    p, q = index.postings, small(wanted).alias("q")
    hits = p.join(q, (p["term"] == F.col("q.term")) & within(wanted)).crossJoin(F.broadcast(index.totals))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.coalesce(F.try_divide(F.col("dl").cast("double") * F.col("n"), F.col("tokens")), F.lit(0.0))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length))
    bonus = index.locators.join(small(asked).alias("a"), (index.locators["locator"] == F.col("a.locator")) & within(asked))
    parts = hits.select("query_id", "id", part.alias("part")).unionByName(bonus.select("query_id", "id", F.lit(LOCATOR_BONUS).alias("part")))
    scored = parts.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
    return rank(scored, "query_id", "id", "score", limit)


def bm25(entries: DataFrame, queries: DataFrame, limit: int, scopes: DataFrame | None = None) -> DataFrame:
    """:func:`bm25_search` over entries that have no index yet: one is built for the call."""
    folder = scratch(entries.sparkSession, "lexical")
    write_lexical_index(entries, folder)
    return bm25_search(read_lexical_index(entries.sparkSession, folder), queries, limit, scopes)


def frequent_terms(rows: DataFrame, group: str, limit: int) -> DataFrame:
    """(group, term, cf, rank): the commonest terms of more than one character per group,
    by (-count, term).  ``rows``: group, text.  Counts are added up before ranking."""
    terms = rows.select(group, F.explode(lexical_tokens(normal(F.col("text")))).alias("term")).where(F.length("term") > 1)
    counts = terms.groupBy(group, "term").agg(F.count("*").alias("cf"))
    return rank(counts, group, "term", "cf", limit)
