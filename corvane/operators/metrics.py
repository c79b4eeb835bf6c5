"""Evaluation of rankings, routes, citations and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(relevant: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(query_id, hit, recall, reciprocal_rank, ndcg) at ``k`` of every query of ``relevant``
    (query_id, id) or ``ranked`` (query_id, id, rank); recall and ndcg are 1 without any
    relevant id, hit and reciprocal rank 0."""
    truth = relevant.where("id is not null").select("query_id", "id").distinct()
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranked.join(truth, ["query_id", "id"], "left_semi")
    gained = hits.groupBy("query_id").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("found"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank").cast("double") + 1)).otherwise(0.0)).alias("gain")
    )
    ids = relevant.select("query_id").union(ranked.select("query_id")).distinct()
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i.cast("double") + 1))
    rows = ids.join(sizes, "query_id", "left").join(gained, "query_id", "left")
    none = F.col("n").isNull()
    return rows.select(
        "query_id",
        F.when(F.coalesce("found", F.lit(0)) > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(F.when(none, 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("n")), 6).alias("recall"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(none, 1.0).otherwise(F.coalesce("gain", F.lit(0.0)) / ideal), 6).alias("ndcg"),
    )


def set_precision(got: Column, want: Column) -> Column:
    """|got & want| / |got|; without any got: 1 if nothing was wanted, else 0."""
    n = F.size(F.array_distinct(got))
    return F.when(n > 0, F.size(F.array_intersect(got, want)).cast("double") / n).otherwise(F.when(F.size(want) == 0, 1.0).otherwise(0.0))


def set_recall(got: Column, want: Column) -> Column:
    """|got & want| / |want|; 1 if nothing was wanted."""
    n = F.size(F.array_distinct(want))
    return F.when(n > 0, F.size(F.array_intersect(got, want)).cast("double") / n).otherwise(1.0)


def token_f1(rows: DataFrame, key: str, left: str, right: str, pattern: str = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+") -> DataFrame:
    """(key, f1, exact): overlap of the two texts' lower-case token multisets and whether the
    token sequences are equal; nulls are empty, two empty texts are equal."""
    cells = rows.select(key, *[F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0)).alias(n) for c, n in ((left, "a"), (right, "b"))])
    one = cells.select(key, F.explode("a").alias("t"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    two = cells.select(key, F.explode("b").alias("t"), F.lit(0).alias("x"), F.lit(1).alias("y"))
    common = one.unionByName(two).groupBy(key, "t").agg(F.least(F.sum("x"), F.sum("y")).alias("c")).groupBy(key).agg(F.sum("c").alias("c"))
    total = F.size("a") + F.size("b")
    return cells.join(common, key, "left").select(key, F.round(F.when(total == 0, 1.0).otherwise(2.0 * F.coalesce("c", F.lit(0)) / total), 6).alias("f1"), (F.col("a") == F.col("b")).alias("exact"))


def refusal_counts(rows: DataFrame) -> DataFrame:
    """(correct, false_refusals, missed) of rows (should_refuse, refused)."""
    s, r = F.coalesce("should_refuse", F.lit(False)), F.coalesce("refused", F.lit(False))
    return rows.agg(F.count_if(s & r).alias("correct"), F.count_if(~s & r).alias("false_refusals"), F.count_if(s & ~r).alias("missed"))


def compare_reports(baseline: DataFrame, candidate: DataFrame, gates: DataFrame) -> DataFrame:
    """(metric, delta, passed): gates (metric, min_delta) on candidate - baseline (metric,
    value); a missing metric fails."""
    b, c = baseline.select("metric", F.col("value").alias("b")), candidate.select("metric", F.col("value").alias("c"))
    rows = gates.join(b, "metric", "left").join(c, "metric", "left").withColumn("delta", F.round(F.col("c") - F.col("b"), 6))
    return rows.select("metric", "delta", F.coalesce(F.col("delta") >= F.col("min_delta"), F.lit(False)).alias("passed"))


def observation_series(rows: DataFrame, name: str, value: str) -> DataFrame:
    """(name, observations, total, mean, least, most) of a value per series."""
    return rows.groupBy(name).agg(F.count(value).alias("observations"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def citation_metrics(rows: DataFrame, key: str) -> DataFrame:
    """(key, precision, recall, completeness) of rows (cited, relevant arrays, claims,
    cited_claims counts); completeness is the share of claims with a citation, at most 1."""
    complete = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("cited_claims").cast("double"), F.col("claims"))), F.lit(1.0))
    return rows.select(key, F.round(set_precision(F.col("cited"), F.col("relevant")), 6).alias("precision"), F.round(set_recall(F.col("cited"), F.col("relevant")), 6).alias("recall"), F.round(complete, 6).alias("completeness"))


def run_report(rows: DataFrame, measures: list[str]) -> DataFrame:
    """(metric, value, examples): the mean of every measure over the rows that have it."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in measures])).alias("p")
    return rows.select(pairs).select("p.metric", "p.v").groupBy("metric").agg(F.round(F.avg("v"), 6).alias("value"), F.count("v").alias("examples"))


def chunk_report(chunks: DataFrame, most: int) -> DataFrame:
    """One row on a set of chunks: leaves, oversized, with_heading and duplicate ratios, and
    the share of leaves with a parent that exists."""
    leaves = chunks.where("chunk_level = 'leaf'")
    parents = chunks.where("chunk_level = 'parent'").select(F.col("id").alias("p")).distinct()
    rows = leaves.join(parents, F.col("parent_chunk_id") == F.col("p"), "left")
    n = F.count("*")
    ratio = lambda c: F.round(F.coalesce(F.try_divide(c.cast("double"), n), F.lit(0.0)), 6)
    return rows.agg(
        n.alias("leaves"), F.count_if(F.col("token_count") > most).alias("oversized"), ratio(F.count_if(F.size("heading_path") > 0)).alias("heading_ratio"),
        ratio(n - F.countDistinct(F.coalesce("text", F.lit("")))).alias("duplicate_ratio"), ratio(F.count_if(F.col("parent_chunk_id").isNull() | F.col("p").isNotNull())).alias("parent_integrity"),
    )
