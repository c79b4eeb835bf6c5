"""Vectors: validation, exact search and collapse."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.lexical import rank

#: Vectors of a query set are sent to all tasks in blocks of at most so many bytes.
QUERY_BLOCK_BYTES = 32 << 20


def squared(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def normalized(vector: Column) -> Column:
    """Unit vector in double precision; null for a zero, non-finite or null vector."""
    norm = F.sqrt(squared(vector))
    return F.when((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.transform(vector, lambda x: x.cast("double") / norm))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 for empty, unequal or zero ones."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    same = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(same, F.coalesce(F.try_divide(dot, F.sqrt(squared(left)) * F.sqrt(squared(right))), F.lit(0.0))).otherwise(0.0)


def character_vectors(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for an embedding model: 16 numbers, of which the first 15
    count the characters by (code point + place) modulo 15 and the last is 1."""
    out = np.ones((len(texts), 16))
    for i, t in enumerate(texts):
        cps = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out[i, :15] = np.bincount((cps + np.arange(len(cps))) % 15, minlength=15)
    return out


def embed(rows: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray] = character_vectors, batch: int = 32) -> DataFrame:
    """(key, embedding) of every row with a text, by a model called on ``batch`` texts at a
    time.  A batch must give as many vectors as it has texts, finite and all of one width."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = None
        for part in batches:
            texts, out = part.column(1).to_pylist(), []
            for a in range(0, len(texts), batch):
                got = np.asarray(model(texts[a : a + batch]), float)
                if got.ndim != 2 or len(got) != len(texts[a : a + batch]) or not np.isfinite(got).all() or got.shape[1] != (width or got.shape[1]):
                    raise ValueError("the model gave other vectors than asked for")
                width = got.shape[1]
                out += got.tolist()
            yield pa.RecordBatch.from_pydict({key: part.column(0), "embedding": pa.array(out, pa.list_(pa.float64()))})

    return rows.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def _search(block, ids: list, k: int, kinds: tuple[pa.DataType, pa.DataType]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def shrink() -> None:
            who, key, score = (np.concatenate(x) for x in zip(*best))
            order = np.lexsort((key, -score, who))
            who, key, score = who[order], key[order], score[order]
            first = np.searchsorted(who, who, "left")
            keep = np.arange(len(who)) - first < k
            best[:] = [(who[keep], key[keep], score[keep])]

        for batch in batches:
            key = np.asarray(batch.column(0).to_pylist())
            column = batch.column(1)
            m = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(key), -1)
            scores = np.round(m @ q.T, 6)
            # whole ties at the k-th place stay, the key decides later
            least = np.partition(scores, max(0, len(key) - k), axis=0)[max(0, len(key) - k)]
            at, who = np.nonzero(scores >= least)
            best.append((who, key[at], scores[at, who]))
            if sum(len(b[0]) for b in best) > 40 * k * len(ids):
                shrink()
        if best:
            shrink()
            who, key, score = best[0]
            yield pa.RecordBatch.from_pydict({"query_id": pa.array([ids[w] for w in who], kinds[0]), "id": pa.array(key.tolist(), kinds[1]), "score": pa.array(score, pa.float64())})

    return search


def dense_search(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, score, rank): exact inner products of unit vectors, rounded to six
    places.  ``vectors``: id, embedding; ``queries``: query_id, embedding (ids: bigint or string).
    Every query is held against all vectors with one matrix product per batch; each
    task keeps its best, so only ``limit`` rows per query and task are shuffled.  Zero
    and null vectors match nothing; vectors must have the queries' length."""
    spark = vectors.sparkSession
    unit = vectors.select("id", normalized(F.col("embedding")).alias("v")).where("v is not null and id is not null")
    out, block, size = None, [], 0
    names = [queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()]
    kinds = tuple({"string": pa.string(), "int": pa.int32()}.get(n, pa.int64()) for n in names)
    schema = f"query_id {names[0]}, id {names[1]}, score double"

    def of_block() -> DataFrame:
        ids = [r["query_id"] for r in block]
        sent = spark.sparkContext.broadcast(np.array([r["v"] for r in block], float))
        width = len(block[0]["v"])
        return unit.where(F.size("v") == width).mapInArrow(_search(sent, ids, limit, kinds), schema)

    for row in queries.select("query_id", normalized(F.col("embedding")).alias("v")).where("v is not null").orderBy("query_id").toLocalIterator():
        if block and (size > QUERY_BLOCK_BYTES or len(block[0]["v"]) != len(row["v"])):
            part = of_block()
            out, block, size = part if out is None else out.unionByName(part), [], 0
        block.append(row)
        size += 8 * len(row["v"])
    if block:
        part = of_block()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return rank(out, "query_id", "id", "score", limit)


def collapsed_vectors(vectors: DataFrame, max_group: int = 3, max_ratio: float = 0.01) -> DataFrame:
    """One row (entries, groups, largest_harmful, harmful_entries, ratio, passed).
    ``vectors``: id, embedding, fingerprint.  A group of equal vectors is harmful when
    it covers different contents."""
    groups = vectors.groupBy(F.xxhash64("embedding").alias("h"), "embedding").agg(F.count("*").alias("size"), F.countDistinct("fingerprint").alias("bodies"))
    harmful = (F.col("size") > 1) & (F.col("bodies") > 1)
    total = groups.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("entries"), F.count("*").alias("groups"),
        F.coalesce(F.max(F.when(harmful, F.col("size"))), F.lit(0)).alias("largest_harmful"), F.coalesce(F.sum(F.when(harmful, F.col("size"))), F.lit(0)).alias("harmful_entries"),
    )
    ratio = F.coalesce(F.try_divide(F.col("harmful_entries").cast("double"), F.col("entries")), F.lit(0.0))
    return total.withColumn("ratio", F.round(ratio, 6)).withColumn("passed", (F.col("largest_harmful") <= max_group) & (ratio <= max_ratio))
