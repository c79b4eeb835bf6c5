"""Mixing sources to target shares of the tokens.

The tokens of each source form one stream, cut into blocks of fixed length.  For
every output shard the number of slots per source is drawn from a multinomial
distribution over the target shares.  The k-th slot of a source takes the block at
the place k of a pseudorandom permutation of its blocks, a new permutation for each
repeat, and none beyond ``max_repeats`` repeats.  Blocks and slots are joined by
(source, block), so a large source spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import materialize
from corvane.llm.tokens import mix64, token_counts

#: Rows that one window of a running sum holds, about.
WINDOW_ROWS = 100_000


def bpe_counter(path: str, pattern: str) -> Callable[[list[str | None]], np.ndarray]:
    """A counter for a byte-level BPE vocabulary file of ranks."""

    def count(texts: list[str | None]) -> np.ndarray:
        import base64

        import tiktoken

        if not hasattr(count, "coder"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            count.coder = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return np.array([len(count.coder.encode_ordinary(t or "")) for t in texts])

    return count


def document_tokens(documents: DataFrame, targets: DataFrame, counter: Callable[[list[str | None]], np.ndarray] = token_counts, key: str = "doc_id") -> DataFrame:
    """(key, source, tokens) of the documents of the targeted sources; a null text has
    no tokens, a document without key or source takes no part."""
    kind = documents.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = np.concatenate([counter(batch.slice(a, 500).column(2).to_pylist()) for a in range(0, batch.num_rows, 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_pydict({key: batch.column(0), "source": batch.column(1), "tokens": pa.array(tokens.astype(np.int64), pa.int64())})

    wanted = targets.select("source").distinct()
    rows = documents.where(F.col(key).isNotNull()).select(key, "source", "text").join(wanted, "source", "left_semi").select(key, "source", "text")
    return rows.mapInArrow(count, f"`{key}` {kind}, source string, tokens bigint")


def once(targets: DataFrame) -> DataFrame:
    """One row per source: share and repeats of the largest repeated row; nulls are 0."""
    return targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))


def supply(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """Per targeted source: tokens, total, wanted_tokens and whether max_repeats times
    its tokens reach them (``reachable``)."""
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = once(targets).join(have, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))
    total = rows.agg(F.sum("tokens").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "tokens", "total", (F.col("target_share") * F.col("total")).alias("wanted_tokens"), (F.col("max_repeats") * F.col("tokens") >= F.col("target_share") * F.col("total")).alias("reachable")
    )


def running_start(rows: DataFrame, part: str, value: str, order: Column, many: int) -> DataFrame:
    """Adds ``start``: the sum of ``value`` before the row within ``part``.  Each part is
    summed in pieces whose number follows from ``many``, the number of rows, so no window
    holds a whole large part."""
    grouped = rows.withColumn("_g", F.pmod(F.xxhash64(order), F.lit(1 + many // WINDOW_ROWS)))
    w = Window.partitionBy(part, "_g").orderBy(order)
    sums = grouped.groupBy(part, "_g").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(part).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(part, "_g", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return grouped.withColumn("_inner", inner).join(offsets, [part, "_g"]).withColumn("start", F.col("_before") + F.col("_inner")).drop("_g", "_inner", "_before")


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size) at ``index``: a four-round Feistel
    network over the next even power of two, walked until it falls inside."""
    if size <= 1:
        return np.zeros(len(index), np.int64)
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            salt = np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix64(right + salt) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = out >= np.uint64(size)
    return out.astype(np.int64)


def _draw(shares: list[tuple[str, float]], slots: int, per_shard: int, seed: int):
    names = [s for s, _ in shares]
    p = np.array([x for _, x in shares], float)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for shard in rows["id"]:
                size = min(per_shard, slots - shard * per_shard)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, p / p.sum())
                out += [(int(shard), n, int(c)) for n, c in zip(names, counts) if c]
            yield pd.DataFrame(out, columns=["shard", "source", "slots"])

    return draw


def _place(seed: int):
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                k = np.arange(r.start, r.start + r.slots)
                k = k[k < r.max_repeats * r.blocks]
                repeat = k // r.blocks
                block = np.empty(len(k), np.int64)
                for e in np.unique(repeat):
                    at = repeat == e
                    block[at] = permute(k[at] % r.blocks, int(r.blocks), (r.source_key + 1000003 * int(e) + seed) & 0x7FFFFFFF)
                yield pd.DataFrame({"shard": r.shard, "source": r.source, "slot": k, "repeat": repeat.astype(np.int32), "block": block})

    return place


def mix_sources(documents: DataFrame, targets: DataFrame, block_tokens: int = 256, per_shard: int = 4096, seed: int = 17, counter: Callable[[list[str | None]], np.ndarray] = token_counts, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    The mix has as many tokens as all documents of the targeted sources.  Selection:
    one row per slot and document part (shard, source, slot, repeat, block, key,
    from_token, to_token); every token of a document occurs at most max_repeats times.
    Report: per source what it has, wants and got; ``actual_share`` is its share of
    the selected tokens.  Slots that a short source can't fill stay empty.
    """
    spark = documents.sparkSession
    tokens = materialize(document_tokens(documents, targets, counter, key), "mix-tokens")
    have = supply(tokens, targets)
    known = have.where("tokens > 0 and target_share > 0 and max_repeats > 0").orderBy("source").collect()
    total = have.agg(F.max("total")).first()[0] or 0
    slots = -(-total // block_tokens)
    shares = [(r["source"], r["target_share"]) for r in have.where("target_share > 0").orderBy("source").collect()]
    sizes = spark.createDataFrame([(r["source"], -(-r["tokens"] // block_tokens), r["max_repeats"]) for r in known], "source string, blocks bigint, max_repeats bigint")
    shards = spark.range(-(-slots // per_shard) if shares else 0)
    drawn = shards.mapInPandas(_draw(shares, slots, per_shard, seed), "shard bigint, source string, slots bigint")
    placed = running_start(drawn, "source", "slots", F.col("shard"), len(shares) * max(1, slots // per_shard)).join(F.broadcast(sizes), "source").withColumn("source_key", F.pmod(F.xxhash64("source"), F.lit(1 << 30)))
    taken = placed.mapInPandas(_place(seed), "shard bigint, source string, slot bigint, repeat int, block bigint")
    spans = running_start(tokens.where("tokens > 0"), "source", "tokens", F.col(key), tokens.count())
    first, last = F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("tokens") - 1) / block_tokens)
    parts = spans.select("source", key, "start", "tokens", F.explode(F.sequence(first, last)).alias("block")).select(
        "source",
        "block",
        key,
        F.greatest(F.lit(0), F.col("block") * block_tokens - F.col("start")).alias("from_token"),
        F.least(F.col("tokens"), (F.col("block") + 1) * block_tokens - F.col("start")).alias("to_token"),
    )
    selection = taken.join(parts, ["source", "block"]).select("shard", "source", "slot", "repeat", "block", key, "from_token", "to_token")
    got = selection.groupBy("source").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("selected_tokens"))
    report = have.join(got, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)).cast("long"))
    all_ = report.agg(F.sum("selected_tokens").alias("_all"))
    report = report.crossJoin(F.broadcast(all_)).withColumn("actual_share", F.when(F.col("_all") > 0, F.col("selected_tokens") / F.col("_all")).otherwise(0.0)).drop("_all", "total")
    return selection, report
