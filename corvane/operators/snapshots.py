"""Changes between consecutive full snapshots of a table.

Records are kept in ranges of their key and sorted inside a range by snapshot and key.
The ranges are equal parts of the key's hash, so their bounds are the same for every
snapshot without sampling, and no key is hot: a range of a snapshot lines up with the
same range of the one before.  Each range streams through one task, which holds two
neighbouring slices and merges them with two pointers: a record only in the later one
was added, one only in the earlier one removed, one in both with another value changed.
The number of ranges follows from the number of records, so that a slice stays small
whatever a snapshot's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import shuffle_partitions

#: Records of all snapshots in one range, about; and the most tasks, beyond which a task
#: reads several ranges one after the other.
RANGE_RECORDS, MOST_TASKS = 100_000, 50_000


def snapshot_numbers(snapshots: DataFrame, snapshot: str, collection: str, order: str) -> DataFrame:
    """(snapshot, collection, seq, last): position of each snapshot in its collection by
    ``order``, then id, and the last position.  A snapshot delivered again counts once."""
    once = snapshots.where(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(F.min_by(collection, F.struct(order)).alias(collection), F.min(order).alias("_at"))
    w = Window.partitionBy(collection).orderBy(F.col("_at").asc_nulls_first(), snapshot)
    return once.select(
        snapshot,
        collection,
        F.row_number().over(w).alias("seq"),
        F.count("*").over(Window.partitionBy(collection)).alias("last"),
    )


def diff_snapshots(records: DataFrame, numbers: DataFrame, snapshot: str, collection: str, many: int) -> DataFrame:
    """Typed changes of every snapshot against the one before it.

    ``records``: _c, seq, last (collection, number and last number of the snapshot),
    record_kind, record_id and value (null-safe compared, by 128-bit digests), at most one
    row per id, kind and snapshot; ``many``: about how many there are.  Returns snapshot,
    record_kind, record_id and change (added, removed, changed).  First snapshots yield
    nothing; a null collection is a collection of its own.
    """
    parts = shuffle_partitions(records.sparkSession)
    ranges = max(parts, -(-many // RANGE_RECORDS))
    tasks = max(parts, min(ranges, MOST_TASKS))
    # equal parts of the hash of the key: the upper 31 bits scaled to the number of ranges
    place = F.shiftrightunsigned(F.xxhash64("_c", "record_kind", "record_id"), 33) * ranges
    rows = records.select(F.floor(place / float(1 << 31)).cast("int").alias("range"), "_c", "seq", "last", "record_kind", "record_id", F.unhex(F.md5("value")).alias("value"))
    kept = rows.repartitionById(tasks, F.col("range") % tasks).sortWithinPartitions("range", "_c", "seq", "record_kind", "record_id")
    changes = kept.mapInArrow(_merge, "_c string, seq int, record_kind string, record_id string, change string")
    named = numbers.select(F.col(collection).alias("n_c"), F.col("seq").cast("int").alias("n_seq"), snapshot)
    return changes.join(named, F.col("_c").eqNullSafe(F.col("n_c")) & (F.col("seq") == F.col("n_seq"))).select(snapshot, "record_kind", "record_id", "change")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two-pointer merge of neighbouring slices; rows come sorted by range, collection,
    snapshot number and key."""
    names = ["_c", "seq", "record_kind", "record_id", "change"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    # slices of one range and collection: (kind, id) and value of each record, in order
    at: tuple | None = None
    before: list[tuple] = []
    now: list[tuple] = []

    def close(following: tuple | None) -> None:
        """The slice ``now`` is whole: merge it with the one before; what it holds is gone
        where the next snapshot of the collection has no slice in this range."""
        nonlocal before, now
        if at is not None:
            where, c, seq, last = at
            if seq > 1:
                out.extend((c, seq, *key, change) for key, change in changed(before, now))
            if seq < last and (following is None or following[:3] != (where, c, seq + 1)):
                out.extend((c, seq + 1, *key, "removed") for key, _ in now)
                now = []
            before, now = (now if following and following[:2] == (where, c) else []), []

    for batch in batches:
        for where, c, seq, last, kind, ident, value in zip(*(batch.column(i).to_pylist() for i in range(7))):
            slice_ = (where, c, seq, last)
            if slice_ != at:
                close(slice_)
                at = slice_
            now.append(((kind, ident), value))
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
            out.clear()
    close(None)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)


def changed(before: list[tuple], now: list[tuple]) -> Iterator[tuple]:
    """(key, change) of two slices of (key, value), each in the order of distinct keys."""
    i, j = 0, 0
    while i < len(before) or j < len(now):
        if j == len(now) or i < len(before) and before[i][0] < now[j][0]:
            yield before[i][0], "removed"
            i += 1
        elif i == len(before) or now[j][0] < before[i][0]:
            yield now[j][0], "added"
            j += 1
        else:
            if before[i][1] != now[j][1]:
                yield now[j][0], "changed"
            i, j = i + 1, j + 1


def manifest_records(manifests: DataFrame, numbers: DataFrame) -> DataFrame:
    """Chunks and document versions of every index manifest, each id once, with the
    collection (_c), number and last number of its snapshot.  A chunk is present when
    chunk_ids lists it; its value is its content hash, null when the map has none.  Null
    ids are left out; null arrays and maps are empty."""
    once = manifests.where(F.col("index_version_id").isNotNull()).groupBy("index_version_id").agg(
        F.max_by(F.struct("chunk_ids", "child_content_hashes", "source_document_fingerprints"), F.struct("loaded_at")).alias("m")
    )
    # numbered while a snapshot is one row: its records then need one exchange only
    place = numbers.select("index_version_id", F.col("collection_id").alias("_c"), F.col("seq").cast("int").alias("seq"), F.col("last").cast("int").alias("last"))
    once = once.join(place, "index_version_id")
    at = ["_c", "seq", "last"]
    chunks = once.select(*at, F.col("m.child_content_hashes").alias("h"), F.explode(F.array_distinct("m.chunk_ids")).alias("record_id")).select(
        *at, F.lit("chunk").alias("record_kind"), "record_id", F.try_element_at("h", F.col("record_id")).alias("value")
    )
    documents = once.select(*at, F.explode("m.source_document_fingerprints").alias("record_id", "value")).select(*at, F.lit("document").alias("record_kind"), "record_id", "value")
    return chunks.unionByName(documents).where(F.col("record_id").isNotNull())


def manifest_changes(manifests: DataFrame) -> DataFrame:
    """(index_version_id, record_kind, record_id, change) over all collections."""
    numbers = snapshot_numbers(manifests, "index_version_id", "collection_id", "created_at")
    size = lambda c: F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0))
    many = manifests.agg((size("chunk_ids") + size("source_document_fingerprints")).alias("n")).first()["n"]
    return diff_snapshots(manifest_records(manifests, numbers), numbers, "index_version_id", "collection_id", many)
