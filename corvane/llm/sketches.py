"""Fixed-size summaries of all rows, merged block by block.

A summary is an array of ``2 ** bits`` counters.  Every task folds its rows into
one array and emits it as ``BLOCKS`` pieces; the pieces are added up per block by
the executors, so the driver receives one array whose size does not depend on the
data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = 16
PIECES = "block int, counts binary"


def pieces(counts: np.ndarray) -> pa.RecordBatch:
    """The emitted form of one task's array (32-bit counters)."""
    parts = np.array_split(np.minimum(counts, 0xFFFFFFFF).astype("<u4"), BLOCKS)
    return pa.RecordBatch.from_pydict(
        {"block": pa.array(range(BLOCKS), pa.int32()), "counts": pa.array([_pack(p) for p in parts], pa.binary())}
    )


def _pack(part: np.ndarray) -> bytes:
    """Byte planes, low bytes first: high planes are mostly zero and compress away."""
    return np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            part = _unpack(blob.as_py()).astype(np.uint64)
            sums[block] = sums[block] + part if block in sums else part
    for block, total in sums.items():
        yield pa.RecordBatch.from_pydict(
            {"block": pa.array([block], pa.int32()), "counts": pa.array([_pack(np.minimum(total, 0xFFFFFFFF).astype("<u4"))], pa.binary())}
        )


def collect_counts(rows: DataFrame, fold: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], bits: int) -> np.ndarray:
    """Run ``fold`` (rows to ``pieces``) over all rows and return the summed array."""
    merged = rows.mapInArrow(fold, PIECES).repartition(BLOCKS, F.col("block")).mapInArrow(_add_up, PIECES)
    got = {r["block"]: _unpack(bytes(r["counts"])) for r in merged.collect()}
    sizes = [len(p) for p in np.array_split(np.empty(1 << bits, np.uint8), BLOCKS)]
    return np.concatenate([got.get(b, np.zeros(sizes[b], np.uint32)) for b in range(BLOCKS)])
