"""Exact similarity join on token shingle sets (size-aware heavy-light join).

Every text becomes the set of its distinct runs of ``width`` consecutive tokens.
Two sets of sizes m <= n with Jaccard similarity at least t share an element
among the first ``n - ceil(t n) + 1`` elements of each (any common global order;
here: rarest first, by a fixed-size count sketch of all elements), and share two
among the first ``n - ceil(t n) + 2``.

* Light sets (size up to a boundary) enumerate all 2-subsets of that prefix; two
  light sets meet only on a shared subset.
* Heavy sets scan inverted lists of single prefix elements, in which light sets
  near the boundary are entered too.
* The boundary minimises the estimated cost of both, from the size histogram and
  the expected list length of the sketch.

Inside a list a pair must pass the size bound, the positional bound and a parity
bitmap of the elements from its position on: the parity of hashed elements
differs in at most as many bits as the sets differ in elements, so no true pair
is lost.  Lists expected to be longer than ``list_block`` are cut into blocks and
joined block against block.  What survives is verified on the full sets.  Exact
copies enter the join once.

Entries travel in buckets whose number follows from the set sizes, so that a bucket
has about ``BUCKET_BYTES`` whatever the data; a task reads its buckets in order and
holds one at a time.  The sketch grows with the text up to ``SKETCH_BITS[1]``; beyond
that its noise blurs the order among rare elements only, which costs tests, never
pairs, and the length expected of a list is taken above that noise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import materialize, shuffle_partitions
from corvane.llm import sketches
from corvane.llm.tokens import mix64, shingle_hashes, tokenize

#: Counters of the element sketch and bits of the candidate filter, as powers of two:
#: least and most.
SKETCH_BITS, FILTER_BITS = (20, 23), (23, 28)
#: Expected bytes of one bucket and of one task's buckets, and the most tasks to plan;
#: with more data a task has more buckets, not larger ones.
BUCKET_BYTES, TASK_BYTES, MOST_TASKS = 1 << 20, 6 << 20, 50_000
#: Sets of up to CLASS_SIZE elements carry bitmaps of 4 words; the size doubles with each
#: further class, and bitmaps grow so that those of large sets do not fill up.
CLASS_SIZE = 512
SUBSET_WORDS = 4
SUBSETS = -1
SUB_BATCH = 1000
TESTS_AT_ONCE = 400_000
#: Cost of one emitted list entry or subset key, in pair tests.
ENTRY_COST, KEY_COST = 50, 50
_SALT = np.uint64(0x5851F42D4C957F2D)
_ODD = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class JoinParameters:
    threshold: Fraction
    width: int
    boundary: int
    buckets: int
    list_block: int
    bits: int


def bitmap_words(k: int) -> int:
    """Words of the bitmaps of a class: enough bits for twice the differences that two
    sets of its size may have after an average first common place."""
    return 4 if k == 0 else max(6, (CLASS_SIZE << k) * 5 // 1024)


def _share(size: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t * size) in integers."""
    return -((-size * t.numerator) // t.denominator)


def _needed(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Smallest overlap of two sets with similarity t; ``sizes`` is the sum of both."""
    u = t / (1 + t)
    return -((-sizes * u.numerator) // u.denominator)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every lower-cased text, and each text's bounds."""
    hashes, bounds = shingle_hashes(tokenize([t.lower() if t else t for t in texts]), width)
    sets = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
    ends = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ends


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list, np.ndarray]]:
    """Small slices of (set id, text, table salt), each set id once per task."""
    seen: set[int] = set()
    for batch in batches:
        sids, texts, tables = (batch.column(i).to_pylist() for i in range(3))
        fresh = []
        for i, s in enumerate(sids):
            if s not in seen:
                seen.add(s)
                fresh.append(i)
        for a in range(0, len(fresh), SUB_BATCH):
            part = fresh[a : a + SUB_BATCH]
            salts = np.array([np.uint64(tables[i] & 0xFFFFFFFFFFFFFFFF) for i in part], np.uint64)
            yield np.array([sids[i] for i in part], np.int64), [texts[i] for i in part], salts


def _fold_counts(width: int, histogram: int, bits: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        sizes = np.zeros(histogram, np.int64)
        for _, texts, salts in _distinct(batches):
            flat, ends = shingle_sets(texts, width)
            n = np.diff(ends)
            at, times = np.unique(mix64(flat ^ np.repeat(salts, n)) & np.uint64((1 << bits) - 1), return_counts=True)
            counts[at] += times.astype(np.uint32)
            sizes += np.bincount(np.minimum(n, histogram - 1), minlength=histogram)
        yield sketches.pieces(counts)
        # the histogram of set sizes rides along in the blocks after the counters
        for block, part in enumerate(np.array_split(sizes, sketches.BLOCKS)):
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([sketches.BLOCKS + block], pa.int32()), "counts": pa.array([sketches._pack(part.astype("<u4"))], pa.binary())}
            )

    return fold


def element_statistics(sets: DataFrame, width: int, bits: int, histogram: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Sketch of element counts over all sets, and the histogram of set sizes
    (sizes beyond its end count at its end)."""
    merged = (
        sets.mapInArrow(_fold_counts(width, histogram, bits), sketches.PIECES)
        .repartition(2 * sketches.BLOCKS, F.col("block"))
        .mapInArrow(sketches._add_up, sketches.PIECES)
    )
    got = {r["block"]: sketches._unpack(bytes(r["counts"])) for r in merged.collect()}

    def whole(first: int, size: int) -> np.ndarray:
        lengths = [len(p) for p in np.array_split(np.empty(size, np.uint8), sketches.BLOCKS)]
        return np.concatenate([got.get(first + b, np.zeros(lengths[b], np.uint32)) for b in range(sketches.BLOCKS)])

    return whole(0, 1 << bits), whole(sketches.BLOCKS, histogram)


def choose_boundary(counts: np.ndarray, sizes: np.ndarray, t: Fraction) -> int:
    """Largest light set size: the boundary of least estimated total cost."""
    n = np.arange(len(sizes), dtype=np.int64)
    prefix = np.where(n > 0, n - _share(n, t) + 1, 0)
    ranked = np.sort(counts[counts > 0].astype(np.float64))
    mass = np.cumsum(ranked)
    rare = ranked[: max(1, np.searchsorted(mass, float(1 - t) * mass[-1]))] if len(ranked) else np.ones(1)
    list_length = (rare**2).sum() / rare.sum()
    light = sizes * (prefix + 1.0) * prefix / 2 * KEY_COST
    heavy = sizes * prefix * (ENTRY_COST + list_length)
    total = np.cumsum(light) + heavy.sum() - np.cumsum(heavy)
    return int(np.argmin(total))


def list_lengths(counts: np.ndarray) -> np.ndarray:
    """Expected list length per quarter-octave rank: the upper end of the rank without
    the noise that every counter holds, the median count."""
    return np.maximum(1.0, 2 ** ((np.arange(256) + 1) / 4) - float(np.median(counts)))


def entry_bytes(sizes: np.ndarray, par: JoinParameters) -> int:
    """Bytes of all list entries and subset keys at most, from the histogram of set sizes."""
    n = np.flatnonzero(sizes)
    prefix = n - _share(n, par.threshold) + 1
    words = np.array([bitmap_words(k) for k in np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / CLASS_SIZE))).astype(int)])
    light = np.where(n <= par.boundary, (prefix + 1) * prefix // 2 * (16 + 8 * SUBSET_WORDS), 0)
    return int((sizes[n].astype(np.int64) * (prefix * (21 + 8 * words) + light)).sum())


def _log_counts(counts: np.ndarray) -> np.ndarray:
    """Counters on a quarter-octave scale in one byte; 0 for a count of at most 1."""
    return np.minimum(255, np.floor(4 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _columns(**arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def _parity(elements: np.ndarray, words: int) -> np.ndarray:
    bit = (mix64(elements ^ _SALT) % np.uint64(64 * words)).astype(np.int64)
    out = np.zeros((len(elements), words), np.uint64)
    out[np.arange(len(elements)), bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
    return out


def _blobs(kind: int, bucket: np.ndarray, **arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = {k: v[order] for k, v in arrays.items()}
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    blobs = [_columns(**{k: v[a:b] for k, v in arrays.items()}) for a, b in zip(cuts[:-1], cuts[1:])]
    yield pa.RecordBatch.from_pydict(
        {"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "kind": pa.array([kind] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())}
    )


def _entries(par: JoinParameters, log_counts):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, lengths = log_counts.value
        for sids, texts, salts in _distinct(batches):
            flat, ends = shingle_sets(texts, par.width)
            n = np.diff(ends)
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(n)), n)
            elements = mix64(flat ^ salts[owner])
            rank = logs[(elements & np.uint64((1 << par.bits) - 1)).astype(np.int64)]
            order = np.lexsort((elements, rank, owner))
            elements, rank = elements[order], rank[order]
            yield from _list_entries(par, lengths, sids, elements, rank, ends)
            if par.boundary:
                yield from _subset_keys(par, sids, elements, rank, n, ends)

    return emit


def _list_entries(par, lengths, sids, elements, rank, ends) -> Iterator[pa.RecordBatch]:
    largest, k = int(np.diff(ends).max()), 0
    while True:
        # a pair is joined in the class of its larger set
        least = 0 if k == 0 else int(_share(np.int64((CLASS_SIZE << (k - 1)) + 1), par.threshold))
        sets = np.flatnonzero((np.diff(ends) >= max(1, least)) & (np.diff(ends) <= CLASS_SIZE << k))
        if len(sets):
            yield from _class_entries(par, lengths, k, sets, sids, elements, rank, ends)
        if CLASS_SIZE << k >= largest:
            break
        k += 1


def _class_entries(par, lengths, k, sets, sids, elements, rank, ends) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(ends)[sets]
    own_ends = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(own_ends[-1]) - np.repeat(own_ends[:-1] - ends[:-1][sets], sizes)
    elements, rank = elements[at], rank[at]
    owner, size = np.repeat(np.arange(len(sets)), sizes), np.repeat(sizes, sizes)
    pos = np.arange(len(elements)) - own_ends[:-1][owner]
    listed = size >= _share(np.int64(par.boundary + 1), par.threshold)
    prefix = size - _share(size, par.threshold) + 1
    if k:
        # sets of the class below only meet sets that are larger than it
        below = CLASS_SIZE << (k - 1)
        prefix = np.where(size <= below, size - _needed(size + below + 1, par.threshold) + 1, prefix)
    keep = np.flatnonzero((pos < prefix) & (rank > 0) & listed)
    if not len(keep):
        return
    sids, ends, words = sids[sets], own_ends, bitmap_words(k)
    bits = _parity(elements, words)
    after = np.bitwise_xor.accumulate(bits[::-1], axis=0)[::-1]
    after = np.concatenate([after, np.zeros((1, words), np.uint64)])
    own = owner[keep]
    bitmap = after[keep] ^ after[ends[1:][own]]
    element = elements[keep]
    blocks = np.ceil(lengths[rank[keep]] / par.list_block).astype(np.int64)
    side = np.full(len(keep), 2, np.uint8)
    if (blocks > 1).any():
        copies = np.maximum(blocks, 1)
        src = np.repeat(np.arange(len(keep)), copies)
        other = np.arange(len(src)) - np.repeat(np.cumsum(copies) - copies, copies)
        mine = (mix64(sids[own[src]].view(np.uint64)) % copies[src].astype(np.uint64)).astype(np.int64)
        low, high = np.minimum(mine, other), np.maximum(mine, other)
        side = np.where(low == high, 2, np.where(mine == low, 0, 1)).astype(np.uint8)
        cell = (low * copies[src] + high).astype(np.uint64)
        element = np.where(copies[src] > 1, mix64(element[src] + cell * _ODD), element[src])
        keep, own, bitmap = keep[src], own[src], bitmap[src]
    bucket = ((element >> np.uint64(33)) % np.uint64(par.buckets)).astype(np.int64)
    yield from _blobs(
        k, bucket, h=(element & np.uint64(0xFFFFFFFF)).astype("<u4"), sid=sids[own].astype("<i8"), n=size[keep].astype("<u4"), pos=pos[keep].astype("<u4"), side=side, bits=bitmap.astype("<u8")
    )


def _subset_keys(par, sids, elements, rank, n, ends) -> Iterator[pa.RecordBatch]:
    keys, own, bits = [], [], []
    for i in np.flatnonzero((n <= par.boundary) & (n > 0)):
        a, b = ends[i], ends[i + 1]
        limit = min(int(n[i]), int(n[i] - _share(n[i], par.threshold) + 2))
        live = np.sort(elements[a : a + limit][rank[a : a + limit] > 0])
        if limit < 2 or n[i] - _share(n[i], par.threshold) + 2 > n[i]:
            # too small for two shared elements: the single element is its key
            live = np.concatenate([live, live[-1:]]) if len(live) == 1 else live
            pairs = mix64(live * _ODD + np.uint64(1))
        else:
            x, y = np.triu_indices(len(live), 1)
            pairs = mix64(live[x] * _ODD + mix64(live[y]))
        keys.append(np.unique(pairs))
        own.append(np.full(len(keys[-1]), i))
        bits.append(np.repeat(np.bitwise_xor.reduce(_parity(elements[a:b], SUBSET_WORDS), axis=0)[None], len(keys[-1]), axis=0))
    if keys:
        key, who = np.concatenate(keys), np.concatenate(own)
        bucket = ((key >> np.uint64(33)) % np.uint64(par.buckets)).astype(np.int64)
        yield from _blobs(SUBSETS, bucket, h=(key & np.uint64(0xFFFFFFFF)).astype("<u4"), sid=sids[who].astype("<i8"), n=n[who].astype("<u4"), bits=np.concatenate(bits).astype("<u8"))


def _read(blobs: list[bytes], widths: list[tuple[str, int, int]]) -> list[np.ndarray]:
    """Columns of all blobs, joined."""
    total = sum(w for _, w, _ in widths)
    out: list[list[np.ndarray]] = [[] for _ in widths]
    for blob in blobs:
        rows, at = len(blob) // total, 0
        for k, (dtype, w, many) in enumerate(widths):
            part = np.frombuffer(blob, dtype, rows * many, at)
            out[k].append(part.reshape(rows, many) if many > 1 else part)
            at += rows * w
    return [np.concatenate(x) for x in out]


_LIST = [("<u4", 4, 1), ("<i8", 8, 1), ("<u4", 4, 1), ("<u4", 4, 1), ("u1", 1, 1)]
_SUBSET = [("<u4", 4, 1), ("<i8", 8, 1), ("<u4", 4, 1), ("<u8", 8 * SUBSET_WORDS, SUBSET_WORDS)]


def _pairs_within(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j < ends[i], a bounded number at a time."""
    many = ends - np.arange(len(ends)) - 1
    done = np.concatenate([[0], np.cumsum(many)])
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(done, done[a] + TESTS_AT_ONCE, "right")) - 1)
        part = many[a:b]
        if part.sum():
            i = np.repeat(np.arange(a, b), part)
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        a = b


def _in_lists(par: JoinParameters, blobs: list[bytes], kind: int) -> np.ndarray:
    """Distinct candidate pairs (two set ids per row) of one bucket and class."""
    t, subsets = par.threshold, kind == SUBSETS
    if subsets:
        h, sid, n, bits = _read(blobs, _SUBSET)
        side, pos = np.full(len(h), 2, np.uint8), np.zeros(len(h), np.int64)
    else:
        words = bitmap_words(kind)
        h, sid, n, pos, side, bits = _read(blobs, [*_LIST, ("<u8", 8 * words, words)])
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    order = np.lexsort((side, sid, n, h))
    h, sid, n, pos, side, bits = h[order], sid[order], n[order], pos[order], side[order], bits[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (sid[1:] == sid[:-1]) & (side[1:] == side[:-1])
    if same.any():
        h, sid, n, pos, side, bits = (x[~same] for x in (h, sid, n, pos, side, bits))
    ends = np.searchsorted(h, h, "right")
    # a list is in ascending size, and nothing larger than n / t can be similar
    high = h.astype(np.uint64) << np.uint64(32)
    largest = np.minimum(n * t.denominator // t.numerator, 0xFFFFFFFF).astype(np.uint64)
    reach = np.searchsorted(high | n.astype(np.uint64), high | largest, "right")
    ends = np.minimum(ends, np.maximum(reach, np.arange(len(h)) + 1))
    found = []
    for i, j in _pairs_within(ends):
        both = n[i] + n[j]
        need = _needed(both, t)
        ok = (sid[i] != sid[j]) & (n[i] * t.denominator >= n[j] * t.numerator)
        ok &= (side[i] == 2) & (side[j] == 2) | (side[i] + side[j] == 1)
        if not subsets:
            ok &= np.maximum(n[i], n[j]) > max(par.boundary, CLASS_SIZE << (kind - 1) if kind else 0)
            ok &= 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= need
        i, j, allowed = i[ok], j[ok], (both - 2 * need - pos[i] - pos[j])[ok]
        ok = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= allowed
        if ok.any():
            a, b = sid[i[ok]], sid[j[ok]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _meet(par: JoinParameters):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in the order of (bucket, kind): a bucket is done when its rows end
        at, blobs = None, []

        def pairs() -> Iterator[pa.RecordBatch]:
            found = _in_lists(par, blobs, at[1]) if at else ()
            if len(found):
                yield pa.RecordBatch.from_pydict({"sid_a": pa.array(found[:, 0], pa.int64()), "sid_b": pa.array(found[:, 1], pa.int64())})

        for batch in batches:
            for bucket, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (bucket, kind) != at:
                    yield from pairs()
                    at, blobs = (bucket, kind), []
                blobs.append(blob)
        yield from pairs()

    return meet


def _mark(bits: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, bool)
        for batch in batches:
            for k in range(batch.num_columns):
                marks[_filter_slot(batch.column(k).to_numpy(zero_copy_only=False), bits)] = True
        for block, part in enumerate(np.array_split(np.packbits(marks), sketches.BLOCKS)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    return mark


def _merge_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(blob, np.uint8)
            kept[block] = kept[block] | part if block in kept else part
    for block, part in kept.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})


def _filter_slot(sids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(sids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _marked(marks, bits: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = marks.value
        for batch in batches:
            slot = _filter_slot(batch.column(0).to_numpy(zero_copy_only=False), bits)
            hit = packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1
            if hit.any():
                yield batch.filter(pa.array(hit))

    return keep


def _fitting(many: int, limits: tuple[int, int]) -> int:
    """The power of two that holds ``many``, within limits."""
    return min(max(int(many).bit_length(), limits[0]), limits[1])


def candidate_texts(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(sid, text) of the sets in candidate pairs, each once; others are mostly kept out of
    the shuffle by a bit table whose size follows the number of pairs."""
    spark = records.sparkSession
    bits = _fitting(16 * candidates.count(), FILTER_BITS)
    marked = candidates.select("sid_a", "sid_b").mapInArrow(_mark(bits), sketches.PIECES).repartition(sketches.BLOCKS, "block").mapInArrow(_merge_marks, sketches.PIECES)
    pieces = {r["block"]: np.frombuffer(bytes(r["counts"]), np.uint8) for r in marked.collect()}
    size = (1 << bits) // 8 // sketches.BLOCKS
    marks = spark.sparkContext.broadcast(np.concatenate([pieces.get(b, np.zeros(size, np.uint8)) for b in range(sketches.BLOCKS)]))
    return records.select("sid", "text").mapInArrow(_marked(marks, bits), "sid long, text string").dropDuplicates(["sid"])


def _verify(par: JoinParameters):
    t = par.threshold

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i).to_pylist() for i in range(4))
            keep, shared, union = [], [], []
            for at in range(0, len(a), SUB_BATCH):
                la, ea = shingle_sets(left[at : at + SUB_BATCH], par.width)
                lb, eb = shingle_sets(right[at : at + SUB_BATCH], par.width)
                for i in range(len(ea) - 1):
                    x, y = la[ea[i] : ea[i + 1]], lb[eb[i] : eb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    all_ = len(x) + len(y) - both
                    if all_ and both * t.denominator >= all_ * t.numerator:
                        keep.append(at + i)
                        shared.append(both)
                        union.append(all_)
            if keep:
                yield pa.RecordBatch.from_pydict(
                    {"sid_a": pa.array([a[i] for i in keep], pa.int64()), "sid_b": pa.array([b[i] for i in keep], pa.int64()), "shared": pa.array(shared, pa.int32()), "in_union": pa.array(union, pa.int32())}
                )

    return verify


def with_set_ids(records: DataFrame, table: str, key: str, text: str) -> DataFrame:
    """(table_name, id, text, sid): equal lower-cased texts of a table share ``sid``.
    Rows with a null key or text are left out."""
    return records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.lit(table).alias("table_name"), F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.xxhash64(F.lit(table), F.lower(F.col(text))).alias("sid")
    )


def similar_texts(records: DataFrame, threshold: float = 0.8, width: int = 5, list_block: int = 8192, boundary: int | None = None) -> DataFrame:
    """All pairs of different texts (sid_a < sid_b) of one table whose shingle sets
    have Jaccard similarity of at least ``threshold``: (sid_a, sid_b, shared, in_union).

    ``records`` comes from :func:`with_set_ids`.  A text of fewer than ``width``
    tokens has no shingles and is similar to no other text.  Repeated rows and
    exact copies count once.  ``boundary`` overrides the chosen light set size.
    """
    spark = records.sparkSession
    t = Fraction(str(threshold))
    if not 0 < t <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    sets = records.select("sid", "text", F.xxhash64("table_name").alias("salt"))
    # a text has at most as many elements as characters
    bits = _fitting((records.agg(F.sum(F.length("text"))).first()[0] or 0) // 4, SKETCH_BITS)
    counts, sizes = element_statistics(sets, width, bits)
    par = JoinParameters(t, width, choose_boundary(counts, sizes, t) if boundary is None else boundary, 1, list_block, bits)
    size = entry_bytes(sizes, par)
    par = replace(par, buckets=min(max(4 * shuffle_partitions(spark), size // BUCKET_BYTES), (1 << 31) - 1))
    tasks = min(max(shuffle_partitions(spark), -(-size // TASK_BYTES)), MOST_TASKS)
    log_counts = spark.sparkContext.broadcast((_log_counts(counts), list_lengths(counts)))
    entries = sets.mapInArrow(_entries(par, log_counts), "bucket int, kind int, blob binary")
    placed = entries.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket", "kind")
    candidates = materialize(placed.mapInArrow(_meet(par), "sid_a long, sid_b long").distinct(), "similar-candidates")
    texts = candidate_texts(records, candidates)
    left = texts.select(F.col("sid").alias("sid_a"), F.col("text").alias("left"))
    right = texts.select(F.col("sid").alias("sid_b"), F.col("text").alias("right"))
    return candidates.join(left, "sid_a").join(right, "sid_b").select("sid_a", "sid_b", "left", "right").mapInArrow(_verify(par), "sid_a long, sid_b long, shared int, in_union int")


def expand_pairs(records: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of different records (table_name, id_a < id_b): copies of one text, and
    records of linked texts."""
    members = records.select("table_name", "id", "sid").distinct()
    repeated = members.groupBy("sid").count().where("count > 1").select("sid")
    copies = members.join(repeated, "sid", "left_semi")
    a, b = copies.alias("a"), copies.alias("b")
    same = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.id") < F.col("b.id"))).select(
        F.col("a.table_name").alias("table_name"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")
    )
    left = members.select("table_name", F.col("id").alias("x"), F.col("sid").alias("sid_a"))
    right = members.select(F.col("table_name").alias("other"), F.col("id").alias("y"), F.col("sid").alias("sid_b"))
    linked = (
        links.select("sid_a", "sid_b")
        .join(left, "sid_a")
        .join(right, "sid_b")
        .where((F.col("table_name") == F.col("other")) & (F.col("x") != F.col("y")))
        .select("table_name", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return same.unionByName(linked).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph (a, b), component = least node, by
    alternating large-star and small-star steps; each round is written and read
    again.  A node of many edges costs one aggregate, never a collected list."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "components")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "components")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = (state["n"], state["h"])
    raise RuntimeError("components did not settle")


def near_duplicate_groups(records: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record: (table_name, id, class_id, links).  ``class_id`` is the
    least set id reachable over links; ``links`` counts linked different texts."""
    members = records.select("table_name", "id", "sid").distinct()
    components = connected_components(links.select(F.col("sid_a").alias("a"), F.col("sid_b").alias("b")))
    degree = links.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("links"))
    return (
        members.join(components.withColumnRenamed("node", "sid"), "sid", "left")
        .join(degree, "sid", "left")
        .select("table_name", "id", F.coalesce("component", "sid").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
