"""Held-out passages inside a training corpus.

Words are single CJK characters and unbroken runs of letters and digits, without
regard to case, width, punctuation and blanks.  Two passes over the corpus:

1. count every n-gram of the held-out passages in the whole corpus;
2. of any ``min_words - n + 1`` consecutive n-grams of a passage keep the rarest as
   seed, so that every shared run of ``min_words`` words contains a seed; find the
   seeds in the documents, measure the longest shared run on each seed's diagonal and
   score the surroundings by Smith-Waterman alignment.

Passages are the stated query set: they are taken in blocks of ``block_items`` and
each block's n-grams are sent to all tasks.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.sketches import collect_counts, pieces
from corvane.llm.tokens import CJK, SPACE, WORD, TokenBatch, code_points, mix64, runs, shingle_hashes

NGRAM = 12
_CHUNK = 500
_FILTER_BITS = 22
_TABLES: list[np.ndarray] = []
LEAKS = "item_id bigint, longest_run int, run_start int, aligned_words int, score int, passage_words int"


def _tables() -> list[np.ndarray]:
    """Per code point: the folded code point, its class, whether it needs the slow path."""
    if not _TABLES:
        fold = np.arange(0x110000, dtype=np.uint32)
        kind = np.full(0x110000, SPACE, np.uint8)
        slow = np.zeros(0x110000, bool)
        for cp in range(0x32400):
            if 0xD800 <= cp <= 0xF8FF:
                continue
            ch = chr(cp)
            if cp >= 128 and not 0x3400 <= cp < 0xA000:
                plain = ud.normalize("NFKC", ch).lower()
            else:
                plain = ch.lower()
            if len(plain) == 1:
                fold[cp] = ord(plain)
            elif plain:
                slow[cp] = True
            if ud.combining(ch):
                slow[cp] = True
            if ud.category(ch)[0] in "LN":
                kind[cp] = WORD
        kind[0x3400:0xA000] = CJK
        _TABLES.extend([fold, kind, slow])
    return _TABLES


def fold_words(texts: list[str | None]) -> TokenBatch:
    """Words of every text.  Texts with combining marks or characters that fold to
    several ones are normalised as a whole first."""
    fold, kind, slow = _tables()
    texts = [t or "" for t in texts]
    cps, bounds = code_points(texts)
    odd = np.flatnonzero(slow[cps])
    if len(odd):
        for i in np.unique(np.searchsorted(bounds, odd, "right") - 1):
            texts[i] = ud.normalize("NFKC", texts[i]).lower()
        cps, bounds = code_points(texts)
    cps = fold[cps]
    return runs(cps, bounds, kind[cps])


class Passages:
    """A block of held-out passages: word hashes and n-grams with their places."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int):
        batch = fold_words(texts)
        self.ids, self.n = ids, n
        self.words = [batch.hashes[batch.offsets[i] : batch.offsets[i + 1]] for i in range(len(ids))]
        grams, bounds = shingle_hashes(batch, n)
        self.grams = grams
        self.item = np.repeat(np.arange(len(ids)), np.diff(bounds))
        self.place = np.arange(len(grams)) - bounds[:-1][self.item] if len(grams) else np.zeros(0, np.int64)
        self.bounds = bounds

    def seeds(self, counts: np.ndarray, min_words: int) -> np.ndarray:
        """Indices of the rarest n-gram of every window (later ones on ties)."""
        window = max(1, min_words - self.n + 1)
        chosen = []
        for a, b in zip(self.bounds[:-1], self.bounds[1:]):
            c = counts[a:b]
            if b - a < window:
                if b > a:
                    chosen.append(np.array([a + int(np.argmin(c))]))
                continue
            view = np.lib.stride_tricks.sliding_window_view(c, window)
            chosen.append(np.unique(np.arange(len(view)) + view.argmin(axis=1)) + a)
        return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


class _Lookup:
    """Sorted hashes behind a bit table, to find a few among many."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query place, index among the given hashes) of every equal pair."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        lo = np.searchsorted(self.sorted, hashes[at], "left")
        hi = np.searchsorted(self.sorted, hashes[at], "right")
        many = hi - lo
        return np.repeat(at, many), self.order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]


def longest_run(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, int]:
    """Length and start in ``a`` of the longest run with a[i + shift] == b[i]."""
    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
    if hi <= lo:
        return 0, 0
    same = np.concatenate([[False], a[lo + shift : hi + shift] == b[lo:hi], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1])
    if not len(edges):
        return 0, 0
    lengths = edges[1::2] - edges[::2]
    k = int(np.argmax(lengths))
    return int(lengths[k]), int(edges[::2][k] + lo + shift)


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[int, int]:
    """Best local alignment of two word sequences: (score, words of ``b`` spanned).
    Rows are whole-array steps; gaps along a row are a running maximum."""
    steps = gap * np.arange(len(a) + 1)
    row = np.zeros(len(a) + 1, np.int64)
    start = np.zeros(len(a) + 1, np.int64)
    best, span = 0, 0
    for i in range(len(b)):
        diagonal = np.concatenate([[0], row[:-1] + np.where(a == b[i], match, mismatch)])
        began = np.concatenate([[i], np.where(row[:-1] > 0, start[:-1], i)])
        up = row - gap
        new = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(new == 0, i + 1, np.where(new == diagonal, began, start))
        lifted = np.maximum.accumulate(new + steps)
        filled = lifted - steps
        if (filled > new).any():
            source = np.maximum.accumulate(np.where(new + steps == lifted, np.arange(len(new)), 0))
            origin = origin[source]
        row, start = filled, origin
        k = int(row.argmax())
        if row[k] > best:
            best, span = int(row[k]), i + 1 - int(start[k])
    return best, span


def surroundings(shifts: list[int], passage: int, text: int) -> list[tuple[int, int]]:
    """Parts of a text that a passage may be aligned to, given the shifts of its seeds: one
    part for shifts that lie closer together than the passage is long."""
    parts: list[tuple[int, int]] = []
    last = None
    for shift in sorted(shifts):
        lo, hi = max(0, shift - 32), min(text, shift + passage + 32)
        parts = [*parts[:-1], (parts[-1][0], hi)] if last is not None and shift - last <= passage else [*parts, (lo, hi)]
        last = shift
    return parts


def _fold_counts(passages, n: int, bits: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = passages.value.grams
        look = _Lookup(np.unique(grams))
        given = look.sorted[np.argsort(look.order)] & np.uint64((1 << bits) - 1)
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), _CHUNK):
                hashes, _ = shingle_hashes(fold_words(texts[a : a + _CHUNK]), n)
                _, which = look.places(hashes)
                np.add.at(counts, given[which].astype(np.int64), 1)
        yield pieces(counts)

    return fold


def _find(passages, seeds, key: str, min_run: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Passages = passages.value
        chosen = seeds.value
        look = _Lookup(p.grams[chosen])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[tuple] = []
            for a in range(0, len(texts), _CHUNK):
                words = fold_words(texts[a : a + _CHUNK])
                hashes, bounds = shingle_hashes(words, p.n)
                at, which = look.places(hashes)
                doc = np.searchsorted(bounds, at, "right") - 1
                gram = chosen[which]
                met: dict[tuple[int, int], set[tuple[int, int]]] = {}
                for d, i, x, y in zip(doc.tolist(), p.item[gram].tolist(), (at - bounds[doc]).tolist(), p.place[gram].tolist()):
                    met.setdefault((d, i), set()).add((x - y, y))
                for (d, i), hits in sorted(met.items()):
                    text, passage = words.hashes[words.offsets[d] : words.offsets[d + 1]], p.words[i]
                    run, start = max(longest_run(text, passage, shift) for shift in {s for s, _ in hits})
                    if run < min_run:
                        continue
                    if run == len(passage):
                        score, span = 2 * run, run
                    else:
                        score, span = max(smith_waterman(text[lo:hi], passage) for lo, hi in surroundings([s for s, _ in hits], len(passage), len(text)))
                    rows.append((a + d, p.ids[i], run, start, span, score, len(passage)))
            if rows:
                own, *rest = zip(*rows)
                names = [x.split()[0] for x in LEAKS.split(", ")]
                kinds = [pa.int64(), *[pa.int32()] * 5]
                yield pa.RecordBatch.from_pydict({key: batch.column(0).take(pa.array(own)), **{c: pa.array(v, t) for c, v, t in zip(names, rest, kinds)}})

    return find


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = 50, n: int = NGRAM, key: str = "doc_id", min_run: int | None = None, block_items: int = 5000) -> DataFrame:
    """(key, item_id, longest_run, run_start, aligned_words, score, passage_words) of
    every document and passage that share a seed and ``min_run`` consecutive words
    (default: n).  Every shared run of at least ``min_words`` words is found.  Edited copies
    are found as far as one seed survived; their ``score`` (2 a common word, 1 off for each
    word more, less or other) says how much of the passage they hold.  Null keys, texts and passages take
    part in nothing; a document or item given twice counts twice.
    """
    spark = documents.sparkSession
    corpus = documents.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text")
    rows = items.where(F.col("item_id").isNotNull() & F.col("passage").isNotNull()).select("item_id", "passage").orderBy("item_id")
    kind = documents.schema[key].dataType.simpleString()
    out = None
    block: list = []

    def of_block(got: list) -> DataFrame:
        passages = Passages([r["item_id"] for r in got], [r["passage"] for r in got], n)
        sent = spark.sparkContext.broadcast(passages)
        bits = 20
        counts = collect_counts(corpus.select("text"), _fold_counts(sent, n, bits), bits)
        seeds = passages.seeds(counts[(passages.grams & np.uint64((1 << bits) - 1)).astype(np.int64)].astype(np.int64), min_words)
        return corpus.mapInArrow(_find(sent, spark.sparkContext.broadcast(seeds), key, n if min_run is None else min_run), f"`{key}` {kind}, {LEAKS}")

    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == block_items:
            part = of_block(block)
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = of_block(block)
        out = part if out is None else out.unionByName(part)
    return out
