"""Vectorised token arrays over whole batches of texts.

A token is one CJK character (U+3400-U+9FFF), one run of ``[A-Za-z0-9_]`` or one
other character that is not white space.  A batch of texts becomes one code point
array; token starts, token hashes and shingle hashes are computed with NumPy, so
the per-token cost is a few nanoseconds and no Python object is made per token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE, CJK, WORD, OTHER = 0, 1, 2, 3
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = None


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    table[0x3400:0xA000] = CJK
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x5F, 0x60)):
        table[lo:hi] = WORD
    blanks = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[blanks] = SPACE
    return table


_TABLE: np.ndarray | None = None


def class_table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _classes()
    return _TABLE


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if _POWERS is None or len(_POWERS) < n:
        size = max(64, 1 << (n - 1).bit_length()) if n else 64
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _P)]).astype(np.uint64))
    return _POWERS


@dataclass
class TokenBatch:
    """Tokens of a batch: ``hashes`` and code point spans; document ``i`` owns
    tokens ``offsets[i]:offsets[i + 1]``; ``starts``/``ends`` count code points
    inside the document's own text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    kinds: np.ndarray


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one code point array and the bounds of each text in it."""
    parts = [t or "" for t in texts]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=bounds[1:])
    cps = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return cps, bounds


def tokenize(texts: list[str | None], drop_other: bool = False) -> TokenBatch:
    """Tokens of every text.  ``drop_other`` leaves out the tokens that are
    neither CJK characters nor word runs.  A null text has no tokens."""
    cps, bounds = code_points(texts)
    kinds = class_table()[cps]
    if drop_other:
        kinds = np.where(kinds == OTHER, SPACE, kinds)
    return runs(cps, bounds, kinds)


def runs(cps: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> TokenBatch:
    """Tokens of classed code points: each run of WORD, each other non-SPACE."""
    n = len(cps)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return TokenBatch(np.zeros(0, np.uint64), empty, empty, np.zeros(len(bounds), np.int64), np.zeros(0, np.uint8))
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    is_word = kinds == WORD
    joined = np.zeros(n, bool)
    joined[1:] = is_word[1:] & is_word[:-1]
    joined &= ~first
    begins = np.flatnonzero((kinds != SPACE) & ~joined)
    # a token ends where the next character does not continue its word run
    run_id = np.cumsum(~joined)
    last_of_run = np.zeros(run_id[-1] + 1, np.int64)
    last_of_run[run_id] = np.arange(n) + 1
    ends = last_of_run[run_id[begins]]
    within = np.arange(n) - np.maximum.accumulate(np.where(joined, 0, np.arange(n)))
    weights = _powers(int(within.max()) + 1)[within]
    terms = cps.astype(np.uint64) * weights
    all_starts = np.flatnonzero(~joined)
    sums = np.add.reduceat(terms, all_starts) if len(all_starts) else np.zeros(0, np.uint64)
    hashes = mix64(sums[run_id[begins] - 1] + (ends - begins).astype(np.uint64) * _Q)
    offsets = np.searchsorted(begins, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(offsets))
    base = bounds[owner]
    return TokenBatch(hashes, begins - base, ends - base, offsets.astype(np.int64), kinds[begins])


def shingle_hashes(batch: TokenBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` consecutive tokens, and the bounds of each
    document's runs.  A document of fewer tokens has none."""
    h = batch.hashes
    counts = np.maximum(np.diff(batch.offsets) - width + 1, 0)
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    if len(h) < width:
        return np.zeros(0, np.uint64), bounds
    acc = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        acc = acc * _Q + h[j : len(h) - width + 1 + j]
    acc = mix64(acc)
    keep = np.repeat(batch.offsets[:-1], counts) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], counts))
    return acc[keep], bounds


def token_counts(texts: list[str | None]) -> np.ndarray:
    """Number of tokens per text."""
    return np.diff(tokenize(texts).offsets)
