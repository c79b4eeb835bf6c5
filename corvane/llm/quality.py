"""Per-document text statistics and a learned rule list for the shape of a text.

Statistics come from whole batches of texts at once, on code point arrays.  An
ordered rule list is induced by incremental reduced-error pruning on labelled
documents and exported as a SQL CASE expression, so applying it is native.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import CJK, SPACE, WORD, code_points, mix64, runs

# Spellings of the languages of common_words.
LANGUAGE_SPELLINGS = {
    "zh": ("zh", "zho", "chi", "cn", "chinese", "中文"),
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
}
MARKER = re.compile(r"\s*(?:[-*+•·▪◦‣–—●○■□]\s|[-*+]?\s?\[[ xX]?\]|[（(\[]?(?:[0-9]{1,3}|[一二三四五六七八九十]{1,3}|[a-zA-Z])[)）\].、．])")
ROW = re.compile(r"\t|\|.*\||</?t[rdh]\b|\S {2,}\S.* {2,}\S|^[^,;]*(?:[,;][^,;]*){3,}$|^[^、，]*(?:、[^、，]*){3,}$")
PAIR = re.compile(r"\s*[^：:。，,]{1,40}[：:]\s*[^：:。，,]{1,40}$")
#: A sentence has so many visible characters, at least so much width for each line it
#: spans, a Han character counting 2.5, and a common word in so many characters.
SENTENCE_CHARS, LINE_WIDTH, COMMON_EVERY = (8, 600), 28, 60

FEATURES = [
    "mean_word_length", "symbol_ratio", "digit_ratio", "ended_lines", "marked_lines", "row_lines", "pair_lines", "mean_line_length",
    "words_per_sentence", "sentence_share", "common_share", "long_run_share", "comma_ratio", "space_ratio", "capital_ratio",
]
ENDS = frozenset("。！？.!?…")
_SPACE, _HAN, _LATIN, _DIGIT, _PLAIN, _STRANGE = range(6)
_STATISTICS = "chars int, words int, lines int, language string, " + ", ".join(f"{f} double" for f in FEATURES)
_TABLES: list[np.ndarray] = []
_CHUNK = 400


def language_code(lang: Column) -> Column:
    """Canonical language code, null for an unknown spelling."""
    low = F.regexp_extract(F.lower(F.trim(lang)), r"^([^-_]*)", 1)
    out = F.lit(None).cast("string")
    for code, spellings in LANGUAGE_SPELLINGS.items():
        out = F.when(low.isin(*spellings), F.lit(code)).otherwise(out)
    return out


def common_word_lists(common_words: DataFrame, most: int = 10_000) -> dict[str, list[str]]:
    """Words per language; the table is a fixed word list of at most ``most`` rows."""
    rows = common_words.where(F.col("lang").isNotNull() & (F.length("word") > 0)).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("common_words is no word list")
    words: dict[str, list[str]] = {}
    for r in rows:
        words.setdefault(r["lang"], []).append(r["word"].lower())
    return {lang: sorted(ws) for lang, ws in sorted(words.items())}


def _tables() -> list[np.ndarray]:
    """Per code point: its class, whether it ends a sentence, is a comma, is upper case."""
    if not _TABLES:
        kind = np.full(0x110000, _STRANGE, np.uint8)
        points = np.arange(0x32400)
        chars = [chr(c) for c in points]
        category = [ud.category(c) for c in chars]
        kind[points] = [_PLAIN if c[0] in "LMN" else _STRANGE for c in category]
        kind[[i for i, c in enumerate(category) if c[0] == "Z"]] = _SPACE
        kind[9:14] = _SPACE
        kind[0x3400:0xA000] = _HAN
        for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x250), (0x300, 0x370)):
            kind[lo:hi] = _LATIN
        kind[0x30:0x3A] = _DIGIT
        kind[[ord(c) for c in ".,;:!?'\"()-。，；：！？、（）“”‘’《》%/°℃·…—–±"]] = _PLAIN
        flag = lambda text: np.isin(np.arange(0x110000), [ord(c) for c in text])
        upper = np.zeros(0x110000, bool)
        upper[[i for i, c in enumerate(category) if c == "Lu"]] = True
        _TABLES.extend([kind, flag("。！？!?"), flag("，,、；;"), upper])
    return _TABLES


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def statistics_of(texts: list[str], words: dict[str, list[str]]) -> dict[str, np.ndarray | list]:
    """The statistics of some texts, as columns."""
    if not any(texts):
        texts_empty = np.zeros(len(texts))
        return {k: texts_empty.astype(np.int64) for k in ("chars", "words", "lines")} | {"language": [None] * len(texts)} | {f: texts_empty for f in FEATURES}
    kind_of, ends_of, comma_of, upper_of = _tables()
    cps, bounds = code_points(texts)
    kind = kind_of[cps]
    newline, space = cps == 10, kind == _SPACE
    n_docs = len(texts)
    # words: runs of Latin letters, and single Han characters
    low, low_bounds = code_points([t.lower() for t in texts])
    token = runs(low, low_bounds, np.array([SPACE, CJK, WORD, SPACE, SPACE, SPACE], np.uint8)[kind_of[low]])
    latin = token.kinds == WORD
    n_latin, n_han = _sums(latin, token.offsets), _sums(~latin, token.offsets)
    hits = np.zeros((len(words), len(token.hashes)), bool)
    pair = np.zeros(len(token.hashes), np.uint64)
    next_to = np.zeros(len(token.hashes), bool)
    if len(token.hashes) > 1:
        next_to[:-1] = (token.starts[1:] == token.ends[:-1]) & ~latin[1:] & ~latin[:-1]
        next_to[token.offsets[1:-1][token.offsets[1:-1] > 0] - 1] = False
        pair[:-1] = mix64(token.hashes[:-1] * np.uint64(3) + token.hashes[1:])
    for i, (lang, list_) in enumerate(words.items()):
        one = tokenize_words([w for w in list_ if lang != "zh" or len(w) == 1])
        hits[i] = np.isin(token.hashes, one)
        if lang == "zh":
            two = [tokenize_words(list(w)) for w in list_ if len(w) == 2]
            keys = np.array([mix64(h[:1] * np.uint64(3) + h[1:2])[0] for h in two if len(h) == 2], np.uint64)
            hits[i] = hits[i] & ~latin | next_to & np.isin(pair, keys)
        else:
            hits[i] &= latin
    counts = np.stack([_sums(h, token.offsets) for h in hits]) if len(words) else np.zeros((1, n_docs), np.int64)
    best = counts.argmax(axis=0)
    n_common = counts[best, np.arange(n_docs)]
    names = [*words] or [None]
    any_hit = hits.any(axis=0) if len(words) else np.zeros(len(token.hashes), bool)
    n_lines, c_lines = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    ended, marked, rows, pairs = (np.zeros(n_docs) for _ in range(4))
    cuts: list[int] = []
    for i, text in enumerate(texts):
        start = int(bounds[i])
        for x in text.split("\n"):
            size = len(x)
            if x and not x.isspace():
                n_lines[i] += 1
                c_lines[i] += size
                mark = MARKER.match(x) is not None
                if mark and start:
                    cuts.append(start - 1)
                if x.rstrip(" \t\r\"'”’」』）)]")[-1:] in ENDS:
                    ended[i] += size
                else:
                    row = ROW.search(x) is not None
                    pair = not row and size <= 84 and PAIR.match(x) is not None
                    marked[i] += size * mark
                    rows[i] += size * row
                    pairs[i] += size * pair
                    if row or pair:
                        cuts += [max(start - 1, 0), min(start + size, len(cps) - 1)]
            start += size + 1
    # sentences end at a terminal, a period only before white space or the end
    after_space = np.ones(len(cps), bool)
    after_space[:-1] = space[1:] | np.isin(cps[1:], [0x22, 0x27, 0x29, 0x201D, 0x2019])
    after_space[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    after_digit = np.zeros(len(cps), bool)
    after_digit[1:] = kind[:-1] == _DIGIT
    at_end = np.ones(len(cps), bool)
    at_end[:-1] = newline[1:]
    stop = ends_of[cps] | (cps == 46) & after_space & (~after_digit | at_end)
    n_stop = _sums(stop, bounds)
    blank_line = np.zeros(len(cps), bool)
    blank_line[1:] = newline[1:] & newline[:-1]
    broken = stop | blank_line | (cps == 9) | (cps == 124)
    broken[cuts] = True
    broken[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    last = np.flatnonzero(broken)
    seg = np.concatenate([[0], last + 1]).astype(np.int64)
    visible = _sums(~space, seg)
    inner = _sums(newline, seg)
    # lower-casing may lengthen a text by a few characters; then the place is near enough
    owner_of = np.repeat(np.arange(n_docs), np.diff(token.offsets))[any_hit]
    place = np.minimum(token.starts[any_hit] + bounds[owner_of], np.maximum(bounds[owner_of + 1] - 1, 0))
    common_in = _sums(np.bincount(place, minlength=len(cps)), seg)
    strange_in = _sums(kind == _STRANGE, seg)
    width = visible + 1.5 * _sums(kind == _HAN, seg)
    good = stop[last] & (visible >= SENTENCE_CHARS[0]) & (visible <= SENTENCE_CHARS[1]) & (width >= LINE_WIDTH * inner) & (common_in * COMMON_EVERY >= visible) & (strange_in * 12 <= visible)
    owner = np.searchsorted(bounds, last, "right") - 1
    c_sentence = np.bincount(owner[good], visible[good], n_docs) if len(last) else np.zeros(n_docs)
    c_visible = _sums(~space, bounds)
    c_long = np.zeros(n_docs, np.int64)
    gaps = np.flatnonzero(np.concatenate([[True], space | (kind == _HAN), [True]]))
    length = np.diff(gaps) - 1
    far = np.flatnonzero(length >= 28)
    if len(far):
        np.add.at(c_long, np.searchsorted(bounds, gaps[far], "right") - 1, length[far])
    c_latin = _sums(kind == _LATIN, bounds)
    n_words = n_latin + n_han
    chars = np.diff(bounds)
    return {
        "chars": chars, "words": n_words, "lines": n_lines, "language": [names[b] if n else None for b, n in zip(best, n_common)],
        "mean_word_length": _share(c_latin + n_han, n_words), "symbol_ratio": _share(_sums(kind == _STRANGE, bounds), chars), "digit_ratio": _share(_sums(kind == _DIGIT, bounds), chars),
        "ended_lines": _share(ended, c_lines), "marked_lines": _share(marked, c_lines), "row_lines": _share(rows, c_lines), "pair_lines": _share(pairs, c_lines),
        "mean_line_length": _share(c_lines, n_lines), "words_per_sentence": n_words / np.maximum(n_stop, 1), "sentence_share": _share(c_sentence, c_visible),
        "common_share": _share(n_common, n_words), "long_run_share": _share(c_long, chars), "comma_ratio": _share(_sums(comma_of[cps], bounds), chars),
        "space_ratio": _share(_sums(space, bounds), chars), "capital_ratio": _share(_sums(upper_of[cps], bounds), chars),
    }


def tokenize_words(words: list[str]) -> np.ndarray:
    """Hashes of single words as :func:`statistics_of` sees them."""
    cps, bounds = code_points(words)
    kinds = np.array([SPACE, CJK, WORD, SPACE, SPACE, SPACE], np.uint8)[_tables()[0][cps]]
    return runs(cps, bounds, kinds).hashes


def text_statistics(documents: DataFrame, key: str, words: dict[str, list[str]]) -> DataFrame:
    """One row of statistics per document: ``key``, chars, words, lines, language and
    the ratios of ``FEATURES``.  A null or blank text has zeros throughout.
    ``common_share`` is the share of common words of the text's best language, which
    ``language`` names when any common word occurs, else the stated language."""
    kind = documents.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(a, _CHUNK)
                got = statistics_of([t or "" for t in part.column(2).to_pylist()], words)
                said = part.column(1).to_pylist()
                got["language"] = [x or y for x, y in zip(got["language"], said)]
                ints = {k: pa.array(np.asarray(got[k]), pa.int32()) for k in ("chars", "words", "lines")}
                yield pa.RecordBatch.from_pydict({key: part.column(0), **ints, "language": pa.array(got["language"], pa.string()), **{f: pa.array(np.asarray(got[f], float), pa.float64()) for f in FEATURES}})

    return documents.select(F.col(key), language_code(F.col("lang")).alias("lang"), "text").mapInArrow(measure, f"`{key}` {kind}, {_STATISTICS}")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold) tests that decides for ``shape``."""

    shape: str
    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, above, value in self.tests:
            column = x[:, names.index(name)]
            hit &= column > value if above else column <= value
        return hit


def _gain_best(x: np.ndarray, pos: np.ndarray, live: np.ndarray) -> tuple[float, int, bool, float] | None:
    """The test with the highest information gain on the covered rows."""
    p0, n0 = int((live & pos).sum()), int((live & ~pos).sum())
    if not p0 or not n0:
        return None
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, int, bool, float] | None = None
    for j in range(x.shape[1]):
        v, y = x[live, j], pos[live]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        below_p = np.cumsum(y)[cut]
        below_n = cut + 1 - below_p
        for above in (False, True):
            p = p0 - below_p if above else below_p
            n = n0 - below_n if above else below_n
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-12):
                best = (float(gain[k]), j, above, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return best


def induce_rules(x: np.ndarray, shapes: np.ndarray, names: list[str], default: str, seed: int = 7, rounds: int = 40) -> list[Rule]:
    """Ordered rules for every shape but ``default``, most frequent shape first.

    Each rule is grown on two thirds of the rows left, its last tests are dropped
    while that does not lower (p - n) / (p + n) on the other third, and the shape is
    done when the best rule no longer decides more right than wrong there.
    """
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    kinds, sizes = np.unique(shapes, return_counts=True)
    for shape in [k for _, k in sorted(zip((-sizes).tolist(), kinds.tolist())) if k != default]:
        for _ in range(rounds):
            pos = shapes == shape
            if (left & pos).sum() < 3:
                break
            grow = left & (rng.random(len(x)) < 2 / 3)
            hold = left & ~grow
            tests: list[tuple[str, bool, float]] = []
            live = grow.copy()
            while len(tests) < 6 and (got := _gain_best(x, pos, live)):
                _, j, above, value = got
                tests.append((names[j], above, value))
                live &= x[:, j] > value if above else x[:, j] <= value
                if not (live & ~pos).any():
                    break
            if not tests:
                break

            def worth(k: int) -> tuple[float, int, int]:
                hit = hold & Rule(shape, tuple(tests[:k])).covers(x, names)
                p, n = int((hit & pos).sum()), int((hit & ~pos).sum())
                return ((p - n) / (p + n) if p + n else -1.0), p, n

            best = max(range(1, len(tests) + 1), key=lambda k: (worth(k)[0], -k))
            value, p, n = worth(best)
            if p <= n:
                break
            rule = Rule(shape, tuple(tests[:best]))
            rules.append(rule)
            left &= ~rule.covers(x, names)
    return rules


def apply_rules(rules: list[Rule], default: str) -> Column:
    """The rule list as one CASE expression."""
    return F.expr(rules_sql(rules, default))


def rules_sql(rules: list[Rule], default: str) -> str:
    if not rules:
        return f"'{default}'"
    cases = " ".join("WHEN " + " AND ".join(f"{n} {'>' if above else '<='} {v!r}D" for n, above, v in r.tests) + f" THEN '{r.shape}'" for r in rules)
    return f"CASE {cases} ELSE '{default}' END"


def chosen_labels(labels: DataFrame, key: str, most: int) -> DataFrame:
    """(key, shape) of at most ``most`` labelled documents, those of the least key
    hashes.  A document labelled more than once counts with its latest label."""
    once = labels.where(F.col(key).isNotNull() & F.col("shape").isNotNull()).groupBy(key).agg(F.max_by("shape", F.struct("labelled_at", "shape")).alias("shape"))
    return once.orderBy(F.xxhash64(key), key).limit(most)


def classify_shapes(documents: DataFrame, labels: DataFrame, common_words: DataFrame, key: str = "doc_id", default: str = "junk", most_labels: int = 20_000) -> DataFrame:
    """Statistics of every document plus its ``shape``, decided by rules learned from
    at most ``most_labels`` labelled documents.  What no rule describes is ``default``;
    without labels that is every document."""
    words = common_word_lists(common_words)
    chosen = chosen_labels(labels, key, most_labels)
    known = documents.join(F.broadcast(chosen.select(key)), key, "left_semi")
    rows = text_statistics(known, key, words).join(F.broadcast(chosen), key).orderBy(key).select("shape", *FEATURES).toPandas()
    rules = induce_rules(rows[FEATURES].to_numpy(float), rows["shape"].to_numpy(str), FEATURES, default)
    return text_statistics(documents, key, words).withColumn("shape", apply_rules(rules, default))
