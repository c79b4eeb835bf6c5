"""The two sides of the noisy channel for scanned pages, both learned from the data.

Language: a fixed-size count sketch of the clean text, with character n-grams around
Han characters, words, word pairs and word beginnings, and of the forms under which
page lines stand at the edge or inside of pages.

Channel: how often a character (Han) or a segment of one or two letters (Latin) was
read as another, by the confidence of the page.  Han: where no n-gram through a
character occurs in clean text, the character that fits its neighbours is taken for
the true one.  Latin: page words that clean text lacks are joined with clean words
over all ways to leave out one segment.  Both are pre-aggregated and summed over all
pages; a pair with too small a share of all misreads is chance and is left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import materialize
from corvane.llm.sketches import collect_counts, pieces
from corvane.llm.tokens import code_points, mix64

SKETCH_BITS = 23
BANDS = 50
#: Least share of a pair in all estimated misreads of its script.
LEAST_SHARE = 1 / 1000
#: Different words that must show a pair of Latin segments.
LEAST_WORDS = 2
#: Letters that a pair of words must agree in beside the segment that differs.
LEAST_SHARED = 3
HAN = re.compile("[㐀-鿿]")
LETTERS = re.compile(r"[A-Za-zÀ-ɏ]+(?:-[A-Za-zÀ-ɏ]+)*")
CODE = re.compile(r"[A-Z]{1,3}-?[0-9lO]+(?:[-/][0-9lO]+)?[A-Z]?(?![a-z])")
#: Places of the totals in the sketch.
ALL_WORDS, ALL_HAN = "#words", "#han"
_CONTEXT = {**{ord(c): "0" for c in "0123456789"}, **{c: "A" for c in range(65, 91)}}


def mapped(text: str) -> str:
    """Context characters: all digits are one, all capitals are one."""
    return text.translate(_CONTEXT)


def _mix(x: int) -> int:
    """:func:`mix64` of one word."""
    m = 0xFFFFFFFFFFFFFFFF
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def word_key(kind: str, word: str) -> int:
    h = 0xCBF29CE484222325
    for byte in f"{kind}\0{word}".encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return _mix(h)


def line_forms(line: str) -> list[str]:
    """Forms under which a margin line recurs: the whole line without its numbers and
    codes, its last characters or word, its first word."""
    text = re.sub(r"Rev\.\s*[A-Z](?=\s|$)", "Rev. R", CODE.sub("C", line.strip()))
    text = re.sub(r"[0-9lIO]*[0-9]+[0-9lIO]*", "#", text)
    text = re.sub(r"[一二三四五六七八九十百]+(?=[章节編编])", "N", text).replace("笫", "第")
    text = re.sub(r"^#\s+|\s+#$", "", re.sub(r"\s{2,}", "  ", text))
    forms = ["w" + text]
    if HAN.search(text[-4:]):
        if len(text) >= 5:
            forms.append("e" + text[-5:])
    elif " " in text:
        forms.append("e" + text.rsplit(" ", 1)[1])
    head = re.match(r"[A-Za-zÀ-ɏ]{4,}|第N[章节]|C Rev\. R$", text)
    if head:
        forms.append("s" + head.group())
    return forms


def _clean_words(texts: list[str], words: Counter[str]) -> None:
    """Words ("x"), parts of compounds ("h") and pairs of neighbours ("y")."""
    for text in texts:
        got = [w.lower() for w in LETTERS.findall(text)]
        words.update("x" + w for w in got)
        words.update("h" + p for w in got if "-" in w for p in w.split("-"))
        words.update(f"y{a} {b}" for a, b in zip(got, got[1:]))
        words["x" + ALL_WORDS] += len(got)


def _fold(bits: int):
    half = np.uint64((1 << (bits - 1)) - 1)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        known: dict[str, int] = {}

        def add(keys: np.ndarray, times: np.ndarray) -> None:
            np.add.at(counts, (keys & half).astype(np.int64), times.astype(np.uint32))
            np.add.at(counts, (keys >> np.uint64(32) & half).astype(np.int64) + (1 << (bits - 1)), times.astype(np.uint32))

        def key(w: str) -> int:
            got = known.get(w)
            if got is None:
                got = word_key(w[0], w[1:])
                if len(known) < 1_000_000:
                    known[w] = got
            return got

        for batch in batches:
            words: Counter[str] = Counter()
            clean: list[str] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not page:
                    clean.append(text)
                    continue
                lines = [x for x in text.split("\n") if x.strip()]
                for i, line in enumerate(lines):
                    place = "t" if i == 0 else "b" if i >= len(lines) - 2 else "m"
                    words.update(place + f for f in line_forms(line))
            if clean:
                _clean_words(clean, words)
                for w, times in [(w, n) for w, n in words.items() if w[0] == "x"]:
                    # beginnings, so that candidate words are searched like in a trie
                    for i in range(2, len(w) + 1):
                        words["p" + w[1:i]] += times
                keys = []
                for a in range(0, len(clean), 4000):
                    cps = code_points([mapped("\n".join(["", *clean[a : a + 4000], ""]))])[0].astype(np.uint64)
                    han = (cps >= 0x3400) & (cps < 0xA000)
                    words["x" + ALL_HAN] += int(han.sum())
                    one = cps[han]
                    two = (cps[:-1] << np.uint64(21) | cps[1:])[han[:-1] | han[1:]]
                    three = (cps[:-2] << np.uint64(42) | cps[1:-1] << np.uint64(21) | cps[2:])[han[:-2] | han[1:-1] | han[2:]]
                    keys.append(mix64(np.concatenate([one, two, three])))
                add(*np.unique(np.concatenate(keys), return_counts=True))
            if words:
                add(np.array([key(w) for w in words], np.uint64), np.array([*words.values()]))
        yield pieces(counts)

    return fold


def language_model(clean: DataFrame, pages: DataFrame) -> np.ndarray:
    """Sketch of clean texts (text) and of page texts (text), on a log scale of one
    byte per counter (eighth octaves, 0 for none)."""
    rows = clean.where("text is not null").select(F.lit(False).alias("page"), "text").unionByName(pages.where("text is not null").select(F.lit(True).alias("page"), "text"))
    counts = collect_counts(rows, _fold(SKETCH_BITS), SKETCH_BITS)
    return np.where(counts > 0, np.minimum(255, 1 + np.round(8 * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8)


class Language:
    """Looks counts up in the sketch of one task; remembers what it looked up."""

    def __init__(self, sketch: np.ndarray):
        self.bits = sketch
        self.half = (len(sketch) >> 1) - 1
        self.values = np.array([0.0, *(2 ** ((q - 1) / 8) for q in range(1, 256))])
        self.value = self.values.tolist()
        self.grams: dict[str, float] = {}
        self.words: dict[str, float] = {}
        self.all_words = max(1.0, self.word("x", ALL_WORDS))
        self.all_han = max(1.0, self.word("x", ALL_HAN))

    def _count(self, key: int) -> float:
        return self.value[min(self.bits[key & self.half], self.bits[(key >> 32 & self.half) + self.half + 1])]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams given as packed code points."""
        k, half = mix64(keys), np.uint64(self.half)
        return self.values[np.minimum(self.bits[(k & half).astype(np.int64)], self.bits[(k >> np.uint64(32) & half).astype(np.int64) + self.half + 1])]

    def gram(self, s: str) -> float:
        got = self.grams.get(s)
        if got is None:
            x = 0
            for c in s:
                x = x << 21 | ord(c)
            got = self.grams[s] = self._count(_mix(x))
        return got

    def word(self, kind: str, w: str) -> float:
        got = self.words.get(kind + w)
        if got is None:
            got = self.words[kind + w] = self._count(word_key(kind, w))
        return got

    def step(self, state: str, c: str) -> float:
        """log P(c | the two characters before): interpolated n-grams around Han characters."""
        if not (HAN.match(c) or HAN.match(state[1]) or HAN.match(state[0])):
            return 0.0
        n3, n2 = self.gram(state + c), self.gram(state[1] + c) if HAN.match(c) or HAN.match(state[1]) else 0.0
        h2 = self.gram(state) if HAN.match(state[0]) or HAN.match(state[1]) else 0.0
        h1 = self.gram(state[1]) if HAN.match(state[1]) else 0.0
        return log(0.9 * n3 / max(h2, n3, 20.0) + 0.09 * n2 / max(h1, n2, 200.0) + 1e-9 * min(self.gram(c) if HAN.match(c) else 50.0, 1000.0) + 1e-9)

    def steps(self, cps: np.ndarray) -> np.ndarray:
        """:meth:`step` of every character of a text of mapped code points, as if two line
        feeds stood before it."""
        x = np.concatenate([[10, 10], cps]).astype(np.uint64)
        han = (x >= 0x3400) & (x < 0xA000)
        a, b, c = x[:-2], x[1:-1], x[2:]
        ha, hb, hc = han[:-2], han[1:-1], han[2:]
        s = np.uint64(21)
        n3 = self.counts(a << s + s | b << s | c)
        n2 = np.where(hb | hc, self.counts(b << s | c), 0.0)
        h2 = np.where(ha | hb, self.counts(a << s | b), 0.0)
        h1 = np.where(hb, self.counts(b), 0.0)
        own = np.where(hc, np.minimum(self.counts(c), 1000.0), 50.0)
        p = 0.9 * n3 / np.maximum(np.maximum(h2, n3), 20.0) + 0.09 * n2 / np.maximum(np.maximum(h1, n2), 200.0) + 1e-9 * own + 1e-9
        return np.where(ha | hb | hc, np.log(p), 0.0)

    def word_score(self, before: str, w: str) -> float:
        """log P(word | the word before, if any); unknown words share what is left evenly
        over all strings of their length."""
        low = w.lower()
        n = max(self.word("x", low), self.word("h", low))
        p = 0.4 * n / self.all_words
        if before and n:
            both = self.word("y", f"{before} {low}")
            p += 0.6 * both / max(self.word("x", before), both, 20.0)
        return log(p + 1e-4 * 20.0 ** -min(len(w), 200))


def band(confidence: float | None) -> int:
    """Confidence band; unknown confidence has its own."""
    return -1 if confidence is None or confidence != confidence else int(min(max(confidence, 0.0), 1.0) * BANDS)


def _han_evidence(sketch):
    """Rows (script, meant, read, band, n): characters that fit no neighbour and the one that
    fits them all; and the number of Han characters (meant and read null)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = Language(sketch.value)
        alphabet = np.arange(0x3400, 0xA000, dtype=np.uint64)
        alphabet = alphabet[lm.counts(alphabet) > 0]
        pairs: Counter[tuple[str | None, str | None, int]] = Counter()
        s = np.uint64(21)
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            # pages of a batch form one array; two line feeds keep them apart
            cps, bounds = code_points([mapped("\n\n" + (t or "").replace("\n", "") + "\n\n") for t in texts])
            cps = cps.astype(np.uint64)
            if len(cps) < 5 or not len(alphabet):
                continue
            han = (cps >= 0x3400) & (cps < 0xA000)
            near = han.copy()
            near[1:] |= han[:-1]
            near[:-1] |= han[1:]
            three = np.zeros(len(cps), bool)
            inner = np.flatnonzero(near[1:-1]) + 1
            three[inner] = lm.counts(cps[inner - 1] << s + s | cps[inner] << s | cps[inner + 1]) > 0
            owner = np.searchsorted(bounds, np.arange(len(cps)), "right") - 1
            bands = np.array([band(c) for c in at])
            for b in np.unique(bands):
                pairs[None, None, int(b)] += int((han & (bands[owner] == b)).sum())
            odd = np.flatnonzero(han[2:-2] & ~three[1:-3] & ~three[2:-2] & ~three[3:-1]) + 2
            for p in odd.tolist():
                l2, l1, r1, r2 = (cps[p + d] for d in (-2, -1, 1, 2))
                fit = np.minimum(np.minimum(lm.counts(l2 << s + s | l1 << s | alphabet), lm.counts(l1 << s + s | alphabet << s | r1)), lm.counts(alphabet << s + s | r1 << s | r2))
                k = int(fit.argmax())
                if fit[k] >= 2 and fit[k] >= 4 * np.partition(fit, -2)[-2] if len(fit) > 1 else fit[k] >= 2:
                    pairs[chr(int(alphabet[k])), chr(int(cps[p])), int(bands[owner[p]])] += 1
        if pairs:
            true, read, bands_ = zip(*pairs)
            yield pa.RecordBatch.from_pydict(
                {"script": pa.array(["han"] * len(pairs)), "meant": pa.array(true, pa.string()), "read": pa.array(read, pa.string()), "band": pa.array(bands_, pa.int32()), "n": pa.array([float(n) for n in pairs.values()])}
            )

    return fold


def _segments(words: DataFrame, name: str) -> DataFrame:
    """Adds (key, segment) for each way to leave one or two letters out of ``name``."""
    n = F.length(name)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(2), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.struct(i.alias("i"), k.alias("k")))))
    s = words.where(n > LEAST_SHARED).withColumn("_s", F.explode(spans)).where(n - F.col("_s.k") >= LEAST_SHARED)
    key = F.concat(F.substring(F.col(name), F.lit(1), F.col("_s.i") - 1), F.lit("*"), F.substring(F.col(name), F.col("_s.i") + F.col("_s.k"), n))
    return s.select(*words.columns, key.alias("key"), F.substring(F.col(name), F.col("_s.i"), F.col("_s.k")).alias("segment"))


def _latin_evidence(clean: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (script, meant, read, band, n) of segments, the number of page words (meant and
    read null), and how often clean words hold a segment (read null)."""
    letters = r"A-Za-z\x{00c0}-\x{024f}"
    words = clean.where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit(f"[{letters}]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    # distinct words feed several joins: written once, small beside the texts
    words = materialize(words, "scan-words")
    lower = words.select(F.lower("word").alias("low")).distinct()
    # both halves of a word that a line end parts are no words
    whole = F.regexp_replace("text", rf"[{letters}0-9]+[-\x{{2010}}\x{{2011}}\x{{00ac}}\x{{00ad}}]\s*\n\s*[{letters}0-9]*", " ")
    read = pages.where("text is not null").select("band", F.explode(F.regexp_extract_all(whole, F.lit(f"[{letters}0-9]+"), F.lit(0))).alias("word")).where(F.col("word").rlike(f"[{letters}]"))
    read = materialize(read.groupBy("word", "band").agg(F.count("*").alias("n")), "scan-words")
    unknown = read.join(lower, F.lower("word") == F.col("low"), "left_anti").withColumnRenamed("word", "as_read")
    got = _segments(unknown, "as_read").withColumnRenamed("segment", "read")
    true = _segments(words, "word").withColumnRenamed("segment", "meant")
    both = got.join(true, "key").where((F.col("read") != F.col("meant")) & (F.left("read", F.lit(1)) != F.left("meant", F.lit(1))) & (F.right("read", F.lit(1)) != F.right("meant", F.lit(1))))
    # a word read is shared among the words it may have been: by their counts, and first
    # among those that differ in fewest letters
    both = materialize(both.select("as_read", "band", "n", "meant", "read", "times"), "scan-words").withColumn("part", F.col("times") * F.pow(F.lit(100.0), -F.length("read") - F.length("meant")))
    share = both.groupBy("as_read", "band").agg(F.sum("part").alias("all"))
    pairs = materialize(both.join(share, ["as_read", "band"]).groupBy("meant", "read", "band", "as_read").agg(F.sum(F.col("n") * F.col("part") / F.col("all")).alias("n")), "scan-words")
    often = pairs.where("n > 0.5").groupBy("meant", "read").agg(F.count_distinct("as_read").alias("words")).where(F.col("words") >= LEAST_WORDS)
    pairs = pairs.groupBy("meant", "read", "band").agg(F.sum("n").alias("n")).join(often.select("meant", "read"), ["meant", "read"])
    none = F.lit(None).cast("string")
    seen = read.groupBy("band").agg(F.sum("n").cast("double").alias("n")).select(none.alias("meant"), none.alias("read"), "band", "n")
    held = true.groupBy("meant").agg(F.sum("times").cast("double").alias("n")).select("meant", none.alias("read"), F.lit(0).alias("band"), "n")
    return pairs.select("meant", "read", "band", "n").unionByName(seen).unionByName(held).select(F.lit("latin").alias("script"), "meant", "read", "band", "n")


@dataclass
class Channel:
    """Learned misreads: per script, read segment -> [(true segment, log probability)], and
    per confidence band the log ratio of its rate of misreads to the mean rate."""

    han: dict[str, list[tuple[str, float]]]
    latin: dict[str, list[tuple[str, float]]]
    rate: dict[str, dict[int, float]]


def confusion_table(clean: DataFrame, pages: DataFrame, sketch) -> DataFrame:
    """(script, meant, read, band, n): estimated misreads of all ``pages`` (text,
    confidence) against ``clean`` (text); the rows without ``meant`` hold the number of
    Han characters and of Latin words per band.  ``sketch``: broadcast language model."""
    banded = pages.select("text", F.when(F.col("confidence").isNull() | F.isnan("confidence"), F.lit(-1)).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")) * BANDS)).cast("int").alias("band"))
    han = pages.where("text is not null").select("text", F.col("confidence").cast("double")).mapInArrow(_han_evidence(sketch), "script string, meant string, read string, band int, n double")
    return han.unionByName(_latin_evidence(clean, banded)).groupBy("script", "meant", "read", "band").agg(F.sum("n").alias("n"))


def learn_channel(table: DataFrame, sketch: np.ndarray) -> Channel:
    """Probabilities of a :func:`confusion_table`.  What comes to the driver is bounded: at
    most 1 / LEAST_SHARE pairs per script, and the totals of the bands."""
    per_band = table.where("meant is not null and read is not null")
    pairs = per_band.groupBy("script", "meant", "read").agg(F.sum("n").alias("n"))
    total = pairs.groupBy("script").agg(F.sum("n").alias("all"))
    kept = pairs.join(F.broadcast(total), "script").where(F.col("n") >= F.col("all") * LEAST_SHARE).drop("all")
    held = table.where("meant is not null and read is null").select("script", "meant", F.col("n").alias("held"))
    rows = kept.join(held, ["script", "meant"], "left").collect()
    wrongs = per_band.join(kept.select("script", "meant", "read"), ["script", "meant", "read"], "left_semi").groupBy("script", "band").agg(F.sum("n").alias("n")).collect()
    seens = table.where("meant is null").collect()
    lm = Language(sketch)
    out = Channel({}, {}, {})
    for script in ("han", "latin"):
        seen = {r["band"]: r["n"] for r in seens if r["script"] == script}
        wrong = {r["band"]: r["n"] for r in wrongs if r["script"] == script}
        everything = sum(seen.values())
        mean = (sum(wrong.values()) + 0.5) / (everything + 1.0)
        # a band of few characters stays near the mean
        out.rate[script] = {b: log((wrong.get(b, 0.0) + 1000 * mean) / (n + 1000) / mean) for b, n in seen.items()}
        for r in rows:
            if r["script"] == script:
                # how often the true segment stands in the pages, from its share in clean text
                there = lm.gram(r["meant"]) / lm.all_han if script == "han" else (r["held"] or 0.0) / lm.all_words
                p = r["n"] / max(r["n"], everything * there)
                getattr(out, script).setdefault(r["read"], []).append((r["meant"], log(min(p, 0.3))))
    return out
