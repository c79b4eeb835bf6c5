"""Repair of text from scanned pages.

A noisy-channel model: a page line is what a recogniser made of a clean line.  Both
sides are learned from the data (:mod:`corvane.llm.scan_model`): n-grams of the clean
text, and how often each character or segment is read as another at a page's
confidence.  Lines are decoded by one Viterbi pass over candidate words and
characters.  How often a line form stands at the edge of a page or inside it tells
running headers and footers from headings.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import materialize, shuffle_partitions
from corvane.llm.scan_model import CODE, HAN, Channel, Language, band, confusion_table, language_model, learn_channel, line_forms, mapped
from corvane.llm.tokens import code_points

_WORD = re.compile(r"[A-Za-zÀ-ɏ0-9]+")
_TOKEN = re.compile(r"[A-Za-zÀ-ɏ0-9]+|\s+|.", re.S)
_BEFORE = re.compile(r"([A-Za-zÀ-ɏ]+) $")
_HYPHENS = "-‐‑¬­"
_ALWAYS_SPLIT = "¬­"
_NUMBER = re.compile(r"\s*[0-9lIO]+\s*")
_FOLIO = re.compile(
    r"\s*(?:[·•\-–—~]\s*[0-9lIO]{1,5}\s*[·•\-–—~]|[0-9lIO]{1,5}\s*/\s*[0-9lIO]{1,5}|[ivxlcIVXLC1]{2,8}|[ivxlcIVXLC]|第\s*[0-9lIO]{1,5}\s*页(?:\s*[共/]\s*[0-9lIO]{1,5}\s*页)?|(?:Page|Seite|S\.|p\.)\s*[0-9lIO]{1,5}(?:\s*(?:of|von|sur|/|de)\s*[0-9lIO]{1,5})?)\s*"
)
_ENDED = re.compile(r"[。！？.!?；;：:][\"'”’」）)]*\s*$")
_PROSE = re.compile(r"[，。；]|[a-zß-ÿ]{2}[,;.:](?:\s|$)|[,;]\s*$")
# a code and its revision at the beginning of a line: the point of "Rev." ends no sentence
_REVISION = re.compile(r"\s*" + CODE.pattern + r"\s*Rev\.\s*[A-Z](?=\s|$)")
MARGIN, HYPHEN, MISREAD = "margin", "hyphen", "misread"
#: A known word keeps as rivals the words at most this much (log) below its own score.
RIVAL = 7.0


@dataclass
class Line:
    page: int | None
    number: int
    text: str
    margin: bool = False
    faults: set[str] = field(default_factory=set)


class Decoder:
    """The decoder of one task; remembers what it looked up."""

    def __init__(self, lm: Language, channel: Channel):
        self.lm = lm
        self.word = lm.word
        self.channel = channel
        self.found: dict[str, list[tuple[str, float, tuple[int, ...]]]] = {}
        self.options: dict[str, tuple[bool, list[tuple[str, float, tuple[int, ...]]]]] = {}
        self.best_han = max((p for options in channel.han.values() for _, p in options), default=0.0)
        self.reads = np.zeros(0x110000, bool)
        self.reads[[ord(c) for c in channel.han]] = True

    # margins -------------------------------------------------------------

    def edge_share(self, line: str, place: str) -> float:
        """Share of a line's strongest form that stands at this edge of pages."""
        best = 0.0
        for form in line_forms(line):
            at, inside = self.word(place, form), self.word("m", form)
            if at >= 3:
                best = max(best, at / (at + inside + (self.word("b", form) if place == "t" else 0)))
        return best

    def mark_margins(self, pages: list[list[Line]]) -> None:
        """Margins of whole pages: the first line of each, and its last lines as far as they are
        running ones."""
        tops, folios = Counter(), Counter()
        edges = []
        for page in pages:
            body = [x for x in page if x.text.strip()]
            if not body:
                continue
            edges.append(body)
            tops[line_forms(body[0].text)[0]] += 1
            if _NUMBER.fullmatch(body[-1].text):
                folios[self._offset(body[-1])] += 1
        for body in edges:
            if len(body) > 1 and self._is_footer(body[-1], folios, len(edges)):
                body[-1].margin = True
                k = len(body) - 2
                while k > 0 and self.is_margin_form(body[k].text, "b"):
                    body[k].margin = True
                    k -= 1
            first = body[0]
            whole = line_forms(first.text)[0]
            if len(body) > 1 and (self.is_margin_form(first.text, "t") or tops[whole] > 1 and not _ENDED.search(first.text) and self.word("m", whole) < self.word("t", whole)):
                first.margin = True

    def _offset(self, line: Line) -> int:
        return int(line.text.strip().replace("l", "1").replace("I", "1").replace("O", "0")) - (line.page or 0)

    def _is_footer(self, line: Line, folios: Counter, pages: int) -> bool:
        if _FOLIO.fullmatch(line.text):
            return True
        if _NUMBER.fullmatch(line.text):
            return pages == 1 or folios[self._offset(line)] > 1 or sum(folios.values()) == 1 and pages <= 2
        return self.is_margin_form(line.text, "b") or self.is_margin_form(line.text, "t")

    def is_margin_form(self, text: str, place: str) -> bool:
        return not _PROSE.search(text[m.end() :] if (m := _REVISION.match(text)) else text) and self.edge_share(text, place) >= 0.7

    def mark_inner_margins(self, lines: list[Line]) -> None:
        """Margins inside a running text: known forms, and page numbers beside them or
        inside a sentence.  A text of one line runs past no margin: it is a heading."""
        if sum(1 for x in lines if x.text.strip()) < 2:
            return
        for i, x in enumerate(lines):
            inside = 0 < i < len(lines) - 1
            if x.text.strip() and (inside and _FOLIO.fullmatch(x.text) or self.is_margin_form(x.text, "t") or self.is_margin_form(x.text, "b")):
                x.margin = True
        for i, x in enumerate(lines):
            if 0 < i < len(lines) - 1 and not x.margin and _NUMBER.fullmatch(x.text):
                x.margin = lines[i - 1].margin or lines[i + 1].margin or not _ENDED.search(lines[i - 1].text)

    # words and characters ------------------------------------------------

    def rivals(self, w: str) -> list[tuple[str, float, tuple[int, ...]]]:
        """Clean words that may have been read as ``w``: (word, log probability of the
        reading at mean confidence, places of ``w`` read wrongly).  The search goes from left
        to right and drops beginnings that no clean word has, so neither the length of a word
        nor the number of its wrong segments is limited."""
        got = self.found.get(w)
        if got is not None:
            return got
        # per place: beginning -> (log probability, wrong places)
        ways: list[dict[str, tuple[float, tuple[int, ...]]]] = [{} for _ in range(len(w) + 1)]
        ways[0][""] = (0.0, ())
        for i in range(len(w)):
            for start, (score, spots) in ways[i].items():
                options = [(w[i], 1, 0.0)]
                for k in (1, 2):
                    options += [(true, k, p) for true, p in self.channel.latin.get(w[i : i + k], ())] if i + k <= len(w) else []
                for true, k, p in options:
                    grown = start + true
                    if (grown not in ways[i + k] or ways[i + k][grown][0] < score + p) and self.word("p", grown.lower()):
                        ways[i + k][grown] = (score + p, spots if p == 0.0 else (*spots, *range(i, i + k)))
        own = self.lm.word_score("", w)
        out = [(c, p, spots) for c, (p, spots) in ways[len(w)].items() if spots and self.word("x", c.lower()) and p + self.lm.word_score("", c) > own - RIVAL]
        if len(self.found) < 500_000:
            self.found[w] = out
        return out

    def fix_word(self, w: str) -> tuple[str, tuple[int, ...]] | None:
        """The most probable true word of ``w`` by itself and the places read wrongly; None if
        that is ``w``."""
        best = max(self.rivals(w), key=lambda r: r[1] + self.lm.word_score("", r[0]), default=None)
        return (best[0], best[2]) if best and best[1] + self.lm.word_score("", best[0]) > self.lm.word_score("", w) else None

    def splits_word(self, left: str, mark: str, right: str) -> bool:
        """Whether a line-end mark only parts a word."""
        if mark in _ALWAYS_SPLIT:
            return True
        a, b = re.search(r"[A-Za-zÀ-ɏ0-9]+$", left), re.match(r"[A-Za-zÀ-ɏ0-9]+", right)
        if not a or not b or HAN.search(right[:1]):
            return False
        l, r = a.group(), b.group()
        before = left[: a.start()]
        if re.search(r"[A-Z0-9]-$", before) or l.isdigit() or r[0].isdigit() and not re.search("[a-z]", r) or (l.isupper() and r.isupper()):
            return False
        joined, parted = (l + r).lower(), f"{l}-{r}".lower()
        chain = re.search(r"(?:[A-Za-zÀ-ɏ]+-)+$", before)
        head = chain.group().lower() if chain else ""
        one, two = max(self.word("x", joined), self.word("x", head + joined) if head else 0), max(self.word("x", parted), self.word("x", head + parted) if head else 0)
        if one or two:
            return one >= two
        tail = re.match(r"[A-Za-zÀ-ɏ0-9]+((?:-[A-Za-zÀ-ɏ]+)+)", right)
        if tail:
            one, two = self.word("x", joined + tail.group(1).lower()), self.word("x", parted + tail.group(1).lower())
            if one or two:
                return one >= two
        fixed = self.fix_word(l + r)
        if fixed:
            return True
        fl, fr = self.fix_word(l), self.fix_word(r)
        cl, cr = (fl[0] if fl else l).lower(), (fr[0] if fr else r).lower()
        if self.word("x", f"{cl}-{cr}"):
            return False
        if not self.word("x", cl) and l[-1].islower():
            # no word by itself: cut off even where the rest is missing
            return True
        if not r[0].islower():
            return False
        return not (self.word("x", cl) > 0 and self.word("x", cr) > 0 and len(cl) > 3 and len(cr) > 3)

    def decode(self, lines: list[Line], confidence: float | None) -> str:
        """Marks hyphens and misreads of the body lines; returns their joined repair."""
        body = [x for x in lines if not x.margin]
        stream: list[str] = []
        owner: list[Line | None] = []
        shown = [i for i, x in enumerate(body) if x.text.strip()]
        after = dict(zip(shown, shown[1:]))
        for i, x in enumerate(body):
            text = x.text.strip()
            if not text:
                # a blank line ends a paragraph only after a whole sentence
                if stream and _ENDED.search("".join(stream[-3:])) and stream[-1] != "\n":
                    stream.append("\n")
                    owner.append(None)
                continue
            glue = ""
            nxt = body[after[i]].text.strip() if i in after else None
            if text[-1] in _HYPHENS and len(text) > 1:
                if nxt is None:
                    a = re.search(r"[A-Za-zÀ-ɏ]+$", text[:-1])
                    if text[-1] in _ALWAYS_SPLIT or a and not self.word("x", a.group().lower()) and not re.search(r"[A-Z0-9]-[A-Z0-9]*$", text[:-1]):
                        x.faults.add(HYPHEN)
                elif self.splits_word(text[:-1], text[-1], nxt):
                    x.faults.add(HYPHEN)
                    text = text[:-1]
            elif nxt is not None and not (HAN.search(text[-1]) or HAN.search(nxt[0]) or text[-1] in "，。；：、！？（）" or nxt[0] in "，。；：、！？）"):
                glue = " "
            stream += text
            owner += [x] * len(text)
            if glue:
                stream.append(glue)
                owner.append(None)
        raw = "".join(stream)
        changed = self._viterbi(raw, band(confidence))
        out = [*stream]
        for at, end, text, spots in changed:
            for k in spots:
                if (x := owner[k]) is not None:
                    x.faults.add(MISREAD)
            out[at:end] = [text, *[""] * (end - at - 1)]
        return "".join(out)

    def _numeral(self, w: str) -> str | None:
        """A numeral with letters in it, as digits."""
        if re.fullmatch(r"[0-9lO]+", w) and re.search("[0-9]", w) and not w.endswith("lx"):
            return w.replace("l", "1").replace("O", "0")
        return None

    def _digits(self, w: str) -> int:
        """Length of the number that stands before a unit."""
        unit = re.match(r"[0-9]+", w)
        return unit.end() if unit and (self.word("x", w[unit.end() :].lower()) or len(w) - unit.end() <= 3) else 0

    def _own_options(self, w: str) -> tuple[bool, list[tuple[str, float, tuple[int, ...]]]]:
        """Whether other characters beside it can exempt a word, and its candidates, the word
        itself first."""
        same = (w, 0.0, ())
        if len(w) < 2 or w.isdigit():
            return False, [same]
        fixed = self._numeral(w)
        if fixed:
            return False, [(fixed, 0.0, tuple(k for k, c in enumerate(w) if c in "lO"))] if fixed != w else [same]
        base = self._digits(w)
        if len(w) - base < 2 or CODE.fullmatch(w) or re.match(r"[A-Z]{1,3}\d", w):
            return False, [same]
        return True, [same, *((w[:base] + c, p, tuple(k + base for k in spots)) for c, p, spots in self.rivals(w[base:]))]

    def _word_options(self, raw: str, at: int, w: str, rate: float) -> list[tuple[str, float, tuple[int, ...]]]:
        """Candidates of a word in its place."""
        got = self.options.get(w)
        if got is None:
            got = self._own_options(w)
            if len(self.options) < 500_000:
                self.options[w] = got
        exempt, out = got
        if not exempt or len(out) == 1:
            return out
        end = at + len(w)
        before, after = raw[at - 1 : at] if at else "", raw[end : end + 1]
        part = before.isalpha() and not HAN.match(before) or after and (after.isalpha() and not HAN.match(after) or ud.combining(after))
        code = before in ("-", "/") and before and re.search(r"[A-Z0-9]", raw[max(0, at - 2) : at - 1]) or w.isupper() and re.match(r"-\d", raw[end : end + 2])
        return out[:1] if part or code else [out[0], *((c, p + rate * len(spots), spots) for c, p, spots in out[1:])]

    def _han_spots(self, raw: str) -> set[int]:
        """Places whose character may be misread: no other path can win where the text as read
        is more probable than the most probable misread."""
        cps = code_points([mapped(raw)])[0]
        reads = self.reads[cps]
        if not reads.any():
            return set()
        steps = np.concatenate([self.lm.steps(cps), [0.0, 0.0]])
        through = steps[:-2] + steps[1:-1] + steps[2:]
        return set(np.flatnonzero(reads & (through < self.best_han + 1.0)).tolist())

    def _viterbi(self, raw: str, at_band: int) -> list[tuple[int, int, str, list[int]]]:
        """Changes (start, end, text, wrong places) of the most probable reading of ``raw``.
        Tokens with one candidate decide nothing two tokens away, so each run of undecided
        tokens is decoded with its neighbours."""
        rate_h, rate_l = (self.channel.rate[s].get(at_band, 0.0) for s in ("han", "latin"))
        options: dict[int, list[tuple[str, float, tuple[int, ...]]]] = {}
        changed = []
        for at in self._han_spots(raw):
            options[at] = [(raw[at], 0.0, ()), *((true, p + rate_h, (0,)) for true, p in self.channel.han[raw[at]])]
        for m in _WORD.finditer(raw):
            w, at = m.group(), m.start()
            if len(w) > 1:
                got = self._word_options(raw, at, w, rate_l)
                if len(got) > 1:
                    options[at] = got
                elif got[0][0] != w:
                    changed.append((at, at + len(w), got[0][0], [at + k for k in got[0][2]]))
        starts, i = sorted(options), 0
        while i < len(starts):
            j, end = i, starts[i] + len(options[starts[i]][0][0])
            while j + 1 < len(starts) and self._tokens(raw, end, 3, starts[j + 1])[1] == starts[j + 1]:
                j += 1
                end = starts[j] + len(options[starts[j]][0][0])
            run, _ = self._tokens(raw, starts[i], len(raw), end)
            after, _ = self._tokens(raw, end, 2, len(raw))
            for (at, t), choice in zip(run, self._decode_run(raw, run + after, options, len(run))):
                if choice[0] != t:
                    changed.append((at, at + len(t), choice[0], [at + k for k in choice[2]]))
            i = j + 1
        return changed

    @staticmethod
    def _tokens(raw: str, at: int, most: int, end: int) -> tuple[list[tuple[int, str]], int]:
        """Up to ``most`` tokens from ``at`` to before ``end``, and where they stop."""
        out = []
        while at < end and len(out) < most:
            m = _TOKEN.match(raw, at)
            out.append((at, m.group()))
            at = m.end()
        return out, at

    def _decode_run(self, raw, tokens, options, many: int) -> list[tuple[str, float, tuple[int, ...]]]:
        first = tokens[0][0]
        left = mapped(("\n\n" + raw[max(0, first - 2) : first])[-2:])
        before = _BEFORE.search(raw[max(0, first - 60) : first])
        before = before.group(1).lower() if before else ""
        # state: the last two characters and the last word of the path
        states: dict[tuple[str, str], tuple[float, tuple]] = {(left, before): (0.0, ())}
        for n, (at, t) in enumerate(tokens):
            new: dict[tuple[str, str], tuple[float, tuple]] = {}
            for choice in options.get(at, [(t, 0.0, ())]) if n < many else [(t, 0.0, ())]:
                c = mapped(choice[0])
                word = len(c) > 1 and c[0].isalnum() or c.isascii() and c.isalpha()
                for (state, last), (score, path) in states.items():
                    if word:
                        gain = 0.0 if choice[0].isdigit() else self.lm.word_score(last, choice[0][self._digits(t) :])
                        key = (c[-2:] if len(c) > 1 else state[1] + c, choice[0].lower())
                    else:
                        gain = self.lm.step(state, c[-1])
                        key = ((state + c)[-2:], last if c == " " else "")
                    total = score + gain + choice[1]
                    if key not in new or total > new[key][0] + 1e-9:
                        new[key] = (total, (*path, choice))
            states = new
        return list(max(states.values(), key=lambda v: v[0])[1][:many])


def _analyse(model, channel, schema_names: list[str]):
    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Language(model.value), channel.value)
        for batch in batches:
            rows = []
            for origin, row_id, confidence, pages in zip(*(batch.column(i).to_pylist() for i in range(4))):
                # a page that starts inside a sentence continues the one before
                parsed = [[Line(p["page_number"], k + 1, t.rstrip("\r")) for k, t in enumerate((p["text"] or "").split("\n"))] for p in pages or [] if p is not None]
                if origin == "units":
                    for page in parsed:
                        decoder.mark_inner_margins(page)
                else:
                    decoder.mark_margins(parsed)
                lines = [x for page in parsed for x in page]
                repaired = decoder.decode(lines, confidence)
                faults = [(x.page, x.number, f) for x in lines for f in ([MARGIN] if x.margin else sorted(x.faults))]
                rows.append((origin, row_id, repaired, [{"page_number": p, "line_no": n, "fault": f} for p, n, f in faults]))
            if rows:
                fault = pa.list_(pa.struct([("page_number", pa.int32()), ("line_no", pa.int32()), ("fault", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.string(), pa.string(), fault])], names=schema_names)

    return analyse


def scanned_rows(ocr_results: DataFrame, units: DataFrame) -> DataFrame:
    """(origin, row_id, confidence, pages): every OCR result once (latest extracted) and
    every unit of a scanned version once, with the mean confidence of its version."""
    page = "array<struct<text:string,page_number:int>>"
    ocr = ocr_results.where("ocr_id is not null").groupBy("ocr_id").agg(F.max_by(F.struct("document_version_id", "mean_confidence", "blocks"), F.struct("extracted_at")).alias("r"))
    results = ocr.select(
        F.lit("ocr_results").alias("origin"), F.col("ocr_id").alias("row_id"), F.col("r.mean_confidence").cast("double").alias("confidence"),
        F.transform("r.blocks", lambda b: F.struct(b["text"].alias("text"), b["page_number"].alias("page_number"))).cast(page).alias("pages"),
    )
    versions = ocr_results.where("document_version_id is not null").groupBy("document_version_id").agg(F.min("mean_confidence").cast("double").alias("confidence"))
    of_scans = units.where("unit_id is not null").select("unit_id", "document_version_id", "text", "page_number", "loaded_at").join(versions, "document_version_id")
    once = of_scans.groupBy("unit_id").agg(F.max_by(F.struct("confidence", "text", "page_number"), F.struct("loaded_at")).alias("u"))
    texts = once.select("unit_id", "u.*").select(
        F.lit("units").alias("origin"), F.col("unit_id").alias("row_id"), "confidence", F.array(F.struct("text", F.col("page_number").cast("int").alias("page_number"))).cast(page).alias("pages")
    )
    return results.unionByName(texts)


def learn(ocr_results: DataFrame, units: DataFrame, rows: DataFrame) -> tuple[np.ndarray, Channel]:
    """Language model of the units of versions that were not scanned, and the channel that
    the scanned ``rows`` show against them."""
    spark = units.sparkSession
    scans = ocr_results.where("document_version_id is not null").select("document_version_id").distinct()
    clean = units.where("text is not null").select("document_version_id", "text").join(scans, "document_version_id", "left_anti").select("text")
    texts = rows.select("origin", "confidence", F.explode("pages").alias("p")).select("origin", "confidence", F.col("p.text").alias("text"))
    # only whole pages show where the edge of a page is
    model = language_model(clean, texts.where("origin = 'ocr_results'").select("text"))
    sent = spark.sparkContext.broadcast(model)
    table = materialize(confusion_table(clean, texts.select("text", "confidence"), sent), "scan-channel")
    return model, learn_channel(table, model)


def repair_scans(ocr_results: DataFrame, units: DataFrame) -> DataFrame:
    """(origin, row_id, repaired, faults) of every OCR result and every unit of a scanned
    version.

    ``repaired`` joins the body lines into paragraphs with whole words and corrected
    characters; ``faults`` lists (page_number, line_no, fault).  Null blocks and texts are
    empty.  What a scan says is compared with the units of all other versions: without any
    of them no misread can be known.
    """
    spark = units.sparkSession
    # decoding is work for the CPU, not for the shuffle: keep all tasks busy however few bytes
    rows = materialize(scanned_rows(ocr_results, units).repartition(shuffle_partitions(spark), "row_id"), "scanned-rows")
    model, channel = learn(ocr_results, units, rows)
    names = ["origin", "row_id", "repaired", "faults"]
    decode = _analyse(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(channel), names)
    return rows.mapInArrow(decode, "origin string, row_id string, repaired string, faults array<struct<page_number:int,line_no:int,fault:string>>")


def found_faults(repairs: DataFrame) -> DataFrame:
    """(origin, row_id, page_number, line_no, fault), one row per fault."""
    return repairs.select("origin", "row_id", F.explode("faults").alias("f")).select("origin", "row_id", "f.page_number", "f.line_no", "f.fault")
