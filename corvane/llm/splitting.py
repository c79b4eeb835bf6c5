"""Cutting oversized texts at natural boundaries, with overlap.

A text is parsed into a tree: sections nested by the rank of their heading, paragraphs
(parted by blank lines), list items nested by indentation, lines, sentences, clauses,
tokens.  Sibling subtrees are merged while they fit the limit; only a node that is larger
than the limit is opened, and what comes out of it is never merged with its siblings.  A
heading left alone goes with what follows it.  Each piece but the first begins with
the last ``overlap`` tokens of the one before; the first has the whole limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import materialize
from corvane.llm.tokens import tokenize

_NUMERAL = r"[一二三四五六七八九十百零〇\d]+"
#: Heading lines, as (pattern, rank); the number of # of a Markdown heading is its rank.
HEADINGS = [
    (re.compile(rf"^[ \t]*第{_NUMERAL}编(?:\s|$)"), 1),
    (re.compile(rf"^[ \t]*(?:第{_NUMERAL}章(?:\s|$)|(?:Chapter|Kapitel|Chapitre)\s?\d)"), 2),
    (re.compile(rf"^[ \t]*(?:第{_NUMERAL}节(?:\s|$)|(?:Section|Abschnitt)\s?\d)"), 3),
]
_MARKDOWN = re.compile(r"^[ \t]*(#{1,6})\s")
_ITEM = re.compile(rf"^([ \t]*)(?:[-*+•·▪◦●○■□]\s|[（(]?(?:{_NUMERAL}|[a-zA-Z])[.)、．）]\s*)")
_BLANK_LINE = re.compile(r"\n[ \t\r　]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[。！？!?｡]+[”’」』）)\"']*|[.…]+[”’)\"']*(?=\s|$)")
_CLAUSE = re.compile(r"[；;，,、､：:]+|[.!?]+(?=\s)|\s[–—-]\s")
#: Sources up to which their limits are sent to all tasks.
SMALL_CATALOGUE = 100_000
#: Keys of units delivered again up to which they are sent to all tasks.
FEW_REPEATED = 1_000_000
#: What a node without children is opened into.
_BODY, _PARAGRAPH, _TEXT, _SENTENCES, _CLAUSES = range(5)


@dataclass
class Node:
    """A subtree over the characters from ``start`` to ``end``; opened when needed."""

    start: int
    end: int
    level: int
    children: list[Node] | None = None
    heading: bool = False


def heading_rank(line: str) -> int | None:
    mark = _MARKDOWN.match(line)
    return len(mark.group(1)) if mark else next((rank for pattern, rank in HEADINGS if pattern.match(line)), None)


def item_rank(line: str) -> int | None:
    """1 + indentation of a list item."""
    item = _ITEM.match(line)
    return 1 + len(item.group(1).expandtabs(4)) if item else None


def _cut(start: int, end: int, text: str, pattern: re.Pattern[str], level: int) -> list[Node]:
    ends = [start, *(m.end() for m in pattern.finditer(text, start, end)), end]
    return [Node(a, b, level) for a, b in zip(ends, ends[1:]) if b > a]


def _nest(start: int, end: int, text: str, rank_of: Callable[[str], int | None], body: Callable[[int, int], list[Node]], heading: bool) -> list[Node]:
    """Nodes of the ranked lines between two places, each with its line, the unranked text
    below it and the nodes of higher ranks."""
    top: list[Node] = []
    open_ = [(0, top)]
    at = start
    for line in _cut(start, end, text, _LINE, _TEXT):
        rank = rank_of(text[line.start : line.end])
        if rank is not None:
            open_[-1][1].extend(body(at, line.start))
            while open_[-1][0] >= rank:
                open_.pop()
            line.heading = heading
            node = Node(line.start, line.end, _BODY, [line])
            open_[-1][1].append(node)
            open_.append((rank, node.children))
            at = line.end
    open_[-1][1].extend(body(at, end))
    return top


def _close(nodes: list[Node]) -> list[Node]:
    """Nodes whose ends are those of their last children."""
    for n in reversed(nodes):
        if n.children:
            n.end = max(n.end, _close(n.children)[-1].end)
    return nodes


def parse(text: str) -> list[Node]:
    """Sections of a text and the paragraphs outside of any."""
    return _close(_nest(0, len(text), text, heading_rank, lambda a, b: _cut(a, b, text, _BLANK_LINE, _PARAGRAPH), True))


def _open(node: Node, text: str) -> list[Node]:
    if node.children is None:
        if node.level == _PARAGRAPH:
            node.children = _close(_nest(node.start, node.end, text, item_rank, lambda a, b: _cut(a, b, text, _LINE, _TEXT), False))
        else:
            pattern = {_TEXT: _SENTENCE, _SENTENCES: _CLAUSE}.get(node.level)
            node.children = _cut(node.start, node.end, text, pattern, node.level + 1) if pattern else []
    return node.children


def pack(text: str, starts: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges covering all tokens in order, of at most ``limit`` tokens, those after
    the first of at most ``limit - overlap``."""
    out: list[tuple[int, int]] = []

    def room() -> int:
        return max(1, limit - overlap) if out else limit

    def windows(lo: int, hi: int) -> None:
        while lo < hi:
            out.append((lo, min(hi, lo + room())))
            lo = out[-1][1]

    def siblings(nodes: list[Node], lead: tuple[int, int] | None) -> None:
        """``lead``: tokens of a heading that waits for what follows."""
        group, waits = lead, lead is not None
        for n in nodes:
            lo, hi = (int(x) for x in np.searchsorted(starts, (n.start, n.end)))
            if lo == hi:
                continue
            if group and hi - group[0] <= room():
                group, waits = (group[0], hi), waits and n.heading
            elif hi - lo <= room():
                if group:
                    out.append(group)
                    # what was emitted may leave less room
                    if hi - lo > room():
                        group = None
                        opened(n, lo, hi, None)
                        continue
                group, waits = (lo, hi), n.heading
            else:
                if group and not waits:
                    out.append(group)
                opened(n, lo, hi, group if waits else None)
                group, waits = None, False
        if group:
            windows(*group)

    def opened(n: Node, lo: int, hi: int, lead: tuple[int, int] | None) -> None:
        inner = _open(n, text)
        if inner:
            siblings(inner, lead)
        else:
            windows(lead[0] if lead else lo, hi)

    siblings(parse(text), None)
    return out


def split_text(text: str, max_tokens: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of ``text`` as (start, end, tokens); one piece if it fits.  The overlap
    is at most ``max_tokens - 1``, so that every piece moves on."""
    batch = tokenize([text])
    n = len(batch.starts)
    if n <= max_tokens:
        return [(0, len(text), n)]
    overlap = max(0, min(overlap, max_tokens - 1))
    out = []
    for a, b in pack(text, batch.starts, max_tokens, overlap):
        a = max(0, a - overlap)
        out.append((int(batch.starts[a]), int(batch.ends[b - 1]), b - a))
    return out


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for i, text, limit, overlap in zip(range(len(rows)), rows["text"], rows["max_tokens"], rows["overlap_tokens"]):
            pieces = split_text(text, int(limit), 0 if pd.isna(overlap) else int(overlap))
            out += [(i, k, len(pieces), text[a:b], n, a, b) for k, (a, b, n) in enumerate(pieces)]
        got = pd.DataFrame(out, columns=["row", "piece_no", "pieces", "piece_text", "piece_tokens", "start_char", "end_char"])
        base = rows.drop(columns=["text", "max_tokens", "overlap_tokens"]).reset_index(drop=True)
        yield pd.concat([base.loc[got["row"]].reset_index(drop=True), got.drop(columns="row")], axis=1)


def split_oversized(items: DataFrame, keep: list[str]) -> DataFrame:
    """Pieces of every item.

    ``items`` has ``text``, ``max_tokens`` and ``overlap_tokens`` beside the columns
    ``keep``, which every piece repeats.  Adds piece_no (from 0), pieces, piece_text,
    piece_tokens, start_char and end_char (code points).  An item within its limit, of
    null text or of a null or non-positive limit is one piece as stored; its
    piece_tokens is null unless it was counted.  Only texts with more characters than
    the limit can have more tokens, so the others never leave the JVM.
    """
    long = F.length("text") > F.col("max_tokens")
    valid = F.col("max_tokens") > 0
    whole = items.where(~F.coalesce(long & valid, F.lit(False))).select(
        *keep, F.lit(0).alias("piece_no"), F.lit(1).alias("pieces"), F.col("text").alias("piece_text"), F.lit(None).cast("int").alias("piece_tokens"), F.lit(0).alias("start_char"), F.length("text").alias("end_char")
    )
    cut = items.where(long & valid).select(*keep, "text", "max_tokens", "overlap_tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keep).schema.fields)
    schema = f"{fields}, piece_no int, pieces int, piece_text string, piece_tokens int, start_char int, end_char int"
    return whole.unionByName(cut.mapInPandas(_split_batches, schema))


def unit_pieces(units: DataFrame, sources: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of units under the limit of their source's content profile, each with
    the unit's heading_path.  A unit delivered again counts once (latest loaded)."""
    profile = sources.select(F.col("id").alias("source_id"), "content_profile").join(limits.select("content_profile", "max_tokens", "overlap_tokens"), "content_profile", "left")
    profile = profile.dropDuplicates(["source_id"])
    # the catalogue of sources is small, but its size is not promised
    small = F.broadcast(profile) if sources.count() <= SMALL_CATALOGUE else profile
    keyed = units.where(F.col("unit_id").isNotNull()).select("unit_id", "source_id", "text", "heading_path", "loaded_at")
    latest = lambda rows: rows.groupBy("unit_id").agg(F.max_by(F.struct("source_id", "text", "heading_path"), F.struct("loaded_at", "text")).alias("u")).select("unit_id", "u.*")
    # only units that came again are compared; while they are few, no other text is shuffled
    again = materialize(keyed.groupBy("unit_id").agg(F.count("*").alias("times")).where("times > 1").select("unit_id"), "units-again")
    if again.count() <= FEW_REPEATED:
        again = F.broadcast(again)
        once = keyed.join(again, "unit_id", "left_anti").drop("loaded_at").unionByName(latest(keyed.join(again, "unit_id", "left_semi")))
    else:
        once = latest(keyed)
    items = once.join(small, "source_id", "left")
    return split_oversized(items, ["unit_id", "heading_path"])
