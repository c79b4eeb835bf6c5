"""One form for texts that a reader cannot tell apart.

Characters are sorted once into stable and unstable ones.  A character is stable
when it is its own canonical form whatever stands beside it (its quick-check
property is Yes, it is no combining mark and no look-alike).  A text without
unstable characters is returned as it is; otherwise each unstable run, with the
character before it as context, is normalised on its own and spliced between the
unchanged parts.

Kept apart: letter case, accents, raised, lowered and circled signs, traditional
and simplified characters, and line breaks.
"""

from __future__ import annotations

import re
import sys
import unicodedata as ud
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import materialize

# Letters of other scripts that print like a Latin letter, as
# (look-alike, Latin) pairs; dashes that print like the ASCII hyphen; the two micro
# signs; radicals without a Unicode decomposition that print like a character.
LOOK_ALIKES = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϳj ϲc "
    "‐- ﹣- −- µμ "
    "⺁厂 ⺇几 ⺌小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺛旡 ⺝月 ⺟母 ⺠民 ⺢氺 ⺩王 ⺪疋 ⺫目 ⺮竹 ⺯糸 ⺱罓 ⺲罒 ⺴网 ⺶羊 ⺸羋 ⺹耂 ⺻聿 ⺼肉 ⺽臼 "
    "⻁虎 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻍辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 "
    "⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻲亀 ⻳龟"
)
# Ranges of characters that show nothing (default ignorable, and the
# control characters other than tab and line breaks).
SHOWS_NOTHING = (
    "\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮"
    "⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
_KEPT_KINDS = ("<super>", "<sub>", "<circle>")


@cache
def _look_alikes() -> dict[str, str]:
    return {pair[0]: pair[1] for pair in LOOK_ALIKES.split()}


@cache
def _nothing() -> re.Pattern[str]:
    return re.compile(f"[{SHOWS_NOTHING}]+")


@cache
def _one(ch: str) -> str:
    """Canonical form of one character on its own."""
    kind = ud.decomposition(ch).split(" ", 1)[0]
    if kind in _KEPT_KINDS:
        return ch
    if kind.startswith("<"):
        ch = ud.normalize("NFKC", ch)
    else:
        ch = ud.normalize("NFC", ch)
    same = _look_alikes()
    return "".join(" " if ud.category(c) == "Zs" or c == "\t" else same.get(c, c) for c in ch)


@cache
def unstable_pattern() -> str:
    """A regular expression class of all unstable characters."""
    unstable: set[int] = set()
    look = _look_alikes()
    nothing = _nothing()
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xE000 <= cp <= 0xF8FF:
            continue
        ch = chr(cp)
        dec = ud.decomposition(ch)
        if ud.combining(ch) or ch in look or nothing.match(ch) or (cp != 32 and ud.category(ch) == "Zs") or ch == "\t":
            unstable.add(cp)
        elif dec:
            if dec[0] == "<":
                if not dec.startswith(_KEPT_KINDS):
                    unstable.add(cp)
            else:
                if ud.normalize("NFC", ch) != ch:
                    unstable.add(cp)
                parts = [int(x, 16) for x in dec.split()]
                if len(parts) == 2 and ud.normalize("NFC", chr(parts[0]) + chr(parts[1])) == ch:
                    unstable.add(parts[1])
    unstable.update(range(0x1161, 0x1176))
    unstable.update(range(0x11A8, 0x11C3))
    points, parts, i = sorted(unstable), [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        parts.append(f"\\U{points[i]:08x}" + (f"-\\U{points[j]:08x}" if j > i else ""))
        i = j + 1
    return "[" + "".join(parts) + "]"


def canonicalizer(pattern: str):
    """A function str -> str; ``pattern`` is :func:`unstable_pattern`, built once."""
    quick = re.compile(pattern)
    # the context of a run is the one character before it
    segment = re.compile(f"(?:[^\\n]?{pattern}+)+")
    nothing = _nothing()
    seen: dict[str, str] = {}

    def splice(m: re.Match[str]) -> str:
        part = m.group()
        got = seen.get(part)
        if got is None:
            got = ud.normalize("NFC", "".join(map(_one, nothing.sub("", part))))
            if len(seen) < 200_000:
                seen[part] = got
        return got

    def canonical(text: str | None) -> str | None:
        if text is None:
            return None
        if quick.search(text):
            text = segment.sub(splice, text)
        return text.strip()

    return canonical


def canonical_column(text: Column) -> Column:
    """Canonical form of a text column; null stays null, blanks at the ends go."""
    pattern = unstable_pattern()

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(canonicalizer(pattern), na_action="ignore")

    return canonical(text)


def alike_pairs(records: DataFrame, scope: list[str]) -> DataFrame:
    """Pairs of records whose stored texts differ but look the same.

    ``records`` has ``id``, ``text`` and the ``scope`` columns; both records of a pair
    agree in the scope (nulls agree with nulls).  Returns scope, id_a, id_b with
    id_a < id_b.  Records of a null id or text take part in no pair; repeated rows
    count once.  Texts are compared by 128-bit digests, groups of equal stored texts
    are never paired with themselves.
    """
    keys = [*scope, "looks"]
    digests = (
        records.where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .select(*scope, "id", F.unhex(F.md5(canonical_column(F.col("text")))).alias("looks"), F.unhex(F.md5("text")).alias("stored"))
        .distinct()
    )
    # the digests feed six joins: texts are normalised once
    rows = materialize(digests, "looks")
    mixed = rows.groupBy(*keys).agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo < hi").select(*[F.col(k).alias(f"m_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    rows = rows.join(mixed, on, "left_semi")
    variants = rows.select(*keys, "stored").distinct()
    low = variants.select(*keys, F.col("stored").alias("stored_a"))
    high = variants.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("stored").alias("stored_b"))
    pairs = low.join(high, on).where("stored_a < stored_b").select(*keys, "stored_a", "stored_b")
    a = rows.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("id").alias("x"), F.col("stored").alias("sx"))
    b = rows.select(*[F.col(k).alias(f"m_{k}") for k in keys], F.col("id").alias("y"), F.col("stored").alias("sy"))
    one = pairs.join(a, [*on, F.col("stored_a") == F.col("sx")]).select(*keys, "stored_b", "x")
    two = one.join(b, [*on, F.col("stored_b") == F.col("sy")]).where("x <> y")
    return two.select(*scope, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
