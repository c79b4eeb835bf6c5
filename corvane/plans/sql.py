"""SQL fragments shared by the reference queries."""

from __future__ import annotations

import unicodedata

from corvane.functions.text import STOP_TERMS

#: White space as the engine sees it.
BLANK = r"[\s\x{000b}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"\x{3400}-\x{9fff}"
STOPS = STOP_TERMS
NUMERAL = "零〇一二两三四五六七八九十百千万亿0-9"
#: Compatibility forms that occur in the test tables.
FORMS = {"℃": "°C", "㎜": "mm", "㎏": "kg", "ﬁ": "fi", "ﬀ": "ff", "ﬂ": "fl", "…": "...", "²": "2", "³": "3", "①": "1", "②": "2", "③": "3", "④": "4", "⑤": "5", "⑥": "6", "⑦": "7", "⑧": "8", "⑨": "9", "Ω": "Ω", "µ": "μ", "¨": " ̈", "ª": "a", "¯": " ̄", "´": " ́", "¸": " ̧", "¹": "1", "º": "o", "¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "‑": "‐"}


def nfkc(x: str) -> str:
    radicals = [chr(c) for c in range(0x2F00, 0x2FD6)]
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "".join(radicals)
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "".join(unicodedata.normalize("NFKC", r) for r in radicals)
    out = f"translate({x}, '{wide}　     ｡､', '{narrow}      。、')"
    for a, b in FORMS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


def normal(x: str) -> str:
    return f"lower({nfkc(x)})"


def number(x: str) -> str:
    """Value of a numeral below ten thousand, or of a digit string."""
    digit = lambda d: f"coalesce(try_cast(translate({d}, '零〇一二两三四五六七八九', '001223456789') AS BIGINT), 0)"
    part = lambda unit: f"(CASE WHEN contains({x}, '{unit}') THEN greatest(1, {digit(f'''regexp_extract({x}, '([一二两三四五六七八九]?){unit}', 1)''')}) ELSE 0 END)"
    tail = digit(f"regexp_extract({x}, '([一二两三四五六七八九])$', 1)")
    return (
        f"(CASE WHEN regexp_full_match({x}, '[0-9]+') THEN try_cast({x} AS BIGINT) WHEN regexp_full_match({x}, '[零〇一二两三四五六七八九]+') THEN try_cast(translate({x}, '零〇一二两三四五六七八九', '001223456789') AS BIGINT) "
        f"WHEN regexp_matches({x}, '[0-9万亿]') THEN NULL ELSE 1000 * {part('千')} + 100 * {part('百')} + 10 * {part('十')} + {tail} END)"
    )


def _cut(c: str) -> str:
    """A code as matched: up to the last word boundary before what follows."""
    return f"(CASE WHEN {c}.b <> '' THEN regexp_replace({c}.a, '[A-Za-z0-9_]+$', '') ELSE regexp_replace({c}.a, '[.-]+$', '') END)"


def anchors(x: str) -> str:
    """Locators of a normal text, in the order clause, chapter, step, code."""
    num = lambda kind, p: f"list_transform(regexp_extract_all({x}, '{p}', 1), lambda v: '{kind}:' || {number('v')})"
    code = f"'(?:^|[^\\p{{L}}\\p{{N}}_])([a-z][a-z0-9_.-]{{2,}})([\\p{{L}}\\p{{N}}_]?)'"
    pairs = f"list_transform(list_zip(regexp_extract_all({x}, {code}, 1), regexp_extract_all({x}, {code}, 2)), lambda p: {{'a': p[1], 'b': p[2]}})"
    codes = f"list_transform(list_filter({pairs}, lambda c: regexp_matches(c.a, '[0-9]') AND length({_cut('c')}) >= 3), lambda c: 'code:' || {_cut('c')})"
    every = f"list_concat({num('clause', rf'第\s*([{NUMERAL}]+)\s*条')}, {num('chapter', rf'第\s*([{NUMERAL}]+)\s*章')}, {num('step', rf'(?:步骤\s*|第\s*)([{NUMERAL}]+)\s*步')}, {codes})"
    return f"list_distinct(list_filter({every}, lambda t: t IS NOT NULL))"


def tokens(x: str) -> str:
    """Index terms of a normal text, repeated; their order does not matter to the queries."""
    stops = ", ".join(f"'{s}'" for s in STOPS)
    grams = "CASE WHEN length(r) = 1 THEN [r] ELSE list_concat(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), CASE WHEN length(r) <= 8 THEN [r] ELSE [] END) END"
    return f"list_filter(list_concat({anchors(x)}, flatten(list_transform(regexp_extract_all({x}, '[{CJK}]+'), lambda r: {grams})), regexp_extract_all({x}, '[a-z0-9_][a-z0-9_.-]*')), lambda t: t <> '' AND t NOT IN ({stops}))"


def content(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) > 1 OR contains(t, ':')))"
