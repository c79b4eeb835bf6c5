"""Text expressions: normal forms, tokens, anchors and numerals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Question and connective words that carry no content.
STOP_TERMS = ["什么", "哪些", "如何", "怎么", "是否", "根据", "依据", "回答", "引用", "请问", "以及", "其中", "一个", "这个"]
# Patterns of tokens and locators.
CJK_RUN = r"[\x{3400}-\x{9fff}]+"
LATIN_TOKEN = r"[A-Za-z0-9_][A-Za-z0-9_.-]*"
TOKEN = r"(?U)[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+|[^\s]"
NUMERAL = "零〇一二两三四五六七八九十百千万亿0-9"
CLAUSE = rf"(?U)第\s*([{NUMERAL}]+)\s*条"
CHAPTER = rf"(?U)第\s*([{NUMERAL}]+)\s*章"
STEP = rf"(?U)步骤\s*[{NUMERAL}]+|第\s*[{NUMERAL}]+\s*步"
CODE = r"(?U)\b(?=[A-Za-z0-9_.-]*\d)[A-Za-z][A-Za-z0-9_.-]{2,}\b"
CANONICAL = r"(?Ui)\b(?:clause|chapter|step):\d+\b|\bcode:[a-z][a-z0-9_.-]{2,}\b"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


# full-width signs and the ideographic blank, which are their ASCII sign whatever follows
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
# characters that are their own compatibility form beside each other: none combines
_STEADY = r"[\x{0}-\x{7f}\x{c0}-\x{131}\x{134}-\x{13e}\x{141}-\x{148}\x{14a}-\x{17e}\x{2013}-\x{2016}\x{2018}-\x{201f}\x{3001}-\x{3029}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"


def nfkc(text: Column | str) -> Column:
    """Compatibility composition of a text; null stays null.  Texts whose characters are
    all steady or full-width are done in the JVM, only the others go to Python."""
    text = F.col(text) if isinstance(text, str) else text
    narrow = F.translate(text, _WIDE, _NARROW)
    steady = narrow.rlike(f"^{_STEADY}*$")
    return F.when(steady, narrow).otherwise(_composed(F.when(~steady, text)))


def normal(text: Column) -> Column:
    """Normal form for matching: NFKC, lower case."""
    return F.lower(nfkc(text))


def token_count(text: Column) -> Column:
    """Estimated tokens: CJK characters, word runs and other signs; null counts 0."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))


def numeral_value(value: Column) -> Column:
    """Value of a Chinese or Arabic numeral; null for anything else.

    Plain digit strings are read by place, otherwise tens, hundreds, thousands and
    the large units are summed; a unit without a digit before it counts once.
    """
    value = F.trim(value)
    digits = F.translate(value, "零〇一二两三四五六七八九", "001223456789")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("number"), F.lit(True).alias("ok"))

    def at_least_one(x: Column) -> Column:
        return F.when(x == 0, F.lit(1).cast("long")).otherwise(x)

    def step(acc: Column, c: Column) -> Column:
        digit = F.when(c.rlike("^[零〇一二两三四五六七八九]$"), F.translate(c, "零〇一二两三四五六七八九", "001223456789").cast("long"))
        small = F.when(c == "十", 10).when(c == "百", 100).when(c == "千", 1000).cast("long")
        large = F.when(c == "万", 10_000).when(c == "亿", 100_000_000).cast("long")
        return F.struct(
            F.when(large.isNotNull(), acc["total"] + at_least_one(acc["section"] + acc["number"]) * large).otherwise(acc["total"]).alias("total"),
            F.when(small.isNotNull(), acc["section"] + at_least_one(acc["number"]) * small).when(large.isNotNull(), F.lit(0).cast("long")).otherwise(acc["section"]).alias("section"),
            F.when(digit.isNotNull(), digit).when(small.isNotNull() | large.isNotNull(), F.lit(0).cast("long")).otherwise(acc["number"]).alias("number"),
            (acc["ok"] & (digit.isNotNull() | small.isNotNull() | large.isNotNull())).alias("ok"),
        )

    folded = F.aggregate(F.split(value, ""), zero, step, lambda a: F.when(a["ok"], a["total"] + a["section"] + a["number"]))
    return F.when(digits.rlike("^[0-9]{1,18}$") & (value.rlike("^[0-9]+$") | ~value.rlike("[0-9]")), digits.try_cast("long")).when(F.length(value) > 0, folded)


def exact_anchors(text: Column) -> Column:
    """Canonical locators of a text: stated ones, clauses, chapters, steps and codes that
    contain a digit; distinct, in that order."""

    def numbered(kind: str, pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        number = lambda x: numeral_value(F.regexp_extract(x, f"([{NUMERAL}]+)", 1))
        return F.transform(found, lambda x: F.concat(F.lit(kind), number(x).cast("string")))

    stated = F.transform(F.regexp_extract_all(text, F.lit(CANONICAL), F.lit(0)), F.lower)
    codes = F.transform(F.regexp_extract_all(text, F.lit(CODE), F.lit(0)), lambda x: F.concat(F.lit("code:"), F.lower(x)))
    return F.array_distinct(F.array_compact(F.concat(stated, numbered("clause:", CLAUSE, 1), numbered("chapter:", CHAPTER, 1), numbered("step:", STEP, 0), codes)))


def lexical_tokens(normalized: Column) -> Column:
    """Index terms of a :func:`normal` text, repeated as often as they occur: anchors,
    bigrams of CJK runs with runs of up to eight characters whole, Latin words."""
    runs = F.regexp_extract_all(normalized, F.lit(CJK_RUN), F.lit(0))

    def grams(run: Column) -> Column:
        bigrams = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        whole = F.when(F.length(run) <= 8, F.array(run)).otherwise(F.array().cast("array<string>"))
        return F.when(F.length(run) == 1, F.array(run)).otherwise(F.concat(bigrams, whole))

    terms = F.concat(exact_anchors(normalized), F.flatten(F.transform(runs, grams)), F.regexp_extract_all(normalized, F.lit(LATIN_TOKEN), F.lit(0)))
    return F.filter(terms, lambda t: (t != "") & ~t.isin(*STOP_TERMS))


def content_terms(normalized: Column) -> Column:
    """Distinct terms of more than one character, or locators."""
    return F.array_distinct(F.filter(lexical_tokens(normalized), lambda t: (F.length(t) > 1) | t.contains(":")))


def term_cosines(rows: DataFrame, key: str, left: str, right: str, places: int) -> DataFrame:
    """(key, similarity): cosine of the term counts of two texts per row (CJK characters,
    ASCII words of two or more characters, lower case); 0 when a text has no term.  Terms
    are counted inside each row before anything is shuffled."""
    terms = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)
    side = lambda c, x, y: rows.select(key, F.explode(terms(c)).alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    counts = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(key, "t").agg(F.sum("x").cast("double").alias("x"), F.sum("y").cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = counts.groupBy(key).agg(F.sum(x * y).alias("dot"), (F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("norm"))
    return rows.select(key).join(sums, key, "left").select(key, F.round(F.coalesce(F.try_divide(F.col("dot"), F.col("norm")), F.lit(0.0)), places).alias("similarity"))


def spaced(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
