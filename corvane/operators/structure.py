"""From raw text to cleaned, located and structured blocks and units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corvane.functions.text import NUMERAL, nfkc, token_count

# What a line or block must begin with to be of a structure type.
NUMBERED = rf"(?iU)^(?:第\s*[{NUMERAL}]+\s*[条款]|(?:Article|Section|Clause)\s+[A-Za-z0-9_.-]+|\d+(?:\.\d+)+)"
HEADING = rf"(?iU)^(?:第\s*[{NUMERAL}]+\s*[编章节]|#{{1,6}}\s*|\d+(?:\.\d+)*\s+[A-Za-z\x{{3400}}-\x{{9fff}}])"
STEP = r"(?iU)^(?:步骤\s*[零〇一二三四五六七八九十0-9]+|第\s*[零〇一二三四五六七八九十0-9]+\s*步|Step\s+\d+|\d+[.)、])"
WARNING = "(?i)^(?:危险|警告|注意|重要|DANGER|WARNING|CAUTION|NOTICE)"
PREREQUISITE = "(?i)^(?:前提|准备|先决条件|Prerequisite|Before you begin)"
TROUBLESHOOTING = "(?i)^(?:故障|问题|症状|原因|解决方案|Troubleshoot|Symptom)"
PARAMETER = "(?i)^(?:参数|规格|型号|额定|默认值|取值范围|Parameter|Specification)"
EXCEPTION = "(?i)^(?:但是|但书|除非|例外|Except|Unless)"
ARTICLE = rf"(?U)^第\s*[{NUMERAL}]+\s*条"
PART = rf"(?U)^第\s*[{NUMERAL}]+\s*[编章节]"
SUB_CLAUSE = "^(?:第.+款|[（(][一二三四五六七八九十0-9]+[）)])"
SECTION_NUMBER = rf"(?U)^(第\s*[{NUMERAL}]+\s*[章节条款步]|(?:步骤|第)\s*[{NUMERAL}]+\s*(?:步)?|[（(][一二三四五六七八九十0-9]+[）)]|\d+(?:\.\d+)*[.)、])"
# Structure types by canonical profile, in order of precedence.
PROFILE_RULES = {
    "numbered_rule": [("heading", HEADING), ("numbered_clause", NUMBERED), ("exception", EXCEPTION)],
    "sectioned_manual": [("warning", WARNING), ("troubleshooting_entry", TROUBLESHOOTING), ("parameter_table", PARAMETER), ("heading", HEADING), ("procedure_step", STEP)],
    "procedure_guide": [("warning", WARNING), ("prerequisite", PREREQUISITE), ("procedure_step", STEP), ("troubleshooting_entry", TROUBLESHOOTING), ("heading", HEADING)],
    "expository": [("heading", HEADING)],
}
# Unit kinds by content profile, in order of precedence; True protects.
UNIT_RULES = {
    "manual": [
        ("warning", "(?i)^(?:警告|危险|注意|重要|WARNING|CAUTION|DANGER)", True),
        ("troubleshooting", "^(?:故障|错误|异常|问题|原因|解决方案|排查)", True),
        ("heading", r"^(?:第[一二三四五六七八九十百0-9]+[章节部分]|\d+(?:\.\d+)*\s+|#{1,6}\s*)", False),
        ("step", r"^(?:步骤\s*[一二三四五六七八九十0-9]+|第[一二三四五六七八九十0-9]+步|\d+[.)、])", True),
        ("parameter", "^(?:参数|规格|型号|额定|默认值|取值范围)", True),
    ],
    "technical_doc": [
        ("warning", "(?i)^(?:警告|危险|注意|重要|WARNING|CAUTION|DANGER|NOTE)", True),
        ("api_section", r"(?i)^(?:(?:GET|POST|PUT|PATCH|DELETE)\s+/|接口|API|端点|Endpoint)", True),
        ("heading", r"^(?:#{1,6}\s*|\d+(?:\.\d+)*\s+|第[一二三四五六七八九十百0-9]+章)", False),
        ("config", r"^[A-Za-z_][A-Za-z0-9_.-]*\s*[:=]", True),
        ("parameter", "^(?:参数|返回值|错误码|默认值|类型|必填)", True),
    ],
    "academic": [("heading", "(?i)^(?:摘要|关键词|引言|研究方法|方法|实验|结果|讨论|结论|参考文献)$", True), ("citation_list", r"^\[\d+]\s+", True)],
    "narrative": [("heading", r"(?i)^(?:第[一二三四五六七八九十百千万0-9]+章|Chapter\s+\d+)", False), ("scene_break", r"^(?:\*{3,}|-{3,}|={3,})$", True)],
    "general_prose": [],
}
# Signals of each content profile.
PROFILE_SIGNALS = {
    "regulation": ["第[一二三四五六七八九十百千万0-9]+[编章节条款]", "(?:本法|条例|规定|合同|责任|义务)"],
    "manual": ["(?:警告|注意|步骤|故障|安装|操作|维护)", "(?i)(?:WARNING|CAUTION|STEP|TROUBLESHOOT)"],
    "academic": ["(?:摘要|关键词|研究方法|实验结果|参考文献|结论)", "(?i)(?:abstract|methodology|references|conclusion)"],
    "technical_doc": [r"(?i)(?:GET|POST|PUT|PATCH|DELETE)\s+/", "(?:API|配置|参数|错误码|代码示例)"],
    "narrative": ["第[一二三四五六七八九十百千万0-9]+章", "(?:他说|她说|场景|人物|故事)"],
}
CANONICAL_PROFILE = {"regulation": "numbered_rule", "manual": "sectioned_manual", "technical_doc": "sectioned_manual"}


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """Name of the first rule whose pattern occurs in the text."""
    out = otherwise
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def canonical_profile(profile: Column) -> Column:
    out = F.lit("expository")
    for name, canonical in CANONICAL_PROFILE.items():
        out = F.when(profile == name, F.lit(canonical)).otherwise(out)
    return out


def clean_text(text: Column) -> Column:
    """NFKC, line feeds only, no control characters, single blanks, at most one empty line
    in a row, trimmed; null stays null."""
    return tidy(nfkc(text))


def tidy(text: Column) -> Column:
    """:func:`clean_text` after the normal form."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0b-\\x1f\\x7f]", "")
    x = F.regexp_replace(x, "[ \\t]+", " ")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def plain_blocks(files: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, block_no, text) of plain texts, split at empty lines; blank
    paragraphs are dropped.  ``files``: doc_id, text."""
    parts = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n\n")
    rows = files.select("doc_id", F.posexplode(parts).alias("_p", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_p")) - 1).alias("block_no"), "text")


def markdown_blocks(files: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_no, kind, heading_level, text) of Markdown texts: headings,
    fenced code (an open fence runs to the end), paragraphs.  ``files``: doc_id, text.
    A file is one row: its lines are folded inside the row, without a shuffle."""
    state = "array<struct<kind:string,level:int,lines:array<string>>>"
    start = F.struct(F.lit(False).alias("fenced"), F.lit(True).alias("fresh"), F.array().cast(state).alias("blocks"))
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")

    def block(kind: str, level: Column, *own: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), level.cast("int").alias("level"), F.array(*own).cast("array<string>").alias("lines")))

    def extended(acc: Column, line: Column) -> Column:
        n = F.size(acc["blocks"])
        last = F.element_at(acc["blocks"], n)
        grown = F.array(F.struct(last["kind"].alias("kind"), last["level"].alias("level"), F.concat(last["lines"], F.array(line)).alias("lines")))
        return F.concat(F.slice(acc["blocks"], F.lit(1), n - 1), grown)

    def step(acc: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*(?:```|~~~)")
        heading = line.rlike(r"^#{1,6}\s+\S") & ~acc["fenced"]
        blank = (F.trim(line) == "") & ~acc["fenced"]
        blocks = (
            F.when(fence & ~acc["fenced"], F.concat(acc["blocks"], block("code", F.lit(None))))
            .when(fence | blank, acc["blocks"])
            .when(acc["fenced"], extended(acc, line))
            .when(heading, F.concat(acc["blocks"], block("heading", F.length(F.regexp_extract(line, "^(#+)", 1)), F.trim(F.regexp_replace(line, r"^#+\s+|\s+#*\s*$", "")))))
            .when(acc["fresh"], F.concat(acc["blocks"], block("paragraph", F.lit(None), line)))
            .otherwise(extended(acc, line))
        )
        return F.struct(F.when(fence, ~acc["fenced"]).otherwise(acc["fenced"]).alias("fenced"), (fence | heading | blank).alias("fresh"), blocks.alias("blocks"))

    folded = F.aggregate(lines, start, step, lambda a: F.filter(a["blocks"], lambda b: F.trim(F.array_join(b["lines"], "")) != ""))
    rows = files.select("doc_id", F.posexplode(folded).alias("block_no", "b"))
    return rows.select("doc_id", "block_no", F.col("b.kind").alias("kind"), F.col("b.level").alias("heading_level"), F.array_join("b.lines", "\n").alias("text"))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Adds start_offset and end_offset of each block in its document's text, in which the
    blocks are joined by line feeds.  ``blocks``: doc_id, block_no, text; null is empty."""
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce("text", F.lit("")))
    return blocks.withColumn("start_offset", F.coalesce(F.sum(size + 1).over(w), F.lit(0)).cast("int")).withColumn("end_offset", (F.col("start_offset") + size).cast("int"))


def locate_chunks(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks that each chunk's range overlaps: (doc_id, chunk_id, blocks, first_block,
    last_block).  ``chunks``: doc_id, chunk_id, start_offset, end_offset.  The range join
    runs inside a document, on its id."""
    b = blocks.select("doc_id", "block_no", F.col("start_offset").alias("s"), F.col("end_offset").alias("e"))
    hit = chunks.select("doc_id", "chunk_id", "start_offset", "end_offset").join(b, "doc_id").where("start_offset < e AND end_offset > s")
    return hit.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("blocks"), F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"))


# Fixed value: a page number that stands by itself.
LONE_NUMBER = r"(?:^|\s)[-—]?\s*\d+\s*[-—]?(?:\s|$)"


def margin_key(line: Column) -> Column:
    """Comparison key of a page line: lower case, single blanks, lone numbers as #."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"\s+", " "))), LONE_NUMBER, " # "))


def repeated_margins(pages: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """(doc_id, key, times): short first and last two lines that recur on most pages of
    documents of at least three pages.  ``pages``: doc_id, page_number, text.  A line of
    a short page that is among both the first and the last two counts twice."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: F.trim(l)), lambda l: l != "")
    rows = pages.select("doc_id", lines.alias("lines"))
    n = F.size("lines")
    edge = F.concat(F.slice("lines", F.lit(1), F.lit(2)), F.slice("lines", F.greatest(n - 1, F.lit(1)), F.lit(2)))
    keys = rows.select("doc_id", F.explode(F.transform(edge, margin_key)).alias("key")).where("key <> '' AND length(key) <= 80")
    counted = keys.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).where(f"pages >= {least}")
    return counted.join(sizes, "doc_id").where(F.col("times") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share + 0.999))).select("doc_id", "key", "times")


# What ends a line of a page, what a line that continues none begins with,
# list marks that stand alone before their text.
_NOT_ENDED = r"(?<![。！？!?；;：:.])(?<![.!?][\"'”’）)])"
_OPENS = rf"(?:#{{1,6}}\s*|第\s*[{NUMERAL}]+\s*[章节条款步]|[（(][一二三四五六七八九十0-9]+[）)]|(?:步骤|警告|危险|注意|重要|故障|错误码|参数|规格)\s*[:：]?|\d+(?:\.\d+)*[.)、]\s*)"
_BRACKETED = r"([（(])\s*([一二三四五六七八九十0-9]+)\s*([）)])"
_CLOSING_SIGN = "[）)；;，,、。.：:]"
_BREAK = "\x01"


def reflowed(text: Column) -> Column:
    """A page text with its wrapped lines joined: blank lines go, a lone list mark stands
    before the next line and a lone closing sign behind the last.  Line ends are rewritten
    in place, so a page never leaves the JVM; null is empty.

    A line end stays where the line is finished, where the next one opens an item or has
    one character, and after the up to three characters of a line that begins a paragraph.
    """
    x = F.regexp_replace(F.coalesce(text, F.lit("")), "\x01", " ")
    x = F.regexp_replace(x, r"(?U)\s*\n\s*", "\n")
    x = strip(x)
    x = F.regexp_replace(x, rf"(?Um)^{_BRACKETED}\n", "$1$2$3")
    x = F.regexp_replace(x, r"(?Um)^([（(]|\d+[.)、])\n", "$1")
    x = F.regexp_replace(x, rf"\n({_CLOSING_SIGN})(?=\n|$)", "$1")
    # line ends that part two paragraphs, then those after the short beginning of one
    x = F.regexp_replace(x, rf"(?iU){_NOT_ENDED}\n(?!{_OPENS})(?=[^\n]{{2}})", "\x02")
    x = F.replace(x, F.lit("\n"), F.lit(_BREAK))
    x = F.regexp_replace(x, rf"(?iU)(?:^|(?<=\x01)|\G)(?!{_OPENS})([^\x01\x02]{{1,3}})\x02", "$1\x01")
    x = F.regexp_replace(x, r"(?<=[A-Za-z0-9])\x02(?=\p{ASCII})", " ")
    return F.translate(x, "\x01\x02", "\n")


# Brackets inside which no sentence ends, closing quotes, kept spans.
_OPENING = {"（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "「": "」", "『": "』"}
_CLOSING = "”’」』】）》\"'"
_KEPT = re.compile(r"(?:https?://|www\.)\S+|[\w.+%-]+@[\w.-]+\.\w{2,}|\d+(?:\.\d+)+")
_TERMINAL = re.compile(r"[。！？!?；;.（(\[【《「『）)\]】》」』]")


def sentences_of(text: str) -> list[str]:
    """Sentences of a text, with their signs.  A period ends one only at the end or before
    blanks and a capital or digit; nothing ends inside brackets, addresses or dotted
    numbers; closing quotes stay with their sentence."""
    text = text.strip()
    kept = [m.span() for m in _KEPT.finditer(text)]
    open_, out, start, at = [], [], 0, 0
    while m := _TERMINAL.search(text, at):
        i, c = m.start(), m.group()
        at = i + 1
        if c in _OPENING:
            open_.append(_OPENING[c])
            continue
        if c not in "。！？!?；;.":
            if open_ and c == open_[-1]:
                open_.pop()
            continue
        if c == ".":
            rest = text[i + 1 :]
            bare = rest.lstrip()
            if rest and (rest == bare or bare and not (bare[0].isupper() or bare[0].isdigit())):
                continue
        if open_ or any(a <= i < b for a, b in kept):
            continue
        while at < len(text) and text[at] in _CLOSING:
            at += 1
        out.append(text[start:at].strip())
        start = at
    out.append(text[start:].strip())
    return [x for x in out if x]


@F.pandas_udf(ArrayType(StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    """:func:`sentences_of` of each text; null has none."""
    return texts.map(lambda t: sentences_of(t) if t else [])


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("from", IntegerType()), StructField("to", IntegerType())])))
def _located(texts: pd.Series) -> pd.Series:
    def parts(text: str) -> list[dict]:
        out, at = [], 0
        for line in text.split("\n"):
            for part in sentences_of(line):
                begin = text.index(part, at)
                at = begin + len(part)
                out.append({"text": part, "from": begin, "to": at})
        return out

    return texts.map(lambda t: parts(t) if t else [])


def heading_paths(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, path) of heading blocks: a heading of level n keeps the first
    n - 1 headings of the path before it.  A document's headings are folded inside one row."""
    headings = blocks.where("kind = 'heading'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)).alias("level"), "text"))).alias("h"))
    path = "array<string>"
    start = F.array(F.array().cast(path))

    def step(paths: Column, h: Column) -> Column:
        kept = F.slice(F.element_at(paths, -1), F.lit(1), h["level"] - 1)
        return F.array_append(paths, F.array_append(kept, h["text"]))

    folded = headings.select("doc_id", "h", F.aggregate("h", start, step).alias("paths"))
    rows = folded.select("doc_id", F.explode(F.arrays_zip("h", F.slice("paths", F.lit(2), F.size("h")).alias("paths"))).alias("v"))
    return rows.select("doc_id", "v.h.block_no", F.col("v.paths").alias("path"))


def structured_units(blocks: DataFrame) -> DataFrame:
    """Units (doc_id, unit_no, block_no, text, kind, heading_path, section_number, protected,
    retrieval_text, token_count, source_start_offset, source_end_offset) of blocks (doc_id,
    block_no, kind, heading_level, text).

    Headings, tables and code stay whole, prose is cut into lines and sentences.  Offsets
    count characters of the document whose blocks are joined by line feeds, so the text of
    a unit stands there.  The retrieval text is the heading path, the number and the text."""
    placed = block_offsets(blocks).join(heading_paths(blocks), ["doc_id", "block_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("block_no")
    none = F.array().cast("array<string>")
    placed = placed.withColumn("heading_path", F.coalesce(F.last("path", True).over(w), none))
    whole = F.col("kind").isin("heading", "table", "code")
    one = F.array(F.struct(F.col("text"), F.lit(0).alias("from"), F.length("text").alias("to")))
    cut = placed.withColumn("u", F.explode(F.when(whole, one).otherwise(_located(F.when(~whole, F.col("text"))))))
    cut = cut.withColumn("block_kind", F.col("kind")).withColumn("text", F.col("u.text"))
    kind = F.when(whole, F.col("block_kind")).otherwise(line_kind(F.col("text"), F.col("block_kind")))
    number = section_number(F.col("text"))
    shown = F.array_join("heading_path", " > ")
    retrieval = F.when(F.col("block_kind") == "heading", shown).otherwise(F.concat_ws(" ", F.nullif(shown, F.lit("")), number, F.col("text")))
    at = Window.partitionBy("doc_id").orderBy("block_no", "u.from")
    return cut.select(
        "doc_id", (F.row_number().over(at) - 1).alias("unit_no"), "block_no", "text", kind.alias("kind"), "heading_path", number.alias("section_number"),
        (whole | kind.isin("numbered_clause", "sub_clause")).alias("protected"), retrieval.alias("retrieval_text"), token_count(F.col("text")).alias("token_count"),
        (F.col("start_offset") + F.col("u.from")).alias("source_start_offset"), (F.col("start_offset") + F.col("u.to")).alias("source_end_offset"),
    )


def profile_decision(stated: Column, predicted: Column, confidence: Column, automatic: float = 0.55, mismatch: float = 0.8) -> Column:
    """Struct (profile, method, mismatch, reason): a stated profile leads, and one predicted
    otherwise with enough confidence is a mismatch; without a stated one the prediction
    holds from ``automatic`` on, else general_prose."""
    other = F.coalesce((predicted != stated) & (confidence >= mismatch), F.lit(False))
    sure = F.coalesce(confidence >= automatic, F.lit(False))
    explicit = F.struct(stated.alias("profile"), F.lit("source_explicit").alias("method"), other.alias("mismatch"), F.when(other, "explicit_profile_mismatch").otherwise("source_explicit_profile").alias("reason"))
    chosen = F.struct(predicted.alias("profile"), F.lit("content_profiler").alias("method"), F.lit(False).alias("mismatch"), F.lit("automatic_profile_selected").alias("reason"))
    fallback = F.struct(F.lit("general_prose").alias("profile"), F.lit("fallback").alias("method"), F.lit(False).alias("mismatch"), F.lit("automatic_profile_low_confidence_fallback").alias("reason"))
    return F.when(stated.isNotNull(), explicit).when(sure, chosen).otherwise(fallback)


def adapt_blocks(blocks: DataFrame) -> DataFrame:
    """Adds structure_type, anchor, heading and boundary to blocks (doc_id, block_no, text,
    profile): the first matching rule of the canonical profile sets the type; headings
    and clauses open a boundary that later blocks keep."""
    canonical = canonical_profile(F.col("profile"))
    kind = F.lit("paragraph")
    for name, rules in PROFILE_RULES.items():
        kind = F.when(canonical == name, first_match(F.col("text"), rules, F.lit("paragraph"))).otherwise(kind)
    anchor = F.nullif(F.replace(F.regexp_extract("text", NUMBERED.replace("^(?:", "^((?:", 1) + ")", 1), F.lit(" "), F.lit("")), F.lit(""))
    typed = blocks.withColumn("structure_type", kind).withColumn("anchor", anchor)
    opens = F.when(F.col("structure_type") == "heading", F.concat(F.lit("block:"), F.col("block_no"))).when(
        F.col("structure_type").isin("numbered_clause", "procedure_step", "troubleshooting_entry"), F.coalesce("anchor", F.concat(F.lit("block:"), F.col("block_no")))
    )
    w = Window.partitionBy("doc_id").orderBy("block_no")
    heading = F.when(F.col("structure_type") == "heading", F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 256))
    return typed.withColumn("heading", F.last(heading, True).over(w)).withColumn("boundary", F.last(opens, True).over(w))


def profile_units(units: DataFrame) -> DataFrame:
    """Adds unit_kind, unit_protected, article_key to units (unit_id, document_version_id,
    unit_no, text, kind, protected, hard_boundary_key, content_profile): the first
    matching rule of the content profile relabels the unit; an article's key lasts until
    the next article or heading."""
    text = strip(F.col("text"))
    kind, protected = F.col("kind"), F.coalesce("protected", F.lit(False))
    for profile, rules in UNIT_RULES.items():
        if rules:
            mine = F.col("content_profile") == profile
            kind = F.when(mine, first_match(text, [(n, p) for n, p, _ in rules], F.col("kind"))).otherwise(kind)
            keeps = first_match(text, [(str(k), p) for _, p, k in rules], F.lit("none"))
            protected = F.when(mine & (keeps == "True"), F.lit(True)).otherwise(protected)
    law = F.col("content_profile") == "regulation"
    is_part, is_article = text.rlike(PART), text.rlike(ARTICLE)
    kind = F.when(law & is_part, "heading").when(law & is_article, "numbered_clause").when(law & text.rlike(SUB_CLAUSE), "sub_clause").otherwise(kind)
    protected = F.when(law & (is_part | is_article), F.lit(True)).otherwise(protected)
    w = Window.partitionBy("document_version_id").orderBy("unit_no", "unit_id")
    opened = F.when(is_part, F.lit("")).when(is_article, F.concat(F.lit("article:"), F.regexp_replace(F.regexp_extract(text, ARTICLE.replace("^", "^(") + ")", 1), r"\s+", "")))
    key = F.nullif(F.last(opened, True).over(w), F.lit(""))
    return units.withColumn("unit_kind", kind).withColumn("unit_protected", protected).withColumn("article_key", F.when(law, F.coalesce(key, F.col("hard_boundary_key"))).otherwise(F.col("hard_boundary_key")))


def section_number(text: Column) -> Column:
    """Leading chapter, clause, step or list number without blanks; null without one."""
    return F.nullif(F.replace(F.regexp_extract(strip(text), SECTION_NUMBER, 1), F.lit(" "), F.lit("")), F.lit(""))


def line_kind(text: Column, kind: Column) -> Column:
    """Kind of a text line: numbered_clause, heading, sub_clause or the given kind."""
    x = strip(text)
    return F.when(x.rlike(ARTICLE), "numbered_clause").when(x.rlike(rf"(?U)^第\s*[{NUMERAL}]+\s*[编章节款]"), "heading").when(x.rlike(r"^(?:[（(][一二三四五六七八九十0-9]+[）)]|\d+[.)、])"), "sub_clause").otherwise(kind)


def assess_profile(text: Column, minimum: float = 0.55) -> Column:
    """Struct (profile, confidence): the content profile with most signals, each counted up
    to three times, over the whole text; general_prose on a tie, no signal or a share
    below ``minimum``."""
    scores = [
        F.struct((-sum((F.least(F.lit(3), F.regexp_count(text, F.lit(p))) for p in patterns), F.lit(0))).alias("s"), F.lit(name).alias("p")) for name, patterns in PROFILE_SIGNALS.items()
    ]
    ordered = F.array_sort(F.array(*scores))
    total = F.aggregate(ordered, F.lit(0), lambda acc, x: acc - x["s"])
    best, second = ordered[0], ordered[1]
    confidence = (-best["s"]).cast("double") / F.greatest(total, F.lit(1))
    fallback = (best["s"] == 0) | (best["s"] == second["s"]) | (confidence < minimum)
    return F.struct(F.when(fallback, "general_prose").otherwise(best["p"]).alias("profile"), confidence.alias("confidence"))
