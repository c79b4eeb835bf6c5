"""Understanding questions, grading evidence and checking claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import content_terms, exact_anchors, nfkc, normal, spaced

# Cue words, and the patterns of requests.
ENTITIES = ["自然人", "法人", "非法人组织", "民事主体", "成年人", "未成年人", "被监护人", "监护人", "胎儿"]
TEMPORAL = {
    "start": ["出生时", "开始", "起算", "生效", "自成立时", "自登记时", "之日起"],
    "end": ["死亡时", "终止", "届满", "失效", "注销时", "清算结束", "时止"],
}
MODALITY = {
    "prohibited": ["不得", "禁止", "严禁", "不应"],
    "required": ["应当", "必须", "须", "有义务"],
    "exception": ["但是", "除外", "除非", "例外"],
    "conditional": ["如果", "若", "在下列情形", "符合条件"],
    "permitted": ["可以", "有权", "允许"],
}
ASKED_TIMES = {
    "start": ["何时开始", "什么时候开始", "起始时间", "从何时"],
    "end": ["何时终止", "什么时候终止", "终止时间", "到何时"],
}
INTENTS = {
    "troubleshooting": ["错误", "故障", "排查", "error", "fault"],
    "procedure": ["步骤", "操作", "如何", "how to", "procedure"],
    "exception": ["例外", "除外", "exception"],
    "condition": ["条件", "前提", "when", "condition"],
    "parameter": ["参数", "规格", "parameter", "specification"],
    "rule": ["原则", "应当", "不得", "必须", "rule", "must"],
    "definition": ["是什么", "定义", "what is", "define"],
}
UNSAFE = r"(?i)\b(?:steal|exfiltrate|bypass access|reveal api key|ignore permissions)\b|窃取|绕过权限|泄露密钥|忽略权限"
UNSUPPORTED = r"(?i)\b(?:latest news|stock price|weather|browse the web|internet search)\b|最新新闻|股价|天气|搜索互联网|联网搜索"
CAPABILITY = r"(?i)\b(?:what can you do|your capabilities|how do you work)\b|你(?:能做什么|有什么功能)"
SMALL_TALK = r"(?i)^(?:hi|hello|hey|thanks|thank you|你好|谢谢)[!,.，。！\s]*$"
NAMED_SOURCE = r"(?i)(?:请|请问|请你)?(?:根据|依据)([\x{3400}-\x{9fff}A-Za-z0-9_.-]{2,40})(?:回答|作答|说明)(?:并)?(?:给出|附上|标注)?(?:原文)?(?:引用|依据|页码)?[。.!！]?$"
FORMAT_PHRASE = r"(?i)(?:请|请问|请你)?(?:根据|依据)(?:本|上述)?(?:文档|资料|说明书|手册)|请(?:回答|说明|列出|分别列出|给出)|给出(?:原文)?引用|标注页码|附上依据|according to (?:the )?(?:document|manual)|please (?:answer|explain|list|cite)"


def any_of(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out |= text.contains(cue)
    return out


def first_of(text: Column, table: dict[str, list[str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, cues in reversed(table.items()):
        out = F.when(any_of(text, cues), F.lit(name)).otherwise(out)
    return out


def all_of(text: Column, table: dict[str, list[str]]) -> Column:
    """Sorted names whose cues occur."""
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(text, cues), F.lit(name)) for name, cues in table.items()])))


def entities(text: Column) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(text.contains(e), F.lit(e)) for e in ENTITIES])))


def numbers(text: Column) -> Column:
    """Distinct numbers that no letter precedes, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])\d+(?:\.\d+)?"), F.lit(0))))


def request_kind(text: Column) -> Column:
    """unsafe, unsupported, capability, small_talk or knowledge, in that order."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t.rlike(UNSAFE), "unsafe").when(t.rlike(UNSUPPORTED), "unsupported").when(t.rlike(CAPABILITY), "capability").when(t.rlike(SMALL_TALK), "small_talk").otherwise("knowledge")


def intent(text: Column) -> Column:
    return first_of(F.lower(text), INTENTS, "fact")


def query_features(text: Column) -> Column:
    """Struct (core_query, source_hint): the question without the closing instruction that
    names a source, and without format phrases; the whole text if nothing is left."""
    plain = spaced(text)
    hint = F.nullif(F.regexp_extract(plain, NAMED_SOURCE, 1), F.lit(""))
    core = F.regexp_replace(F.regexp_replace(plain, NAMED_SOURCE, ""), FORMAT_PHRASE, " ")
    core = F.regexp_replace(spaced(core), "^[ ，,;；。]+|[ ，,;；。]+$", "")
    return F.struct(F.coalesce(F.nullif(core, F.lit("")), F.trim(text)).alias("core_query"), hint.alias("source_hint"))


def requested_items(text: Column) -> Column:
    """The number of items a question asks for, 1 to 50; null if it names none."""
    arabic = F.regexp_extract(text, r"(?i)(?<!\d)(\d{1,2})\s*(?:项|个|种|steps?|items?)", 1)
    chinese = F.regexp_extract(text, r"([一二两三四五六七八九十])\s*(?:项|个|种|步|条)", 1)
    value = F.when(arabic != "", F.least(arabic.try_cast("int"), F.lit(50))).when(chinese != "", F.when(chinese == "十", 10).otherwise(F.translate(chinese, "一二两三四五六七八九", "1223456789").try_cast("int")))
    return F.nullif(value, F.lit(0))


def need_parts(text: Column) -> Column:
    """Separate parts of a question: the beginning and the end of a time, the items of a
    numbered list, or what it asks for "respectively", each of two or more characters; else
    the question itself."""
    pair = r"(?s)^(.+?)从?何时开始[、，,；;和与及]*到?何时终止"
    marker = r"(?:^|[\n；;])\s*(?:\d+[.)、]|[（(]期?[0-9一-九]+[）)])\s*"
    subject = F.regexp_replace(F.regexp_extract(text, pair, 1), "^[ ，,;；。？?]+|[ ，,;；。？?]+$", "")
    items = F.filter(F.transform(F.split(text, marker), lambda p: F.regexp_replace(p, "^[ ，,;；。]+|[ ，,;；。]+$", "")), lambda p: F.length(p) >= 2)
    tail = F.element_at(F.split(text, "(?i)分别|respectively", 2), -1)
    strip = lambda p: F.regexp_replace(p, "^[ ，,;；。？?]+|[ ，,;；。？?]+$", "")
    parts = F.filter(F.transform(F.split(tail, "(?i)[、，,；;]|以及|和|与|及|\\band\\b"), strip), lambda p: F.length(p) >= 2)
    split = text.rlike("(?i)分别|respectively") & (F.size(parts) > 1)
    either = F.when(text.rlike(pair), F.array(F.concat(subject, F.lit("何时开始")), F.concat(subject, F.lit("何时终止"))))
    # a list of one item, or a mark alone, is no list
    either = either.when(text.rlike(marker), F.when(F.size(items) > 1, items).otherwise(F.array(text))).when(split, parts).otherwise(F.array(text))
    return F.slice(either, 1, 12)


def grade_needs(needs: DataFrame, evidence: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(need_id, grade, coverage, supporting): ``needs`` (need_id, text) against their
    ``evidence`` (need_id, chunk_id, text).  A passage counts if it shares terms, names
    all locators and has all asked time roles; supported when one covers ``threshold``
    of the terms."""
    n = needs.select("need_id", content_terms(normal(F.col("text"))).alias("terms"), exact_anchors(normal(F.col("text"))).alias("anchors"), all_of(F.col("text"), ASKED_TIMES).alias("times"))
    e = evidence.select("need_id", "chunk_id", content_terms(normal(F.col("text"))).alias("e_terms"), exact_anchors(normal(F.col("text"))).alias("e_anchors"), all_of(F.col("text"), TEMPORAL).alias("e_times"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("terms", "e_terms")).cast("double"), F.size("terms")), F.lit(0.0))
    fits = (F.size(F.array_except("anchors", "e_anchors")) == 0) & (F.size(F.array_except("times", "e_times")) == 0)
    rows = n.join(e, "need_id", "left").withColumn("share", F.when(fits, F.coalesce(share, F.lit(0.0))).otherwise(0.0))
    graded = rows.groupBy("need_id").agg(F.round(F.max("share"), 6).alias("coverage"), F.sum((F.col("share") >= threshold).cast("long")).alias("supporting"))
    grade = F.when(F.col("supporting") > 0, "supported").when(F.col("coverage") > 0, "partial").otherwise("unsupported")
    return graded.select("need_id", grade.alias("grade"), "coverage", "supporting")


def coverage_decision(grades: DataFrame) -> DataFrame:
    """(query_id, decision): ``grades``: query_id, grade."""
    rows = grades.groupBy("query_id").agg(F.count("*").alias("n"), F.sum((F.col("grade") == "supported").cast("int")).alias("s"), F.sum((F.col("grade") == "partial").cast("int")).alias("p"))
    return rows.select("query_id", F.when(F.col("s") == F.col("n"), "complete").when((F.col("s") > 0) | (F.col("p") > 0), "partial").otherwise("insufficient").alias("decision"))


def claims(answers: DataFrame) -> DataFrame:
    """(answer_id, claim_no, claim, labels): sentences of answers (answer_id, text) and the
    numbers of their [Cn] labels."""
    parts = F.filter(F.split("text", r"(?<=[。！？!?])\s*|(?<=[.])\s+"), lambda p: F.trim(p) != "")
    rows = answers.select("answer_id", F.posexplode(parts).alias("claim_no", "claim"))
    return rows.withColumn("labels", F.transform(F.regexp_extract_all("claim", F.lit(r"\[C(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int")))


def claim_support(claim: Column, passage: Column, least: float = 0.15) -> Column:
    """First reason against a claim's support by a passage, else ``supported``: locators,
    times, modality, entities and numbers must all occur, terms overlap by ``least``."""
    within = lambda f: F.size(F.array_except(f(claim), f(passage))) == 0
    terms = content_terms(normal(claim))
    overlap = F.coalesce(F.try_divide(F.size(F.array_intersect(terms, content_terms(normal(passage)))).cast("double"), F.size(terms)), F.lit(0.0))
    return (
        F.when(~within(lambda t: exact_anchors(normal(t))), "anchor_missing")
        .when(~within(lambda t: all_of(t, TEMPORAL)), "time_role_missing")
        .when(~within(lambda t: all_of(t, MODALITY)), "modality_missing")
        .when(~within(entities), "entity_missing")
        .when(~within(numbers), "number_missing")
        .when(overlap < least, "overlap_too_low")
        .otherwise("supported")
    )


def propositions(texts: DataFrame) -> DataFrame:
    """(id, sentence_no, sentence, subject, modality, temporal): sentences of texts (id, text)
    with their first entity, leading modality and time roles."""
    rows = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^。！？!?；;\n]+[。！？!?；;]?"), F.lit(0))).alias("sentence_no", "sentence")).withColumn("sentence", F.trim("sentence")).where("sentence <> ''")
    subject = F.lit(None).cast("string")
    for e in reversed(ENTITIES):
        subject = F.when(F.col("sentence").contains(e), F.lit(e)).otherwise(subject)
    s = F.col("sentence")
    return rows.select("id", "sentence_no", "sentence", subject.alias("subject"), first_of(s, MODALITY, "fact").alias("modality"), F.array_join(all_of(s, TEMPORAL), ",").alias("temporal"))


def rewrite_drift(left: Column, right: Column) -> Column:
    """1 - Jaccard similarity of the content terms; 0 for two texts without terms."""
    a, b = content_terms(normal(left)), content_terms(normal(right))
    return F.coalesce(1.0 - F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def verify_citations(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """(answer_id, verdict): the first fault of an answer (answer_id, text) against its evidence
    (answer_id, label, text, allowed, live): no_citation, unknown_label, then by claim
    uncited_claim, not_authorised, not_live, unsupported; valid when there is none.
    Claims without content terms are passed over."""
    stated = claims(answers).withColumn("terms", F.size(content_terms(normal(F.col("claim"))))).withColumn("labels", F.array_distinct("labels"))
    split = stated.select("answer_id", "claim_no", "claim", "terms", F.explode_outer("labels").alias("label"))
    seen = split.join(cited.select("answer_id", "label", F.col("text").alias("passage"), "allowed", "live"), ["answer_id", "label"], "left")
    by_claim = seen.groupBy("answer_id", "claim_no", "claim", "terms").agg(
        F.count("label").alias("labels"), F.count_if(F.col("label").isNotNull() & F.col("passage").isNull()).alias("unknown"), F.count_if(~F.coalesce("allowed", F.lit(True))).alias("closed"),
        F.count_if(~F.coalesce("live", F.lit(True))).alias("dead"), F.array_join(F.array_sort(F.collect_list("passage")), "\n").alias("passage"),
    )
    fault = F.when(F.col("labels") == 0, "uncited_claim").when(F.col("closed") > 0, "not_authorised").when(F.col("dead") > 0, "not_live").when(claim_support(F.col("claim"), F.col("passage")) != "supported", "unsupported")
    judged = by_claim.withColumn("fault", F.when(F.col("terms") > 0, fault))
    total = judged.groupBy("answer_id").agg(F.sum("labels").alias("labels"), F.sum("unknown").alias("unknown"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("claim_no"))).alias("fault"))
    verdict = F.when(F.coalesce("labels", F.lit(0)) == 0, "no_citation").when(F.col("unknown") > 0, "unknown_label").otherwise(F.coalesce("fault", F.lit("valid")))
    return answers.select("answer_id").join(total, "answer_id", "left").select("answer_id", verdict.alias("verdict"))


def support_excerpt(passage: Column, terms: Column, most: int = 280) -> Column:
    """The window of at most ``most`` characters, opened a third before a term's first place,
    that holds most terms (the earliest on ties); marks show what is cut off."""
    text = F.regexp_replace(passage, r"\s+", " ")
    starts = F.array_sort(F.array_distinct(F.transform(F.filter(terms, lambda t: F.contains(F.lower(text), t)), lambda t: F.greatest(F.lit(1), F.position(t, F.lower(text)) - most // 3))))
    scored = F.transform(F.when(F.size(starts) > 0, starts).otherwise(F.array(F.lit(1))), lambda s: F.struct((-F.size(F.filter(terms, lambda t: F.contains(F.lower(F.substring(text, s, F.lit(most))), t)))).alias("m"), s.alias("s")))
    best = F.array_min(scored)["s"]
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(best > 1, "…").otherwise(""), F.substring(text, best, F.lit(most)), F.when(best + most <= F.length(text), "…").otherwise("")))


def context_blocks(contexts: DataFrame) -> DataFrame:
    """(query_id, blocks, context): kept contexts (query_id, rank, text, kept) labelled [C1]..
    in order and joined; a selection's few rows per query."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = contexts.where("kept").withColumn("n", n).select("query_id", F.struct("n", F.concat(F.lit("[C"), F.col("n"), F.lit("]\n"), F.col("text")).alias("t")).alias("b"))
    return rows.groupBy("query_id").agg(F.count("*").alias("blocks"), F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n\n").alias("context"))


def normalized_query(text: Column) -> Column:
    """Compatibility form of a question with single blanks, and its locators behind it."""
    plain = spaced(nfkc(text))
    return F.trim(F.concat_ws(" ", plain, F.array_join(exact_anchors(plain), " ")))


# Cues of the form, language and citation an answer is asked for in.
FORMATS = {"table": ["表格", "table"], "steps": ["步骤", "step"], "list": ["分别", "列出", "list"]}
CITATION_CUES = ["引用", "依据", "页码", "cite"]


def response_contract(text: Column) -> Column:
    """Struct (format, language, citations, items) of how a question wants its answer."""
    low = F.lower(text)
    language = F.when(text.contains("用英文") | low.contains("in english"), "en").when(text.contains("用中文") | low.contains("in chinese"), "zh-CN")
    return F.struct(first_of(low, FORMATS, "auto").alias("format"), language.alias("language"), any_of(low, CITATION_CUES).alias("citations"), requested_items(text).alias("items"))


def typed_anchors(text: Column, most: int = 32) -> Column:
    """The first ``most`` locators of a question as structs (anchor, kind)."""
    kind = lambda a: F.when(a.rlike("^(?:clause|chapter|step):"), "structure_id").otherwise("error_code")
    return F.transform(F.slice(exact_anchors(text), 1, most), lambda a: F.struct(a.alias("anchor"), kind(a).alias("kind")))


def planning_key(text: Column, version: str) -> Column:
    """Cache key of a question's plan under a planner version."""
    return F.sha2(F.concat(F.lit(version), F.lit("\0"), text), 256)


#: Pairs of modalities that exclude each other.
OPPOSITES = [("prohibited", "required"), ("permitted", "prohibited")]


def proposition_relations(propositions: DataFrame, group: str) -> DataFrame:
    """(group, left_no, right_no, relation) of the propositions of one group, each pair
    once.  ``propositions``: group, no, subject, predicate, object, modality, conditions,
    exceptions (arrays), temporal, authority.  What is null is unknown and excludes
    nothing; texts are compared without regard to case and blanks.  Pairs are made inside a
    group, such as the sentences of a passage."""
    fold = lambda c: F.lower(spaced(c))
    names = ["no", "subject", "predicate", "object", "modality", "conditions", "exceptions", "temporal", "authority"]
    a = propositions.select(group, *[F.col(n).alias(f"a_{n}") for n in names])
    b = propositions.select(group, *[F.col(n).alias(f"b_{n}") for n in names])
    pairs = a.join(b, group).where("a_no < b_no")
    both = lambda n: F.col(f"a_{n}").isNotNull() & F.col(f"b_{n}").isNotNull()
    differ = lambda n: F.coalesce(both(n) & (fold(F.col(f"a_{n}")) != fold(F.col(f"b_{n}"))), F.lit(False))
    filled = lambda n: (F.coalesce(F.size(f"a_{n}"), F.lit(0)) > 0, F.coalesce(F.size(f"b_{n}"), F.lit(0)) > 0)
    known = both("subject") & both("predicate")
    other_core = known & (differ("subject") | differ("predicate") | differ("object"))
    apart = filled("conditions")[0] & filled("conditions")[1] & ~F.arrays_overlap(F.transform("a_conditions", fold), F.transform("b_conditions", fold))
    other_scope = F.coalesce(apart, F.lit(False)) | differ("temporal") | differ("authority")
    pair = F.array_sort(F.array("a_modality", "b_modality"))
    opposite = F.lit(False)
    for x, y in OPPOSITES:
        opposite |= pair == F.array(F.lit(x), F.lit(y))
    relation = (
        F.when(filled("exceptions")[0] | filled("exceptions")[1], "exception").when(other_core | other_scope, "different_scope").when(F.coalesce(opposite, F.lit(False)), "conflict").when(~known, "ambiguous").otherwise("compatible")
    )
    return pairs.select(group, F.col("a_no").alias("left_no"), F.col("b_no").alias("right_no"), relation.alias("relation"))


def sufficiency(grades: DataFrame) -> DataFrame:
    """(query_id, coverage, missing): mean coverage of a query's needs and the needs that
    nothing supports, sorted.  ``grades``: query_id, need_id, coverage, supporting."""
    missing = F.array_sort(F.collect_list(F.when(F.col("supporting") == 0, F.col("need_id"))))
    return grades.groupBy("query_id").agg(F.round(F.avg("coverage"), 6).alias("coverage"), missing.alias("missing"))


# Fixed value: what looks like a secret in a log line.
SECRET = r"(?i)(api[_-]?key|authorization|bearer|password|secret)([\"'=:\s]+)([^\s,;\"']+)"


def redacted_line(text: Column) -> Column:
    """A log line with the values of its secrets blotted out."""
    return F.regexp_replace(text, SECRET, "$1$2[REDACTED]")


def safe_metadata(metadata: Column) -> Column:
    """Metadata without names that contain key or token; names are cut at 64 characters and
    values at 256, of names that become equal the last stays; null is empty."""
    kept = F.map_filter(metadata, lambda k, _: ~F.lower(k).contains("key") & ~F.lower(k).contains("token"))
    entries = F.transform(F.map_entries(kept), lambda e: F.struct(F.substring(e["key"], 1, 64).alias("key"), F.substring(e["value"], 1, 256).alias("value")))
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"])) == 0)
    return F.coalesce(F.map_from_entries(last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
