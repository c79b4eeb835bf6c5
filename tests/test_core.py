"""Core operators on small rows, and against plain Python."""

import math
import random
import unicodedata
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.functions import ids, text
from corvane.operators import catalog, chunking, dense, evidence, lexical, metrics, ranking, snapshots, structure
from corvane.sources import files
from corvane.streaming import ingest


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


# -- text ---------------------------------------------------------------------


@pytest.mark.parametrize(
    "numeral, value",
    [("三", 3), ("十", 10), ("十二", 12), ("二十", 20), ("一百零三", 103), ("两千零五", 2005), ("一二三", 123), ("007", 7), ("三万五千", 35000), ("万", 10000), ("3百", None), ("", None), (None, None)],
)
def test_numerals(spark, numeral, value):
    assert one(spark, text.numeral_value(F.col("t")), t=numeral) == value


def test_anchors_and_tokens(spark):
    got = one(spark, text.exact_anchors(F.col("t")), t="第 八 条 和第三章，步骤四，code vk-10a 型")
    assert got == ["clause:8", "chapter:3", "step:4", "code:vk-10a"]
    tokens = one(spark, text.lexical_tokens(text.normal(F.col("t"))), t="阀门 ＡＢＣ 什么 e-5")
    assert Counter(tokens) == Counter(["阀门", "阀门", "abc", "e-5", "code:e-5"])
    assert one(spark, text.lexical_tokens(text.normal(F.col("t"))), t="") == []
    assert one(spark, text.token_count(F.col("t")), t="ab 12_x，汉字") == 5
    assert one(spark, text.token_count(F.col("t")), t=None) == 0


def test_ids_match_python(spark):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    parts = ["租户", "v1", "0"]
    name = "|".join(f"{len(p)}:{p}" for p in parts)
    assert one(spark, ids.stable_id("chunk", space, *[F.lit(p) for p in parts]), t="x") == "chunk_" + uuid.uuid5(uuid.UUID(space), name).hex


def test_term_cosines(spark):
    df = spark.createDataFrame([(1, "阀门 ab", "阀门 ab"), (2, "阀", "门"), (3, None, "x")], "k int, a string, b string")
    assert rows(text.term_cosines(df, "k", "a", "b", 6)) == [(1, 1.0), (2, 0.0), (3, 0.0)]


# -- retrieval ------------------------------------------------------------------


def test_bm25_prefers_named_clause_and_scope(spark):
    entries = spark.createDataFrame([("a", "第八条 阀门检修", None), ("b", "第九条 阀门检修 阀门检修 阀门", None), ("c", "无关", None), ("d", None, "第八条")], "id string, text string, section_number string")
    q = spark.createDataFrame([(1, "第八条阀门"), (2, None)], "query_id int, text string")
    got = lexical.bm25(entries, q, 3).collect()
    ranked = [r["id"] for r in sorted(got, key=lambda r: r["rank"])]
    assert ranked[0] == "a" and set(ranked) == {"a", "b", "d"} and got[0]["score"] > 0
    placed = entries.withColumn("source_id", F.when(F.col("id") == "b", "s").otherwise("t"))
    scopes = spark.createDataFrame([(1, "s"), (1, "s"), (2, "t")], "query_id int, source_id string")
    assert [r["id"] for r in lexical.bm25(placed, q, 3, scopes).collect()] == ["b"]
    assert lexical.bm25(entries.limit(0), q, 3).count() == 0


def test_bm25_against_plain_python(spark):
    rng = random.Random(3)
    words = "ab cd ef gh ij".split()
    docs = {f"d{i}": " ".join(rng.choices(words, k=rng.randint(1, 9))) for i in range(12)}
    tf = {d: Counter(t.split()) for d, t in docs.items()}
    avg = sum(sum(c.values()) for c in tf.values()) / len(docs)
    want = {}
    for d, c in tf.items():
        s = 0.0
        for t in ("ab", "gh"):
            df = sum(t in x for x in tf.values())
            s += math.log(1 + (12 - df + 0.5) / (df + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) if c[t] else 0
        if s > 0:
            want[d] = s
    entries = spark.createDataFrame([(k, v, None) for k, v in docs.items()], "id string, text string, section_number string")
    got = {r["id"]: r["score"] for r in lexical.bm25(entries, spark.createDataFrame([(1, "ab gh")], "query_id int, text string"), 99).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_dense_search_ties_nulls_and_blocks(spark):
    v = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(1, 31)] + [(98, [0.0, 0.0]), (99, None)], "id bigint, embedding array<float>")
    q = v.where("id in (1, 2, 98)").select(F.col("id").alias("query_id"), "embedding")
    got = dense.dense_search(v, q, 4).collect()
    assert [r["id"] for r in sorted((r for r in got if r["query_id"] == 1), key=lambda r: r["rank"])] == [1, 4, 7, 10]
    assert {r["query_id"] for r in got} == {1, 2}
    assert dense.dense_search(v.limit(0), q, 4).count() == 0
    assert dense.dense_search(v, q.limit(0), 4).count() == 0


def test_collapsed_vectors(spark):
    v = lambda *f: spark.createDataFrame([([1.0, 2.0], x) for x in f] + [([float(i), 0.5], str(i)) for i in range(500)], "embedding array<float>, fingerprint string")
    assert dense.collapsed_vectors(v("a", "a")).first()["passed"]
    bad = dense.collapsed_vectors(v("a", "b", "c", "d")).first()
    assert not bad["passed"] and bad["largest_harmful"] == 4


def test_fusion_and_gap(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    got = ranking.reciprocal_rank_fusion(a, b).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["y", "x", "z"] and got[2]["dense_rank"] is None
    c = spark.createDataFrame([(1, i, s) for i, s in enumerate([9.0, 8.9, 8.8, 2.0, 1.9], 1)], "query_id int, rank int, score double")
    assert rows(ranking.gap_cut(c)) == [(1, 5, 3)]


def test_routing_modes(spark):
    p = spark.createDataFrame([(f"s{i}", "pump station", None, []) for i in range(5)], "source_id string, name string, description string, profile_terms array<string>")
    q = spark.createDataFrame([(1, "pump station")], "query_id int, text string")
    assert {r["mode"] for r in ranking.route_sources(q, p).collect()} == {"authorized_global"}
    p = spark.createDataFrame([("s1", "pump station", "valve", ["valve"]), ("s2", "boiler", None, None)], p.schema)
    got = {r["source_id"]: (r["mode"], r["selected"]) for r in ranking.route_sources(spark.createDataFrame([(1, "pump station valve")], "query_id int, text string"), p).collect()}
    assert got == {"s1": ("single_source", True)}
    none = ranking.route_sources(spark.createDataFrame([(1, "turbine"), (2, None)], "query_id int, text string"), p).collect()
    assert [tuple(r)[1:] for r in none] == [(None, 0.0, "authorized_global", True)] * 2


def test_greedy_selection(spark):
    c = spark.createDataFrame(
        [(1, "a1", 1, "a", "a1", 60), (1, "a2", 2, "a", "a1", 1), (1, "a3", 3, "a", "a3", 50), (1, "b1", 4, "b", "b1", 20), (1, "c1", 5, "c", None, None)],
        "query_id int, id string, rank int, document_id string, family_id string, tokens int",
    )
    got = {r["id"]: r["outcome"] for r in ranking.select_diverse(c, target=3, token_budget=100).collect()}
    assert got == {"a1": "selected", "a2": "family_seen", "a3": "token_budget", "b1": "selected", "c1": "selected"}


def test_targets_and_reserved_candidates(spark):
    # a gap at the third place, a gap beyond the first 16, many items, no plan
    scores = {1: [9.0, 8.9, 8.8, 2.0, 1.9, 1.8], 2: [9.0] * 17 + [1.0] * 3, 3: [9.0] * 20, 4: [1.0, 1.0]}
    c = spark.createDataFrame([(q, f"{q}-{i:02}", i, s) for q, x in scores.items() for i, s in enumerate(x, 1)], "query_id int, id string, rank int, score double")
    plan = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 2, 9)], "query_id int, needs int, items int")
    assert dict(map(tuple, ranking.selection_targets(c, plan).collect())) == {1: 3, 2: 5, 3: 9, 4: 2}
    plan = spark.createDataFrame([(1, 5, None)], "query_id int, needs int, items int")
    assert dict(map(tuple, ranking.selection_targets(c, plan).collect()))[1] == 5

    text = ["pump seal", "other words", "boiler valve pressure", "boiler", "lease 之日起", "pump seal"]
    c = spark.createDataFrame([(1, f"c{i}", i, "d", None, 10, t) for i, t in enumerate(text, 1)], "query_id int, id string, rank int, document_id string, family_id string, tokens int, text string")
    n = lambda *x: spark.createDataFrame([(1, k, t, a) for k, (t, a) in enumerate(x)], "query_id int, need_no int, text string, anchors array<string>")
    got = ranking.reserved_candidates(n(("boiler valve", []), ("pump seal", []), ("lease 何时开始", []), ("absent thing", []), ("pump", ["code:ab-1"])), c)
    assert {r["id"]: r["place"] for r in got.collect()} == {"c3": 0, "c1": 1, "c5": 2}
    chosen = ranking.select_diverse(c.join(got, ["query_id", "id"], "left").withColumn("target", F.lit(4))).orderBy("position").collect()
    assert [(r["id"], r["rank"]) for r in chosen] == [("c3", 3), ("c1", 1), ("c5", 5), ("c2", 2)]
    # a reserved candidate beyond the first max_k is visited; document variety is judged by rank
    far = ranking.select_diverse(c.withColumn("place", F.expr("if(id = 'c6', 0, null)")), target=2, max_k=2).collect()
    assert {r["id"] for r in far} == {"c6", "c1"}


def test_needs_of_times_and_lists(spark):
    parts = lambda t: one(spark, evidence.need_parts(F.col("t")), t=t)
    assert parts("监护从何时开始，到何时终止？") == ["监护何时开始", "监护何时终止"]
    assert parts("1. 泵的功率；2. 阀的压力") == ["泵的功率", "阀的压力"]
    assert parts("请说明\n（一）泵的功率\n（2）阀的压力。") == ["请说明", "泵的功率", "阀的压力"]
    assert parts("1. 泵的功率") == ["1. 泵的功率"] and parts("监护何时终止") == ["监护何时终止"]
    assert parts("分别说明泵的功率以及阀的压力") == ["说明泵的功率", "阀的压力"]
    assert len(parts("；".join(f"{i}. 部件{i}" for i in range(1, 20)))) == 12


def test_requested_items_and_scope(spark):
    count = lambda t: one(spark, evidence.requested_items(F.col("t")), t=t)
    assert [count(t) for t in ("列出12项原则", "哪十种备件", "两个步骤", "name 7 items", "泵的功率", "0个")] == [12, 10, 2, 7, None, None]
    scope = spark.createDataFrame([(["a", "x"], ["a", "b"]), (["x"], ["a", "b"])], "r array<string>, s array<string>").select(ranking.effective_scope(F.col("r"), F.col("s")).alias("e"))
    assert [r["e"] for r in scope.collect()] == [["a"], ["a", "b"]]
    c = spark.createDataFrame([("t", "s", "d", "v1"), ("t", "s", "d", "v2")], "tenant_id string, source_id string, document_id string, document_version_id string")
    kept = lambda *v: catalog.in_scope(c, F.lit("t"), F.array(F.lit("s")), versions=F.array(*map(F.lit, v)).cast("array<string>")).count()
    assert kept("v2") == 1 and kept() == 2


def test_expansion_kinds_and_charges(spark):
    schema = "id string, tenant_id string, source_id string, document_id string, document_version_id string, parent_chunk_id string, hard_boundary_key string, chunk_level string, text string, token_count int, previous_chunk_id string, next_chunk_id string, loaded_at timestamp"
    leaf = lambda i, p, prev, nxt: (i, "t", "s", "d", "v", p, None, "leaf", i, 10, prev, nxt, None)
    c = spark.createDataFrame(
        [leaf("a", "p", None, "b"), leaf("b", "p", "a", None), ("p", "t", "s", "d", "v", None, None, "parent", "P", 80, None, None, None), leaf("c", None, None, None), leaf("c", None, None, None)], schema
    )
    kinds = lambda most: {r["id"]: r["context_kind"] for r in ranking.expand_context(c.where("chunk_level = 'leaf'"), c, most).collect()}
    assert kinds(100) == {"a": "parent", "b": "parent", "c": "child"}
    assert kinds(50) == {"a": "local_window", "b": "local_window", "c": "child"}
    x = ranking.context_options(c.where("chunk_level = 'leaf'"), c, 100).join(spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, id string, rank int"), "id")
    taken = lambda budget: [(r["id"], r["context_kind"], r["charged"], r["kept"]) for r in ranking.charge_contexts(x, budget).orderBy("id").collect()]
    assert taken(100) == [("a", "parent", 80, True), ("b", "parent", 0, True), ("c", "child", 10, True)]
    # a parent over the budget gives way to the window, that to the hit, and that to nothing
    assert taken(50) == [("a", "local_window", 20, True), ("b", "local_window", 20, True), ("c", "child", 10, True)]
    assert taken(30) == [("a", "local_window", 20, True), ("b", "child", 10, True), ("c", None, 0, False)]
    assert ranking.charge_contexts(x.limit(0)).count() == 0


# -- ingestion ------------------------------------------------------------------


def test_cleaning(spark):
    assert one(spark, structure.clean_text(F.col("t")), t="Ａ　 b\r\n\r\n\r\n\r\nc\x07\t d ") == "A b\n\nc d"
    assert one(spark, structure.clean_text(F.col("t")), t=None) is None


def test_markdown(spark):
    doc = "# Top\nline one\nline two\n\n```\ncode # no\n\n# heading\n```\n## Sub ##\ntext\n```\nopen"
    got = [(r["kind"], r["heading_level"], r["text"]) for r in structure.markdown_blocks(spark.createDataFrame([("d", doc), ("e", None), ("f", "")], "doc_id string, text string")).orderBy("block_no").collect()]
    assert got == [("heading", 1, "Top"), ("paragraph", None, "line one\nline two"), ("code", None, "code # no\n\n# heading"), ("heading", 2, "Sub"), ("paragraph", None, "text"), ("code", None, "open")]


def test_offsets_resolve_to_block_text(spark):
    files_ = spark.createDataFrame([("d", "汉字\n\n\n\nab\n\n \n\nxyz")], "doc_id string, text string")
    blocks = structure.block_offsets(structure.plain_blocks(files_)).orderBy("block_no").collect()
    joined = "\n".join(b["text"] for b in blocks)
    assert all(joined[b["start_offset"] : b["end_offset"]] == b["text"] for b in blocks) and len(blocks) == 3


def test_line_repair(spark):
    pages = {
        "marks": ("（ 一 ）\n第一款\n\n 内容很长的一行\n继续\n。\n1.\nNew item\nwrapped line\nmore", "（一）第一款内容很长的一行继续。\n1.New item wrapped line more"),
        "short": ("ab\ncd\nefgh\nij\nkl", "ab\ncd\nefgh ij kl"),
        "opens": ("the pump runs\n步骤 2\nstops\nx\nDone!\nnext", "the pump runs\n步骤 2 stops\nx\nDone!\nnext"),
        "open mark": ("text\n1.", "text\n1."),
        "null": (None, ""),
        "empty": (" \n ", ""),
    }
    got = spark.createDataFrame([(k, v[0]) for k, v in pages.items()], "k string, t string").select("k", structure.reflowed(F.col("t")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in got} == {k: v[1] for k, v in pages.items()}


def test_short_drafts_join_a_neighbour():
    unit = lambda n, tokens, kind="step", path=("h",), key=None: chunking._Unit(n, "x", kind, path, 0, tokens, "", key, "x")
    draft = lambda *units, reason="adaptive_score_split": chunking._Draft(list(units), reason)
    merged = lambda *drafts: [[u.no for u in d.units] for d in chunking._absorb_short(list(drafts), chunking.Bounds(10, 20, 40))]
    # two short neighbouring steps merge, a pair is not extended to the right
    assert merged(draft(unit(0, 4)), draft(unit(1, 4)), draft(unit(2, 4))) == [[0, 1, 2]]
    assert merged(draft(unit(0, 4)), draft(unit(1, 4)), draft(unit(2, 14))) == [[0, 1], [2]]
    # kinds that stand apart merge with their like only
    assert merged(draft(unit(0, 4, "warning")), draft(unit(1, 4))) == [[0], [1]]
    assert merged(draft(unit(0, 4, "warning")), draft(unit(1, 4, "warning"))) == [[0, 1]]
    # hard reasons, other keys and parents, and the most tokens part drafts
    assert merged(draft(unit(0, 4), reason="max_tokens"), draft(unit(1, 4))) == [[0], [1]]
    assert merged(draft(unit(0, 4, key="a")), draft(unit(1, 4, key="b"))) == [[0], [1]]
    assert merged(draft(unit(0, 4)), draft(unit(1, 14, path=("k",)))) == [[0], [1]]
    assert merged(draft(unit(0, 4)), draft(unit(1, 38))) == [[0], [1]]
    assert chunking._absorb_short([], chunking.Bounds()) == []


def test_margins_need_three_pages(spark):
    p = spark.createDataFrame([("d", i, f"Head\nbody {i} x\nmid{i}\nother{i}\n- {i} -") for i in range(1, 4)] + [("e", 1, "Head\nx"), ("f", 1, None)], "doc_id string, page_number int, text string")
    assert rows(structure.repeated_margins(p)) == [("d", "#", 3), ("d", "body # x", 3), ("d", "head", 3)]


def test_sentences():
    s = structure.sentences_of
    assert s("第一句。第二句（含。括号）！“引文。”尾") == ["第一句。", "第二句（含。括号）！", "“引文。”", "尾"]
    assert s("See v1.2.3 now. Next one. lower stays") == ["See v1.2.3 now.", "Next one. lower stays"]
    assert s("") == [] and s("   ") == [] and len(s("句。" * 5000)) == 5000


def test_profiles_and_adapters(spark):
    assert one(spark, structure.assess_profile(F.col("t"))["profile"], t="第一条 本法规定 责任 第二条 义务 第三条") == "regulation"
    assert one(spark, structure.assess_profile(F.col("t"))["profile"], t="nothing here") == "general_prose"
    b = spark.createDataFrame([("d", 0, "第一章 总则", "regulation"), ("d", 1, "第 八 条 内容", "regulation"), ("d", 2, "续文", "regulation"), ("d", 3, None, None)], "doc_id string, block_no int, text string, profile string")
    got = structure.adapt_blocks(b).orderBy("block_no").collect()
    assert [r["structure_type"] for r in got[:3]] == ["heading", "numbered_clause", "paragraph"]
    assert got[2]["boundary"] == "第八条" and got[2]["heading"] == "第一章 总则"


def test_profile_units_article_key(spark):
    u = spark.createDataFrame(
        [("u0", "v", 0, "第一章 总则", "prose", None, "k", "regulation"), ("u1", "v", 1, "第 八 条 甲", "prose", None, None, "regulation"), ("u2", "v", 2, "乙", "prose", None, None, "regulation"), ("u3", "v", 3, "第二章 分则", "prose", None, None, "regulation"), ("m", "w", 0, "警告：热", "prose", None, None, "manual")],
        "unit_id string, document_version_id string, unit_no int, text string, kind string, protected boolean, hard_boundary_key string, content_profile string",
    )
    got = {r["unit_id"]: (r["unit_kind"], r["unit_protected"], r["article_key"]) for r in structure.profile_units(u).collect()}
    assert got == {"u0": ("heading", True, "k"), "u1": ("numbered_clause", True, "article:第八条"), "u2": ("prose", False, "article:第八条"), "u3": ("heading", True, None), "m": ("warning", True, None)}


# -- chunking ---------------------------------------------------------------------

UNITS = "document_version_id string, unit_no int, text string, kind string, heading_path array<string>, page_number int, section_number string, retrieval_text string, hard_boundary_key string"


def test_chunks_respect_boundaries_and_size(spark):
    data = [("v", i, f"第{'一二三'[i]}条 " + "甲" * 40, "numbered_clause", ["章"], 1, f"第{'一二三'[i]}条", None, f"article:{i}") for i in range(3)]
    data += [("w", 0, "长" * 95, "prose", None, None, None, None, None), ("w", 1, None, None, None, None, None, None, None)]
    got = chunking.link_chunks(chunking.chunk_units(spark.createDataFrame(data, UNITS), chunking.Bounds(5, 30, 60))).collect()
    v = sorted((r for r in got if r["document_version_id"] == "v"), key=lambda r: r["ordinal"])
    assert [r["hard_boundary_key"] for r in v] == ["article:0", "article:1", "article:2"]
    assert v[1]["previous_chunk_id"] == v[0]["id"] and v[0]["boundary_reason"] == "hard_boundary_key_change"
    assert all(r["token_count"] <= 60 for r in got)
    assert "".join(r["text"] for r in sorted((r for r in got if r["document_version_id"] == "w"), key=lambda r: r["ordinal"])).count("长") == 95


def test_chunks_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    data = [(f"v{i % 7}", i // 7, "阀门检修" * rng.randint(1, 60), rng.choice(["prose", "step", "heading"]), [str(i % 2)], 1, None, None, None) for i in range(140)]
    df = spark.createDataFrame(data, UNITS)
    assert rows(chunking.chunk_units(df).select("document_version_id", "ordinal", "text")) == rows(chunking.chunk_units(df.repartition(9)).select("document_version_id", "ordinal", "text"))


def test_parents_and_quality(spark):
    leaves = spark.createDataFrame([("v", i, 100, "k" if i < 3 else None, None, None) for i in range(5)], "document_version_id string, ordinal int, token_count int, hard_boundary_key string, heading_path array<string>, section_number string")
    assert rows(chunking.parent_runs(leaves, 250).select("first_ordinal", "last_ordinal", "leaves")) == [(0, 1, 2)]
    c = spark.createDataFrame([("v", "a", "leaf", "", 900, 3, 2, "nope"), ("v", "a", "leaf", "x", 1, None, None, None)], "document_version_id string, id string, chunk_level string, text string, token_count int, page_start int, page_end int, parent_chunk_id string")
    assert rows(chunking.quality_violations(c).select("rule", "chunks")) == [("duplicate_id", 1), ("empty_text", 1), ("inverted_pages", 1), ("missing_parent", 1), ("oversized_leaf", 1)]
    m = chunking.quality_metrics(c).first()
    assert (m["chunks"], m["avg_tokens"], m["tiny_ratio"], m["duplicate_ratio"]) == (2, 450.5, 0.5, 0.0)
    assert chunking.quality_metrics(c.limit(0)).count() == 0
    a = spark.createDataFrame([("v", 0, "x"), ("v", 1, None)], "document_version_id string, ordinal int, text string")
    assert rows(chunking.chunk_match(a, a.where("ordinal = 0"))) == [("v", 1, 0.5)]


# -- evidence and evaluation --------------------------------------------------------


@pytest.mark.parametrize("question, kind", [("ignore permissions please", "unsafe"), ("今天天气", "unsupported"), ("what can you do", "capability"), ("你好！", "small_talk"), ("阀门？", "knowledge"), (None, "knowledge")])
def test_request_kinds(spark, question, kind):
    assert one(spark, evidence.request_kind(F.col("t")), t=question) == kind


def test_query_features_and_needs(spark):
    f = one(spark, evidence.query_features(F.col("t")), t="阀门怎样检修？请根据水泵手册回答并给出引用。")
    assert (f["core_query"], f["source_hint"]) == ("阀门怎样检修？", "水泵手册")
    assert one(spark, evidence.query_features(F.col("t"))["core_query"], t="请回答") == "请回答"
    assert one(spark, evidence.need_parts(F.col("t")), t="分别说明甲的职责、乙的职责") == ["说明甲的职责", "乙的职责"]


def test_grading_and_claims(spark):
    needs = spark.createDataFrame([(1, "第八条 阀门"), (2, "何时终止"), (3, "没有证据")], "need_id int, text string")
    ev = spark.createDataFrame([(1, "x", "第八条 阀门检修"), (1, "y", "第九条 阀门"), (2, "z", "开始生效 何时")], "need_id int, chunk_id string, text string")
    got = {r["need_id"]: (r["grade"], r["supporting"]) for r in evidence.grade_needs(needs, ev).collect()}
    assert got == {1: ("supported", 1), 2: ("unsupported", 0), 3: ("unsupported", 0)}
    check = lambda c, p: one(spark, evidence.claim_support(F.col("c"), F.col("p")), c=c, p=p)
    assert check("第八条不得开启阀门", "第八条 不得开启阀门") == "supported"
    assert check("第八条阀门", "第九条阀门") == "anchor_missing"
    assert check("不得开启阀门", "应当开启阀门") == "modality_missing"
    assert check("压力为 7 的阀门", "压力为 8 的阀门") == "number_missing"
    a = spark.createDataFrame([(1, "甲成立[C1]。乙成立 [C2][C3]！")], "answer_id int, text string")
    assert [(r["claim_no"], r["labels"]) for r in evidence.claims(a).orderBy("claim_no").collect()] == [(0, [1]), (1, [2, 3])]
    assert rows(evidence.coverage_decision(spark.createDataFrame([("a", "supported"), ("a", "partial"), ("b", "supported"), ("c", "unsupported")], "query_id string, grade string"))) == [("a", "partial"), ("b", "complete"), ("c", "insufficient")]


def test_metrics(spark):
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "query_id int, id string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (3, "q", 1)], "query_id int, id string, rank int")
    got = {r["query_id"]: tuple(r)[1:] for r in metrics.ranking_metrics(truth, ranked, 2).collect()}
    assert got[1] == (1.0, 0.5, 0.5, round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6))
    assert got[2] == (0.0, 1.0, 0.0, 1.0) == got[3]
    f = spark.createDataFrame([(1, "a b b", "b b c"), (2, None, None), (3, "x", None)], "k int, l string, r string")
    assert rows(metrics.token_f1(f, "k", "l", "r")) == [(1, round(4 / 6, 6), False), (2, 1.0, True), (3, 0.0, False)]
    r = spark.createDataFrame([(True, True), (False, True), (True, None)], "should_refuse boolean, refused boolean")
    assert rows(metrics.refusal_counts(r)) == [(1, 1, 1)]
    v = lambda *x: spark.createDataFrame(list(x), "metric string, value double")
    gates = spark.createDataFrame([("recall", 0.0), ("mrr", 0.0), ("gone", 0.0)], "metric string, min_delta double")
    assert rows(metrics.compare_reports(v(("recall", 0.8), ("mrr", 0.7)), v(("recall", 0.85), ("mrr", 0.69)), gates).select("metric", "passed")) == [("gone", False), ("mrr", False), ("recall", True)]


# -- catalogue, snapshots, sources, streams -------------------------------------------


def test_catalogue(spark):
    v = spark.createDataFrame([("t", "d", "v1", 1), ("t", "d", "v2", 2), ("t", "e", "v3", None)], "tenant_id string, document_id string, id string, version_number int")
    assert rows(catalog.active_versions(v).select("id")) == [("v2",), ("v3",)]
    d = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), (None, "x", 3), ("b", None, None)], "k string, x string, at int")
    assert {(r["k"], r["x"]) for r in catalog.delivered_once(d, "k", "at").collect()} == {("a", "new"), ("b", None)}
    c = lambda *x: spark.createDataFrame(list(x), "name string, checksum string")
    assert rows(catalog.verify_artifacts(c(("a", "1"), ("b", "2"), ("c", "3")), c(("a", "1"), ("b", "9"), ("z", "0")))) == [("b", "changed"), ("c", "missing"), ("z", "unexpected")]
    m = spark.sql("select map('api_key', 's', 'note', repeat('x', 3000)) as m").select(catalog.redact(F.col("m")).alias("m")).first()["m"]
    assert list(m) == ["note"] and len(m["note"]) == 2000


MANIFEST = "index_version_id string, collection_id string, chunk_ids array<string>, child_content_hashes map<string,string>, source_document_fingerprints map<string,string>, created_at timestamp, loaded_at timestamp, seq int, value string"


def test_snapshot_changes_against_plain_python(spark):
    rng = random.Random(11)
    data, states = [], {}
    for col in range(6):
        state, docs = {}, {}
        for n in range(5):
            for _ in range(6):
                k = f"c{rng.randint(0, 12)}"
                if rng.random() < 0.3:
                    state.pop(k, None)
                else:
                    state[k] = str(rng.randint(0, 3))
                docs[f"d{rng.randint(0, 4)}"] = str(rng.randint(0, 2))
            states[col, n] = (dict(state), dict(docs))
            ids_ = list(state) + list(state)[:1]
            rng.shuffle(ids_)
            data.append((f"m{col}-{n}", f"col{col}", ids_, dict(state), dict(docs), f"2025-01-0{n + 1} 00:00:00", None, 9, "clash"))
    data.append(data[3])
    data.append(("lone", None, None, None, None, None, None, 0, None))
    rng.shuffle(data)
    df = spark.createDataFrame([(*r[:5], None, None, *r[7:], r[5]) for r in data], MANIFEST + ", at string").withColumn("created_at", F.col("at").cast("timestamp")).drop("at")
    want = set()
    for (col, n), now in states.items():
        if n:
            for kind, old, new in zip(("chunk", "document"), states[col, n - 1], now):
                want |= {(f"m{col}-{n}", kind, k, "added") for k in new.keys() - old.keys()} | {(f"m{col}-{n}", kind, k, "removed") for k in old.keys() - new.keys()}
                want |= {(f"m{col}-{n}", kind, k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}
    got = snapshots.manifest_changes(df).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert snapshots.manifest_changes(df.limit(0)).count() == 0


def test_slices_merge_like_dictionaries():
    rng = random.Random(5)
    for _ in range(200):
        sides = [{("k", str(rng.randrange(12))): rng.choice([None, b"1", b"2"]) for _ in range(rng.randrange(9))} for _ in range(2)]
        old, new = sides
        want = {(k, "added" if k not in old else "removed" if k not in new else "changed") for k in {*old, *new} if k not in old or k not in new or old[k] != new[k]}
        assert set(snapshots.changed(*(sorted(x.items()) for x in sides))) == want


def test_snapshot_ranges_do_not_matter(spark):
    rng = random.Random(6)
    have = {(c, n): {f"r{rng.randrange(30)}": rng.choice(["1", "2", None]) for _ in range(rng.randrange(20))} for c in ("a", None) for n in range(1, 6)}
    df = spark.createDataFrame([(c, n, 5, "chunk", k, v) for (c, n), x in have.items() for k, v in x.items()], "_c string, seq int, last int, record_kind string, record_id string, value string")
    numbers = spark.createDataFrame([(c, n, f"{c}{n}") for c, n in have], "c string, seq int, snap string")
    want = set()
    for (c, n), new in have.items():
        old = have.get((c, n - 1))
        if old is not None:
            want |= {(f"{c}{n}", k, "added" if k not in old else "removed" if k not in new else "changed") for k in {*old, *new} if k not in old or k not in new or old[k] != new[k]}
    for many in (0, 100 * snapshots.RANGE_RECORDS):
        got = snapshots.diff_snapshots(df, numbers, "snap", "c", many).collect()
        assert {(r["snap"], r["record_id"], r["change"]) for r in got} == want and len(got) == len(want)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿甲\r\n\r\n乙".encode())
    (tmp_path / "b.md").write_bytes("# T".encode("utf-16"))
    (tmp_path / "c.pdf").write_bytes(b"nope")
    (tmp_path / "d.txt").write_bytes(b"")
    (tmp_path / "e.exe").write_bytes(b"x")
    found = {r["filename"]: r["reject_reason"] for r in files.validate_uploads(files.scan_files(spark, str(tmp_path), "*")).select("filename", "reject_reason").collect()}
    assert found == {"a.txt": None, "b.md": None, "c.pdf": "bad_signature", "e.exe": "unsupported_type"}
    empty = spark.createDataFrame([("d.txt", "text/plain", 0, bytearray())], "filename string, media_type string, length bigint, content binary")
    assert files.validate_uploads(empty).first()["reject_reason"] == "empty"
    assert {r["filename"]: r["text"] for r in files.load_texts(files.scan_files(spark, str(tmp_path))).collect()} == {"a.txt": "甲\r\n\r\n乙", "b.md": "# T"}
    (tmp_path / "t.jsonl").write_text('{"event":"step","trace_id":"t","sequence":1,"name":"n"}\nbroken\n{"event":"end"}\n')
    assert [r["name"] for r in files.read_trace_steps(spark, str(tmp_path / "t.jsonl")).collect()] == ["n"]


def test_pdf_pages_and_ocr(spark):
    p = spark.createDataFrame([("d", 1, "long enough"), ("d", 2, ""), ("e", 1, None), ("f", 1, "long enough")], "doc_id string, page_number int, text string")
    assert rows(files.classify_pdf_pages(p).select("doc_id", "kind")) == [("d", "hybrid"), ("e", "scanned"), ("f", "text")]
    o = spark.createDataFrame([("d", 2, "seen", 0.9), ("e", 1, "dim", 0.5)], "doc_id string, page_number int, text string, confidence double")
    assert rows(files.merge_ocr(p, o).select("doc_id", "page_number", "origin")) == [("d", 1, "native"), ("d", 2, "ocr"), ("e", 1, "unresolved"), ("f", 1, "native")]


def test_stream_counts_and_drain(spark, tmp_path):
    src = spark.createDataFrame([("a", "x", "汉字 ab", "2025-01-01 00:01:00"), ("a", "x", "汉字 ab", "2025-01-01 00:01:00"), ("b", "x", "c", "2025-01-01 00:07:00")], "id string, g string, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = ingest.once_within(ingest.read_files(spark, str(tmp_path / "in"), src.schema), "id", "at", "1 hour")
    ingest.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["id"] for r in out.collect()) == ["a", "b"]
    assert rows(ingest.windowed_counts(out, "at", "g", "5 minutes", "1 hour").select("rows", "tokens")) == [(1, 1), (1, 3)]


def test_normal_form_matches_python(spark):
    samples = ["ﬁ ㎏ ½", "Ａ１", "é"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select(text.nfkc("t").alias("x"))
    assert [r["x"] for r in df.collect()] == [unicodedata.normalize("NFKC", s) for s in samples]


def test_every_query_runs_on_the_smallest_tables(spark):
    from corvane.plans import queries

    counts = defaultdict(int)
    for name in ("bm25_top30", "rrf_fusion", "parent_expansion", "adapt_blocks", "p3_found"):
        counts[name] = queries.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert all(counts.values())


# -- structure parser, gate, plans --------------------------------------------------


def test_structured_units_stand_in_their_document(spark):
    text = "### a\n\n第一句。第二句。\n第一句。\n\n# b\n\n## c\n\n```\nx = 1. Y = 2.\n```\n\n第三条 内容。"
    docs = spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc_id string, text string")
    blocks = structure.markdown_blocks(docs)
    got = structure.structured_units(blocks).orderBy("unit_no").collect()
    joined = "\n".join(r["text"] for r in blocks.orderBy("block_no").collect())
    assert all(joined[r["source_start_offset"] : r["source_end_offset"]] == r["text"] for r in got) and [r["unit_no"] for r in got] == list(range(len(got)))
    # a level is a depth of the path, whatever was skipped before
    assert [(r["text"], r["heading_path"]) for r in got][:4] == [("a", ["a"]), ("第一句。", ["a"]), ("第二句。", ["a"]), ("第一句。", ["a"])]
    assert [r["heading_path"] for r in got][4:] == [["b"], ["b", "c"], ["b", "c"], ["b", "c"]]
    assert [r["protected"] for r in got] == [True, False, False, False, True, True, True, True]
    assert got[-1]["kind"] == "numbered_clause" and got[-1]["retrieval_text"] == "b > c 第三条 第三条 内容。"


def test_profile_decisions(spark):
    rows_ = [("manual", "narrative", 0.9), ("manual", "narrative", 0.7), ("manual", None, None), (None, "narrative", 0.6), (None, "narrative", 0.3), (None, None, None)]
    df = spark.createDataFrame(rows_, "stated string, predicted string, confidence double")
    got = [tuple(r["d"])[:3] for r in df.select(structure.profile_decision(F.col("stated"), F.col("predicted"), F.col("confidence")).alias("d")).collect()]
    assert got == [("manual", "source_explicit", True), ("manual", "source_explicit", False), ("manual", "source_explicit", False), ("narrative", "content_profiler", False), ("general_prose", "fallback", False), ("general_prose", "fallback", False)]


def test_version_faults_and_warnings(spark):
    row = lambda v, n, text, tokens=30, key=None, kind="prose", profile="regulation": (v, f"{v}{n}", n, text, tokens, key, kind, profile, "leaf")
    data = [row("a", n, f"t{n}", 5) for n in range(10)] + [row("b", n, "same") for n in range(10)]
    data += [row("c", 0, "第一条 甲\n第二条 乙", key="article:第一条"), row("c", 1, "第三条 丙", kind="numbered_clause"), row("c", 2, None), row("d", 0, "目录", profile="manual", kind="step"), row("e", 0, "x", profile=None)]
    df = spark.createDataFrame(data, "document_version_id string, id string, ordinal int, text string, token_count int, hard_boundary_key string, unit_type string, content_profile string, chunk_level string")
    assert {tuple(r) for r in chunking.version_faults(df).collect()} == {("a", "all_tiny", 10), ("b", "all_duplicates", 10), ("c", "several_articles", 1), ("c", "missing_article_key", 1)}
    assert {tuple(r) for r in chunking.quality_warnings(df).collect()} == {("a", "content_profile_signal_weak"), ("b", "content_profile_signal_weak"), ("d", "possible_table_of_contents")}
    assert chunking.version_faults(df.limit(0)).count() == chunking.quality_warnings(df.limit(0)).count() == 0


def test_embeddings_lead_the_fold_only_where_all_units_have_one():
    near = [chunking._Unit(n, t, "prose", (), 0, 200, "", None, t, v) for n, t, v in ((0, "a b", (1.0, 0.0)), (1, "c d", (1.0, 0.0)), (2, "e f", (0.0, 1.0)))]
    assert chunking._similarity(near[:1], near[1]) == 1.0
    assert abs(chunking._similarity(near[:2], near[2])) < 1e-9
    mixed = [near[0], near[2]]
    assert abs(chunking._similarity(mixed, near[2]) - (0.65 + 0.35 / math.sqrt(2))) < 1e-9
    rows_ = [{"unit_no": n, "text": t, "kind": "prose", "heading_path": None, "page_number": None, "section_number": None, "hard_boundary_key": None, "retrieval_text": None, "embedding": v} for n, t, v in ((0, "a", [1.0]), (1, "b", None))]
    assert all(u.vector is None for u in chunking._pieces(rows_, 700))


def test_relations_of_propositions(spark):
    schema = "g int, no int, subject string, predicate string, object string, modality string, conditions array<string>, exceptions array<string>, temporal string, authority string"
    p = lambda no, subject="A", predicate="p", object_=None, modality="required", conditions=None, exceptions=None, temporal=None: (no, 0, subject, predicate, object_, modality, conditions, exceptions, temporal, None)
    pairs = [
        (p(1), p(1, " a ", "P"), "compatible"), (p(2), p(2, "B"), "different_scope"), (p(3), p(3, modality="prohibited"), "conflict"), (p(4, modality="permitted"), p(4, modality="prohibited"), "conflict"),
        (p(5, conditions=["x"]), p(5, conditions=["y"], modality="prohibited"), "different_scope"), (p(6, conditions=["x"]), p(6, conditions=["X"], modality="prohibited"), "conflict"),
        (p(7, temporal="start"), p(7, temporal="end"), "different_scope"), (p(8, exceptions=["e"]), p(8), "exception"), (p(9, None), p(9), "ambiguous"), (p(10, object_="o"), p(10, object_="q"), "different_scope"),
    ]
    df = spark.createDataFrame([x[:1] + (n,) + x[2:] for a, b, _ in pairs for n, x in enumerate((a, b))], schema)
    got = {r["g"]: r["relation"] for r in evidence.proposition_relations(df, "g").collect()}
    assert got == {a[0]: want for a, _, want in pairs}


def test_guards(spark, tmp_path):
    entries = spark.createDataFrame([("a", "阀门", None)], "id string, text string, section_number string")
    lexical.write_lexical_index(entries, f"{tmp_path}/i", "v1")
    assert lexical.read_lexical_index(spark, f"{tmp_path}/i", "v1").terms.count() == 1
    with pytest.raises(ValueError):
        lexical.read_lexical_index(spark, f"{tmp_path}/i", "v2")
    with pytest.raises(ValueError):
        catalog.rebuilt(entries.limit(0))
    assert catalog.rebuilt(entries.limit(0), True).count() == 0
    bad = dense.embed(entries, "id", "text", lambda texts: [[float("nan")]] * len(texts))
    with pytest.raises(Exception, match="other vectors"):
        bad.collect()
    names = {"api_KEY": "x", "n" * 70 + "a": "1", "n" * 70 + "b": "v" * 300}
    safe = spark.createDataFrame([(names,), (None,)], "m map<string,string>").select(evidence.safe_metadata(F.col("m")).alias("m")).collect()
    assert [r["m"] for r in safe] == [{"n" * 64: "v" * 256}, {}] or [r["m"] for r in safe] == [{"n" * 64: "1"}, {}]
