"""Training-data operators against brute force, round trips and held-out rows."""

import random
import re
import unicodedata
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import canonical, leakage, mixing, near_duplicates, quality, queries, scanned, splitting, tokens

TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9_]+|[^\s]")
TEXTS = st.text(st.sampled_from("ab1_ 汉字，.\n　-é𠀀"), max_size=60)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- tokens -----------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_tokens_are_those_of_the_pattern(texts):
    batch = tokens.tokenize(texts)
    for i, t in enumerate(texts):
        a, b = batch.offsets[i], batch.offsets[i + 1]
        assert [t[s:e] for s, e in zip(batch.starts[a:b], batch.ends[a:b])] == TOKEN.findall(t)
    flat = [w for t in texts for w in TOKEN.findall(t)]
    assert len(set(zip(flat, batch.hashes.tolist()))) == len(set(flat)) == len(set(batch.hashes.tolist()))


def test_shingles_stay_inside_their_text():
    batch = tokens.tokenize(["a b c", None, "a b", "b c a b c"])
    hashes, bounds = tokens.shingle_hashes(batch, 3)
    assert bounds.tolist() == [0, 1, 1, 1, 4] and hashes[0] == hashes[3]


# -- p1 ----------------------------------------------------------------------------


CANON = canonical.canonicalizer(canonical.unstable_pattern())


@pytest.mark.parametrize(
    "a, b",
    [("ＡＢ１２", "AB12"), ("é", "é"), ("a​b﻿", "ab"), ("a b", "a b"), ("　x ", "x"), ("Ѕсаn", "Scan"), ("ﬁx", "fix"), ("㎜", "mm"), ("℃", "°C"), ("⻋", "车"), ("⼀", "一"), ("不", "不"), ("｡", "。"), ("push‑button", "push-button"), ("µm", "μm"), ("Ω", "Ω"), ("", ""), ("　​", "")],
)
def test_alike_texts_get_one_form(a, b):
    assert CANON(a) == CANON(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("e", "é"), ("2", "²"), ("1", "①"), ("电", "電"), ("ab", "a b"), ("a\nb", "a b")])
def test_different_texts_stay_apart(a, b):
    assert CANON(a) != CANON(b)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aȩ́́̈ǖ각각Åｱﾞ⼀ﬁ​　аа² \n"), max_size=30))
def test_splicing_equals_normalising_the_whole(t):
    whole = unicodedata.normalize("NFC", "".join(canonical._one(c) for c in canonical._nothing().sub("", t))).strip()
    assert CANON(t) == CANON(CANON(t))
    assert unicodedata.normalize("NFC", CANON(t)) == whole


def test_alike_pairs(spark):
    data = [("d1", "u1", "AB"), ("d1", "u1", "AB"), ("d1", "u2", "ＡＢ"), ("d1", "u3", "AB"), ("d2", "u4", "Ａ B"), ("d1", None, "AB"), ("d1", "u5", None), ("d1", "u6", ""), ("d1", "u7", " "), (None, "u8", "x"), (None, "u9", "х")]
    df = spark.createDataFrame([(*r, "clash") for r in data], "scope string, id string, text string, looks string")
    assert rows(canonical.alike_pairs(df, ["scope"]).select("id_a", "id_b")) == [("u1", "u2"), ("u2", "u3"), ("u6", "u7"), ("u8", "u9")]
    assert canonical.alike_pairs(df.limit(0), ["scope"]).count() == 0


def test_a_hot_text_is_not_paired_with_itself(spark):
    df = spark.range(20000).select(F.lit("d").alias("scope"), F.col("id").cast("string").alias("id"), F.when(F.col("id") == 7, "ｘ").otherwise("x").alias("text"))
    assert canonical.alike_pairs(df, ["scope"]).count() == 19999


# -- p2 ----------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab 汉，。\n#1."), max_size=300), st.integers(1, 30), st.integers(0, 40))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    total = len(TOKEN.findall(text))
    if total <= limit:
        assert pieces == [(0, len(text), total)]
        return
    overlap = min(overlap, limit - 1)
    spans = [m.span() for m in TOKEN.finditer(text)]
    at = 0
    assert len(pieces) > 1
    for k, (a, b, n) in enumerate(pieces):
        inside = [i for i, (s, e) in enumerate(spans) if a <= s and e <= b]
        assert n == len(inside) <= limit
        first = max(0, at - overlap) if k else 0
        assert inside[0] == first and inside[-1] >= at
        at = inside[-1] + 1
    assert at == total


def test_pieces_end_at_sentences_and_sections():
    text = "# 甲\n第一句话在这里。第二句话在这里。\n# 乙\n第三句话在这里。"
    cut = splitting.split_text(text, 14, 0)
    assert all(text[a:b].endswith("。") for a, b, _ in cut)
    assert any(text[a:b].startswith("# 乙") for a, b, _ in cut)


def test_pieces_follow_the_tree():
    shown = lambda text, limit: [text[a:b] for a, b, _ in splitting.split_text(text, limit, 0)]
    # a subsection stays with its section, not with the one before
    text = "# 甲\n一一一一\n## 乙\n二二二二\n# 丙\n三三三三\n"
    assert shown(text, 15) == ["# 甲\n一一一一\n## 乙\n二二二二", "# 丙\n三三三三"]
    # what an opened section leaves is not merged with the next section
    assert shown("# 甲\n一一一一一。二二。\n# 丙\n三\n", 8) == ["# 甲\n一一一一一。", "二二。", "# 丙\n三"]
    # list items stay with the items nested below them
    assert shown("- a b\n  - c\n- d e f\n  - g h\n", 7) == ["- a b\n  - c", "- d e f\n  - g h"]
    # the first piece has no overlap to leave room for
    assert [n for _, _, n in splitting.split_text("汉" * 25, 10, 3)] == [10, 10, 10, 4]


def test_unit_pieces(spark):
    u = spark.createDataFrame(
        [("u1", "s1", "汉" * 25, ["h"], 1), ("u1", "s1", "汉" * 25, ["h"], 2), ("u2", "s1", None, None, 1), ("u3", "gone", "汉" * 25, [], 1), ("u4", "s1", "", None, None), (None, "s1", "x", None, 1)],
        "unit_id string, source_id string, text string, heading_path array<string>, loaded_at int",
    )
    s = spark.createDataFrame([("s1", "p", "clash"), ("s2", None, None)], "id string, content_profile string, max_tokens string")
    lim = spark.createDataFrame([("p", 10, 3)], "content_profile string, max_tokens int, overlap_tokens int")
    got = splitting.unit_pieces(u, s, lim).collect()
    by = {k: sorted((r for r in got if r["unit_id"] == k), key=lambda r: r["piece_no"]) for k in ("u1", "u2", "u3", "u4")}
    assert [len(by[k]) for k in ("u1", "u2", "u3", "u4")] == [4, 1, 1, 1]
    assert [r["piece_tokens"] for r in by["u1"]] == [10, 10, 10, 4] and all(r["heading_path"] == ["h"] for r in by["u1"])
    assert splitting.unit_pieces(u.limit(0), s, lim).count() == 0


# -- p4 ----------------------------------------------------------------------------


def test_scans(spark):
    base = ["the valve of the pump is checked before each start", "阀门检查由设备管理员负责记录", "the cross-section plate is refitted", "压力试验由质量管理员签字确认", "two people must confirm before continuing"]
    units = [(f"c{i}", "v0", base[i % 5], None, i) for i in range(200)]
    units += [("s1", "v1", "阀门检查由设备菅理员负\n9 / 9\nPump Handbook\n责记录", 2, 1), ("s1", "v1", "阀门检查由设备菅理员负\n9 / 9\nPump Handbook\n责记录", 2, 1), ("s2", "v9", "not\nscanned", 1, 1)]
    page = lambda n, *body: ("\n".join(["Pump Handbook", *body, f"- {n} -"]), n)
    pages = [page(1, "the va1ve of the pump is chec-", "ked before each start", "two peop1e must", "", "the cross-", "section plate is refit-"), page(2, "ted", "压力试验由质量管理贝签字确认", "44")]
    blocks = [(t, "page", n, None, None) for t, n in pages]
    block = "array<struct<text:string,kind:string,page_number:int,heading_level:int,metadata:map<string,string>>>"
    ocr = spark.createDataFrame([("o1", "v1", blocks, 0.8, 1), ("o1", "v1", blocks, 0.8, 2), ("o2", "v1", [(page(3, "two people must confirm before continuing")[0], "page", 3, None, None)], None, 1), ("o3", None, None, 0.9, 1), ("o4", "v1", [("", "page", 1, None, None), (None, "page", 2, None, None)], 0.9, 1)], f"ocr_id string, document_version_id string, blocks {block}, mean_confidence double, extracted_at int")
    u = spark.createDataFrame(units, "unit_id string, document_version_id string, text string, page_number int, loaded_at int")
    repaired = scanned.repair_scans(ocr, u)
    got = {tuple(r) for r in scanned.found_faults(repaired).collect()}
    assert {g for g in got if g[1] == "o1"} == {
        ("ocr_results", "o1", 1, 1, "margin"), ("ocr_results", "o1", 1, 2, "hyphen"), ("ocr_results", "o1", 1, 2, "misread"), ("ocr_results", "o1", 1, 4, "misread"), ("ocr_results", "o1", 1, 7, "hyphen"), ("ocr_results", "o1", 1, 8, "margin"),
        ("ocr_results", "o1", 2, 1, "margin"), ("ocr_results", "o1", 2, 3, "misread"), ("ocr_results", "o1", 2, 5, "margin"),
    }
    assert {g for g in got if g[1] == "s1"} == {("units", "s1", 2, 1, "misread"), ("units", "s1", 2, 2, "margin"), ("units", "s1", 2, 3, "margin")}
    text = {r["row_id"]: r["repaired"] for r in repaired.collect()}
    assert text["s1"] == "阀门检查由设备管理员负责记录" and "the valve of the pump is checked before each start" in text["o1"] and "cross-section" in text["o1"]
    assert "s2" not in text and text["o3"] == text["o4"] == ""
    assert scanned.repair_scans(ocr.limit(0), u.limit(0)).count() == 0


def test_running_lines_with_a_revision(spark):
    body = ["the valve of the pump is checked before each start", "it was drained for service in the hall", "see the plate near the door, TM-8853 Rev. B"]
    heads = ["TM-{} Rev. B  Pump Handbook", "LR-{}C Rev. C  桥式起重机使用维护手册", "Please read this. Rev. B", "QS-{} Rev. D"]
    # one page a result: no line stands at the top of two pages of it
    pages = [(f"o{h}{i}", "v1", [("\n".join([head.format(8853 + i), *body, "12"]), 1)], 0.9, 1) for h, head in enumerate(heads) for i in range(4)]
    ocr = spark.createDataFrame(pages, "ocr_id string, document_version_id string, blocks array<struct<text:string,page_number:int>>, mean_confidence double, extracted_at int")
    inner = "\n".join(["the valve of the pump", "TM-7001 Rev. B  Pump Handbook", "QS-8482 Rev. D", "LR-8424C Rev. C  桥式起重机使用维护手册", "Please read this. Rev. B", "as in the sheet TM-8853 Rev. B", "is checked before each start"])
    u = spark.createDataFrame([("s1", "v1", inner, 2, 1), *[(f"c{i}", "v0", body[i % 2], None, 1) for i in range(60)]], "unit_id string, document_version_id string, text string, page_number int, loaded_at int")
    got = {(r["row_id"], r["line_no"]) for r in scanned.found_faults(scanned.repair_scans(ocr, u)).where("fault = 'margin'").collect()}
    assert {n for i, n in got if i == "s1"} == {2, 3, 4}
    assert {i for i, n in got if n == 1 and i != "s1"} == {f"o{h}{i}" for h in (0, 1, 3) for i in range(4)}
    assert {n for i, n in got if i != "s1"} == {1, 5}


# -- p5 ----------------------------------------------------------------------------


def _corpus(seed: int, n: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + list("汉字阀门检修压力")
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            base = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 4)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            out.append((f"r{i}", " ".join(base)))
        else:
            out.append((f"r{i}", " ".join(rng.choices(words, k=rng.choice([3, 5, 6, 20, 45, 90, 700, 1500])))))
    return out


def _brute(data, t: Fraction, width: int) -> set[tuple[str, str]]:
    sets = []
    for k, x in data:
        w = TOKEN.findall(x.lower())
        sets.append((k, x.lower(), {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}))
    out = set()
    for i, (a, x, s) in enumerate(sets):
        for b, y, r in sets[:i]:
            if x == y or (s or r) and len(s & r) * t.denominator >= len(s | r) * t.numerator:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("boundary, list_block", [(None, 8192), (100, 8192), (10_000, 8192), (0, 3), (30, 2)])
def test_similar_pairs_equal_brute_force(spark, boundary, list_block):
    data = _corpus(1, 140)
    df = spark.createDataFrame([(*r, "clash") for r in [*data, data[0], ("z", None), (None, "x")]], "k string, x string, sid string")
    records = near_duplicates.with_set_ids(df, "t", "k", "x")
    links = near_duplicates.similar_texts(records, 0.7, 5, list_block, boundary)
    got = {(r["id_a"], r["id_b"]) for r in near_duplicates.expand_pairs(records, links).collect()}
    assert got == _brute(data, Fraction(7, 10), 5)


def test_tables_are_not_mixed_and_groups_are_components(spark):
    a, b, c = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", "x b c d e f g h i j k l m n o p q r s u"
    df = spark.createDataFrame([("1", a), ("2", b), ("3", c), ("4", "other words entirely here now"), ("5", a)], "k string, x string")
    records = near_duplicates.with_set_ids(df, "t", "k", "x").unionByName(near_duplicates.with_set_ids(df, "u", "k", "x"))
    links = near_duplicates.materialize(near_duplicates.similar_texts(records, 0.8), "links")
    got = near_duplicates.near_duplicate_groups(records, links).collect()
    classes = {(r["table_name"], r["id"]): r["class_id"] for r in got}
    assert len(got) == 10 and len({classes["t", k] for k in "1235"}) == 1 and classes["t", "4"] != classes["t", "1"] != classes["u", "1"]
    assert {r["links"] for r in got if r["id"] == "2"} == {2}
    none = records.limit(0)
    assert near_duplicates.expand_pairs(none, near_duplicates.similar_texts(none, 0.8)).count() == 0


def test_boundary_takes_the_cheaper_side():
    sizes = np.zeros(1 << 16, np.int64)
    sizes[[10, 400]] = 1000
    rare, common = np.ones(1000, np.int64), np.full(1000, 100_000)
    assert near_duplicates.choose_boundary(rare, sizes, Fraction(7, 10)) < 10
    assert 10 <= near_duplicates.choose_boundary(common, sizes, Fraction(7, 10)) < 1 << 16


# -- p6 ----------------------------------------------------------------------------


def _words(t: str) -> list[str]:
    return re.findall(r"[㐀-鿿]|[^\W_㐀-鿿]+", unicodedata.normalize("NFKC", t).lower())


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + list("阀门检修压力试验")
    passages = {i: " ".join(rng.choices(vocabulary, k=k)) for i, k in enumerate([90, 60, 50, 49, 10, 200])}
    docs = {}
    for d in range(60):
        body = rng.choices(vocabulary, k=40)
        i = rng.randrange(6)
        w = passages[i].split()
        n = rng.randint(1, len(w))
        a = rng.randint(0, len(w) - n)
        quote = [x.upper() if rng.random() < 0.3 else x for x in w[a : a + n]]
        docs[d] = " ".join(body) + rng.choice([" ", "\n", "，"]) + rng.choice([" ", " ; "]).join(quote) + "。" + " ".join(body[:5])
    docs[98], docs[99] = "", passages[0].replace("w", "ｗ")
    want = set()
    for d, t in docs.items():
        x = " " + " ".join(_words(t)) + " "
        for i, p in passages.items():
            w = _words(p)
            if any(" " + " ".join(w[a : a + 50]) + " " in x for a in range(len(w) - 49)):
                want.add((d, i))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()] + [(None, "x", 1), (97, None, 1)], "doc_id bigint, text string, score int")
    items = spark.createDataFrame([*passages.items(), (77, None), (None, "x")], "item_id bigint, passage string")
    for block in (5000, 2):
        got = leakage.leaked_passages(df, items, 50, block_items=block)
        assert {(r["doc_id"], r["item_id"]) for r in got.where("longest_run >= 50").collect()} == want
    assert leakage.leaked_passages(df.limit(0), items, 50).count() == 0
    assert leakage.leaked_passages(df, items.limit(0), 50).count() == 0


def test_smith_waterman_against_the_table():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert leakage.smith_waterman(a.astype(np.uint64), b.astype(np.uint64))[0] == h.max()


# -- p7 ----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(size):
    assert sorted(mixing.permute(np.arange(size), size, 5).tolist()) == list(range(size))


def test_mix(spark):
    rng = random.Random(8)
    data = [(i, "big" if i % 3 else "small", " ".join(["x"] * rng.randint(0, 60))) for i in range(400)] + [(900, "big", None), (901, None, "x"), (None, "big", "x"), (902, "other", "x " * 50)]
    docs = spark.createDataFrame([(*r, 1) for r in data], "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 2), ("none", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    size = {s: sum(len((t or "").split()) for i, x, t in data if x == s and i is not None) for s in ("big", "small")}
    selection, report = mixing.mix_sources(docs, targets, block_tokens=16, per_shard=64)
    got = selection.collect()
    used = Counter()
    for r in got:
        for k in range(r["from_token"], r["to_token"]):
            used[r["doc_id"], k] += 1
    assert max(used.values()) <= 2
    rep = {r["source"]: r for r in report.collect()}
    total = sum(size.values())
    for s in ("big", "small"):
        assert rep[s]["tokens"] == size[s] and rep[s]["selected_tokens"] == sum(r["to_token"] - r["from_token"] for r in got if r["source"] == s) <= 2 * size[s]
        assert rep[s]["reachable"] == (2 * size[s] >= rep[s]["target_share"] * total)
    assert abs(rep["big"]["selected_tokens"] / (0.5 * total) - 1) < 0.1 and not rep["none"]["reachable"] and rep["none"]["actual_share"] == 0
    assert rows(selection) == rows(mixing.mix_sources(docs.repartition(7), targets, block_tokens=16, per_shard=64)[0])
    empty = mixing.mix_sources(docs.limit(0), targets)
    assert empty[0].count() == 0 and {r["selected_tokens"] for r in empty[1].collect()} == {0}


def test_running_start(spark):
    df = spark.createDataFrame([("a", i, i % 5) for i in range(300)], "p string, k int, v int")
    got = sorted((r["start"], r["v"]) for r in mixing.running_start(df, "p", "v", F.col("k"), 300_000).collect())
    at = 0
    ends = []
    for s, v in got:
        ends.append((s, s + v))
    assert sum(v for _, v in got) == 600 and max(e for _, e in ends) == 600 and min(s for s, _ in ends) == 0
    covered = np.zeros(600, int)
    for s, e in ends:
        covered[s:e] += 1
        at = e
    assert (covered == 1).all() and at


# -- p8 ----------------------------------------------------------------------------


def test_rules_learn_and_export():
    rng = np.random.default_rng(1)
    x = rng.random((900, 3))
    y = np.where((x[:, 0] > 0.5) & (x[:, 1] > 0.3), "a", np.where(x[:, 2] > 0.5, "b", "c"))
    y[rng.integers(0, 900, 20)] = "c"
    rules = quality.induce_rules(x[:600], y[:600], ["f", "g", "h"], "c")
    said = np.full(300, "c", dtype="<U1")
    left = np.ones(300, bool)
    for r in rules:
        hit = left & r.covers(x[600:], ["f", "g", "h"])
        said[hit], left = r.shape, left & ~hit
    assert (said == y[600:]).mean() > 0.93
    assert quality.rules_sql([], "c") == "'c'" and quality.rules_sql(rules, "c").startswith("CASE WHEN ")


def test_statistics_of_simple_texts():
    got = quality.statistics_of(["The pump is checked. It is the pump of the plant.", "- a\n- b\n- c", "", "a | b | c\nd | e | f", "设备的检查由管理员负责。"], {"en": ["is", "of", "the", "it"], "zh": ["的", "由"]})
    assert got["words"].tolist() == [11, 3, 0, 6, 12 - 1] and got["lines"].tolist() == [1, 3, 0, 2, 1]
    assert got["language"] == ["en", None, None, None, "zh"]
    assert got["sentence_share"][0] == 1 and got["marked_lines"][1] == 1 and got["row_lines"][3] == 1
    assert all(v.shape == (1,) for k, v in quality.statistics_of([""], {}).items() if k != "language")


def test_shapes_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    labels = read("shape_labels")
    learn, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    docs = read("documents").join(held.select("doc_id"), "doc_id", "left_semi").unionByName(read("documents").join(learn.select("doc_id"), "doc_id", "left_semi"))
    said = quality.classify_shapes(docs, learn, read("common_words")).select("doc_id", F.col("shape").alias("said"))
    both = said.join(held, "doc_id").select(((F.col("said") == "prose") == (F.col("shape") == "prose")).alias("ok")).collect()
    assert len(both) > 200 and sum(r["ok"] for r in both) / len(both) > 0.95
    assert {r["shape"] for r in quality.classify_shapes(docs.limit(3), labels.limit(0), read("common_words")).collect()} == {"junk"}
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "", "de", "x"), (3, "词" * 20000, "xx", "x")], "doc_id bigint, text string, lang string, shape string")
    assert quality.classify_shapes(odd, learn, read("common_words")).count() == 3


# -- all ---------------------------------------------------------------------------


def test_queries_give_the_stated_columns(spark):
    want = {
        "p1_found": ["table_name", "id_a", "id_b"], "p2_found": ["unit_id"], "p4_found": ["origin", "row_id", "page_number", "line_no", "fault"], "p5_found": ["table_name", "id_a", "id_b"],
        "p6_found": ["doc_id", "item_id"], "p7_found": ["source"], "p8_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = queries.queries()[name](spark, "/root/testdata/sf0.001")
        assert df.columns == columns and df.count() > 0, name
