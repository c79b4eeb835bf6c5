"""Index texts, sinks, citations and contexts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import evidence, index_text, lexical, metrics
from corvane.sources import sinks

TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9_]+|[^\s]")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_head_and_tail_against_offsets(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab 汉字，.\n", k=rng.randint(0, 80))) for _ in range(60)] + ["", "汉" * 3000, "word " * 2000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", index_text.head_and_tail(F.col("t"), 12).alias("x")).orderBy("i").collect()
    for t, r in zip(texts, got):
        spans = [m.span() for m in TOKEN.finditer(t)]
        want = t if len(spans) <= 12 else t[: spans[7][1]].rstrip() + index_text.OMITTED + t[spans[-4][0] :].lstrip()
        assert r["x"].rstrip() == want.rstrip()


def test_index_texts(spark):
    c = spark.createDataFrame([("a", "body  text\n\n x", ["Top", "Mid", "Deep"], "第八条"), ("b", "Deep 第八条", ["Mid", "Deep"], "第八条"), ("c", None, None, None)], "id string, text string, heading_path array<string>, section_number string")
    got = {r["id"]: r for r in index_text.index_texts(c).collect()}
    assert got["a"]["lexical_text"] == "[层级 / Heading] Mid / Deep\n[编号 / Section] 第八条\nbody text\nx"
    assert got["b"]["header"] == "[层级 / Heading] Mid" and got["c"]["lexical_text"] == ""
    assert got["a"]["fingerprint"] == hashlib.sha256(b"body text\nx").hexdigest()


def test_spans_and_codes(spark):
    u = spark.createDataFrame([("v", 1, ["a", "b"], "k"), ("v", 3, ["a", "c"], "k"), ("w", None, None, None), ("w", 2, ["a"], "k")], "g string, page_number int, heading_path array<string>, hard_boundary_key string")
    assert {tuple(r) for r in index_text.merged_locators(u, "g").collect()} == {("v", 1, 3, 2, "a", "k"), ("w", 2, 2, 2, "", None)}
    c = spark.createDataFrame([("v", 0, "a, b"), ("v", 1, "b,c"), ("v", 2, None)], "g string, ordinal int, r string")
    assert rows(index_text.degradation_codes(c, "g", "r")) == [("v", "a", 0), ("v", "b", 0), ("v", "c", 1)]


@pytest.mark.parametrize(
    "text, verdict",
    [("甲方应当检修阀门[C1]。", "valid"), ("甲方应当检修阀门。", "no_citation"), ("甲方应当检修阀门[C9]。", "unknown_label"), ("甲方应当检修阀门[C1]。另外检修水泵。", "uncited_claim"), ("检修阀门[C2]。", "not_authorised"), ("检修阀门[C3]。", "not_live"), ("不得检修阀门[C1]。", "unsupported"), (None, "no_citation")],
)
def test_citation_verdicts(spark, text, verdict):
    e = spark.createDataFrame([(1, n, "甲方应当检修阀门", n != 2, n != 3) for n in (1, 2, 3)], "answer_id int, label int, text string, allowed boolean, live boolean")
    assert rows(evidence.verify_citations(spark.createDataFrame([(1, text)], "answer_id int, text string"), e)) == [(1, verdict)]


def test_excerpts_and_contexts(spark):
    p = "x" * 300 + "阀门 水泵" + "y" * 300
    df = spark.createDataFrame([(p, ["阀门", "水泵"]), ("short", ["q"]), (None, ["q"])], "p string, t array<string>").select(evidence.support_excerpt(F.col("p"), F.col("t"), 60).alias("x"))
    got = [r["x"] for r in df.collect()]
    assert "阀门 水泵" in got[0] and got[0].startswith("…") and got[0].endswith("…") and len(got[0]) == 62 and got[1:] == ["short", None]
    c = spark.createDataFrame([("q", 1, "A", True), ("q", 2, "B", False), ("q", 3, "C", True)], "query_id string, rank int, text string, kept boolean")
    assert rows(evidence.context_blocks(c)) == [("q", 2, "[C1]\nA\n\n[C2]\nC")]


def test_reports(spark):
    r = spark.createDataFrame([(1, ["a"], ["a", "b"], 2, 1), (2, [], [], 0, 0)], "k int, cited array<string>, relevant array<string>, claims int, cited_claims int")
    assert rows(metrics.citation_metrics(r, "k")) == [(1, 1.0, 0.5, 0.5), (2, 1.0, 1.0, 1.0)]
    m = spark.createDataFrame([(1.0, None), (0.0, 2.0)], "a double, b double")
    assert rows(metrics.run_report(m, ["a", "b"])) == [("a", 0.5, 2), ("b", 2.0, 1)]


def test_index_is_published_whole(spark, tmp_path):
    entries = spark.createDataFrame([("a", "阀门 ab", None), ("b", "ab", None)], "id string, text string, section_number string")
    staging, final = f"file://{tmp_path}/staging", f"file://{tmp_path}/final"
    profiles = spark.createDataFrame([("s", ["ab"])], "source_id string, terms array<string>")
    sinks.write_index(entries, None, profiles, staging)
    sinks.write_manifest(spark, staging, chunker="fold-1")
    assert sinks.damaged_files(spark, staging).count() == 0
    extra = next((tmp_path / "staging" / "profiles").glob("*.parquet"))
    content = extra.read_bytes()
    extra.rename(extra.with_name("x.parquet"))
    assert {r["state"] for r in sinks.damaged_files(spark, staging).collect()} == {"missing", "unexpected"}
    with pytest.raises(ValueError):
        sinks.publish(spark, staging, final)
    (extra.parent / "x.parquet").unlink()
    extra.write_bytes(content)
    sinks.publish(spark, staging, final)
    assert rows(lexical.read_lexical_index(spark, final).postings.select("id", "term", "tf")) == rows(lexical.postings(entries))
    sinks.write_index(entries, None, profiles, staging)
    sinks.write_manifest(spark, staging)
    with pytest.raises(FileExistsError):
        sinks.publish(spark, staging, final)


def test_versions_are_replaced_and_rows_inserted_once(spark, tmp_path):
    c = lambda *x: spark.createDataFrame(list(x), "id string, document_version_id string")
    sinks.replace_versions(c(("a", "v1"), ("b", "v2")), str(tmp_path / "t"))
    sinks.replace_versions(c(("c", "v1")), str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("id")) == [("b",), ("c",)]
    assert rows(sinks.new_rows(c(("a", "x"), ("n", "x"), ("n", "x")), c(("a", "y")), "id")) == [("n", "x")]


def test_shared_prefix_rule(spark, tmp_path):
    from corvane.plans import queries

    same = "x" * 320
    row = lambda v, n, text, level="leaf": (f"{v}{n}", v, f"body {n}", text, level, 1)
    made = [row("v1", n, same + str(n)) for n in range(4)] + [row("v2", n, same) for n in range(3)] + [row("v3", n, same[1:] + "|" + str(n)) for n in range(3)] + [row("v3", 3, same[:319])] + [row("v4", n, same, "parent") for n in range(4)] + [("v5", "v5", "body", same, "leaf", 1)] * 4
    c = spark.createDataFrame(made, "id string, document_version_id string, text string, retrieval_text string, chunk_level string, loaded_at int")
    c.write.parquet(f"{tmp_path}/chunks.parquet")
    assert rows(queries.queries()["shared_prefix_violations"](spark, str(tmp_path))) == [("v1", 4)]
