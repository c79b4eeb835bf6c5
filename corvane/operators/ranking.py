"""Fusion, routing, selection and expansion of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import materialize
from corvane.functions.text import content_terms, exact_anchors, normal
from corvane.operators.evidence import ASKED_TIMES, TEMPORAL, all_of
from corvane.operators.lexical import rank


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, id, dense_rank, sparse_rank, score, rank) of candidates of either list."""
    left = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    right = sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = left.join(right, ["query_id", "id"], "full_outer").withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return both.withColumn("rank", F.row_number().over(w))


def route_sources(queries: DataFrame, profiles: DataFrame, relative: float = 0.55, most: int = 4) -> DataFrame:
    """(query_id, source_id, score, mode, selected): sources for each query.

    ``queries``: query_id, text; ``profiles``: source_id, name, description,
    profile_terms.  Rows are the sources that share a term with the query; a query without
    any has one row of a null source.  A weak or ambiguous signal selects all sources of the
    scope, which the mode authorized_global says.  Terms are matched as sets.
    """
    q = queries.select("query_id", content_terms(normal(F.coalesce("text", F.lit("")))).alias("terms"))
    p = profiles.select(
        "source_id",
        content_terms(normal(F.coalesce("name", F.lit("")))).alias("name_terms"),
        content_terms(normal(F.coalesce("description", F.lit("")))).alias("description_terms"),
        F.coalesce("profile_terms", F.array().cast("array<string>")).alias("profile_terms"),
    )
    # profile terms in inverted form: only matching (query, source) pairs are joined
    weighted = p.select("source_id", F.explode(F.array(F.struct(F.lit(2.0).alias("w"), F.col("name_terms").alias("t")), F.struct(F.lit(1.5).alias("w"), F.col("description_terms").alias("t")), F.struct(F.lit(1.0).alias("w"), F.array_distinct("profile_terms").alias("t")))).alias("f")).select(
        "source_id", F.col("f.w").alias("w"), F.explode("f.t").alias("term")
    )
    matched = q.select("query_id", F.explode("terms").alias("term")).join(weighted, "term").groupBy("query_id", "source_id").agg(F.sum("w").alias("score"))
    w = Window.partitionBy("query_id")
    ranked = matched.withColumn("_n", F.row_number().over(w.orderBy(F.desc("score"), "source_id"))).withColumn("_best", F.max("score").over(w))
    plausible = F.col("score") >= F.col("_best") * relative
    signal = ranked.groupBy("query_id").agg(
        F.max("_best").alias("_best"), F.max(F.when(F.col("_n") == 2, F.col("score"))).alias("_next"),
        F.sum((F.col("score") == F.col("_best")).cast("int")).alias("_tied"), F.sum(plausible.cast("int")).alias("_many"),
    )
    sources = F.broadcast(p.agg(F.count("*").alias("_sources")))
    # a source without any common term has score 0
    second = F.coalesce("_next", F.when(F.col("_sources") > 1, F.lit(0.0)))
    weak = (F.col("_best") <= 1.5) | (F.col("_tied") > most) | (second.isNotNull() & (F.col("_best") < F.greatest(F.lit(2.0), second * 1.15))) | (F.col("_many") > most)
    mode = F.when(F.coalesce(weak, F.lit(True)), "authorized_global").when(F.col("_many") == 1, "single_source").otherwise("multi_source")
    modes = q.select("query_id").join(signal.crossJoin(sources), "query_id", "left").select("query_id", "_best", mode.alias("mode"))
    rows = modes.join(matched, "query_id", "left")
    chosen = (F.col("mode") == "authorized_global") | (F.col("score") >= F.col("_best") * relative)
    return rows.select("query_id", "source_id", F.coalesce("score", F.lit(0.0)).alias("score"), "mode", chosen.alias("selected"))


def gap_cut(candidates: DataFrame, min_k: int = 3, ratio: float = 0.35) -> DataFrame:
    """(query_id, candidates, cut): the place of the first large relative drop of the
    score at or after ``min_k``, null without one.  ``candidates``: query_id, rank, score."""
    w = Window.partitionBy("query_id").orderBy("rank")
    drop = (F.col("score") - F.lead("score").over(w)) / F.greatest(F.abs("score"), F.lit(1e-12))
    marked = candidates.withColumn("_drop", drop)
    return marked.groupBy("query_id").agg(F.count("*").alias("candidates"), F.min(F.when((F.col("rank") >= min_k) & (F.col("_drop") >= ratio), F.col("rank"))).alias("cut"))


def target_size(candidates: Column, cut: Column, needs: Column, items: Column, default: int = 5, min_k: int = 3, max_k: int = 16) -> Column:
    """How many candidates to select: the cut, else the default, needs and requested
    items, clamped between what is needed and what there is."""
    scan = F.least(candidates, F.lit(max_k))
    floor = F.least(F.greatest(F.lit(min_k), needs, items), scan)
    wanted = F.coalesce(cut, F.least(F.greatest(F.lit(default), needs, items), scan))
    return F.greatest(floor, F.least(wanted, scan))


def selection_targets(candidates: DataFrame, plan: DataFrame, default: int = 5, min_k: int = 3, max_k: int = 16, ratio: float = 0.35) -> DataFrame:
    """(query_id, target): how many candidates to select for each query.  ``candidates``:
    query_id, id, rank, score; ``plan``: query_id, needs (required ones), items (asked for).
    Only a gap among the first ``max_k`` candidates counts."""
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    head = candidates.select("query_id", "score", F.row_number().over(w).alias("rank")).where(F.col("rank") <= max_k)
    rows = gap_cut(head, min_k, ratio).join(plan.select("query_id", "needs", "items"), "query_id", "left")
    asked = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("query_id", target_size(F.col("candidates"), F.col("cut"), asked("needs"), asked("items"), default, min_k, max_k).cast("int").alias("target"))


def reserved_candidates(needs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, id, place): the best candidate of every need, in the order of the needs.

    ``needs``: query_id, need_no, text, anchors (locators that must occur); ``candidates``:
    query_id, id, rank, text.  The share of the need's terms leads, then rank; all locators
    and asked time roles must occur, and a term where there are no locators."""
    n = needs.select("query_id", "need_no", content_terms(normal(F.col("text"))).alias("terms"), "anchors", all_of(F.col("text"), ASKED_TIMES).alias("times"))
    passage = F.coalesce("text", F.lit(""))
    w = Window.partitionBy("query_id").orderBy("rank", "id")
    c = candidates.select("query_id", "id", F.row_number().over(w).alias("rank"), content_terms(normal(passage)).alias("c_terms"), exact_anchors(normal(passage)).alias("c_anchors"), all_of(passage, TEMPORAL).alias("c_times"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("terms", "c_terms")).cast("double"), F.size("terms")), F.lit(0.0))
    fits = (F.size(F.array_except("anchors", "c_anchors")) == 0) & (F.size(F.array_except("times", "c_times")) == 0)
    rows = n.join(c, "query_id").withColumn("share", share).where(fits & ((F.col("share") > 0) | (F.size("anchors") > 0)))
    best = rows.groupBy("query_id", "need_no").agg(F.max_by("id", F.struct(F.col("share") + 1.0 / (999 + F.col("rank")), -F.col("rank"))).alias("id"))
    return best.groupBy("query_id", "id").agg(F.min("need_no").alias("place"))


def effective_scope(routed: Column, scope: Column) -> Column:
    """Routed sources inside the scope; the whole scope if there are none."""
    both = F.array_intersect(routed, scope)
    return F.when(F.size(both) > 0, both).otherwise(scope)


def select_diverse(candidates: DataFrame, target: int = 5, max_k: int = 16, token_budget: int = 6000, share: float = 0.6) -> DataFrame:
    """Greedy selection per query (query_id, id, rank, outcome, position).

    ``candidates``: query_id, id, rank, document_id, family_id, tokens; if given, ``target``
    replaces the argument and candidates with a ``place`` (reserved) come first, by place.
    Visits at most ``max_k`` candidates in that order and stops at the target: a family
    counts once, a document at most ceil(target * share) times if several occur among the
    first ``max_k`` by rank, tokens must fit.  ``position`` counts the visits.
    Only the first max_k rows of a query reach its group, so groups are bounded.
    """
    schema = "query_id string, id string, rank int, outcome string, position int"
    given = lambda c, otherwise: F.coalesce(c, otherwise) if c in candidates.columns else otherwise
    by_rank = Window.partitionBy("query_id").orderBy("rank", "id")
    slim = candidates.select(
        F.col("query_id").cast("string").alias("query_id"), F.col("id").cast("string").alias("id"), F.col("rank").cast("int").alias("rank"), F.coalesce("document_id", F.lit("")).alias("document_id"),
        F.coalesce("family_id", "id").cast("string").alias("family_id"), F.coalesce("tokens", F.lit(0)).alias("tokens"), given("target", F.lit(target)).cast("int").alias("target"), given("place", F.lit(2**31 - 1)).cast("int").alias("place"),
    )
    w = Window.partitionBy("query_id")
    near = F.when(F.col("_n") <= max_k, F.col("document_id"))
    seen = slim.withColumn("_n", F.row_number().over(by_rank)).withColumn("several", F.min(near).over(w) != F.max(near).over(w))
    head = seen.withColumn("position", F.row_number().over(w.orderBy("place", "rank", "id"))).where(F.col("position") <= max_k).drop("_n")

    # a query's head is one bounded array: the selection folds over it inside the row
    rows = head.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "rank", "document_id", "family_id", F.col("tokens").cast("bigint").alias("tokens")))).alias("rows"), F.first("target").alias("target"), F.first("several").alias("several"))
    cap = F.when(F.col("several"), F.greatest(F.lit(1), F.ceil(F.col("target") * share))).otherwise(F.col("target"))
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("families"), texts.alias("documents"), F.lit(0).cast("bigint").alias("used"), texts.alias("outcomes"))

    def visit(state: Column, row: Column) -> Column:
        of_document = F.size(F.filter(state["documents"], lambda d: d == row["document_id"]))
        outcome = (
            F.when(F.size(state["documents"]) >= F.col("target"), "")
            .when(F.array_contains(state["families"], row["family_id"]), "family_seen")
            .when(of_document >= cap, "document_cap")
            .when(state["used"] + row["tokens"] > token_budget, "token_budget")
            .otherwise("selected")
        )
        chosen = outcome == "selected"
        grown = lambda name, value: F.when(chosen, F.array_append(state[name], value)).otherwise(state[name]).alias(name)
        return F.struct(grown("families", row["family_id"]), grown("documents", row["document_id"]), (state["used"] + F.when(chosen, row["tokens"]).otherwise(0)).alias("used"), F.array_append(state["outcomes"], outcome).alias("outcomes"))

    visited = rows.select("query_id", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, visit, lambda state: state["outcomes"]).alias("outcomes"))).alias("v"))
    return visited.where("v.outcomes <> ''").select("query_id", "v.rows.id", "v.rows.rank", F.col("v.outcomes").alias("outcome"), "v.rows.position")


def context_options(hits: DataFrame, chunks: DataFrame, max_parent: int = 1600) -> DataFrame:
    """(id, contexts): the contexts of each hit, widest first: its parent, the window of its
    neighbours under the same parent and boundary, itself; the first two only up to
    ``max_parent`` tokens.  ``hits``: id.  Chunks delivered again count once."""
    cols = ["tenant_id", "source_id", "document_id", "document_version_id", "parent_chunk_id", "hard_boundary_key", "chunk_level", "text", "token_count", "previous_chunk_id", "next_chunk_id"]
    once = chunks.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at")).alias("c"))
    hit = hits.select("id").distinct().join(once, "id")

    def near(name: str, ref: str, level: str, rows: DataFrame) -> DataFrame:
        other = once.select(F.col("id").alias(f"{name}_id"), F.col("c").alias(name))
        same = [F.col(f"{name}.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("tenant_id", "source_id", "document_id", "document_version_id")]
        if name != "parent":
            same += [F.col(f"{name}.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("parent_chunk_id", "hard_boundary_key")]
        ok = F.col(f"{name}.chunk_level") == level
        for s in same:
            ok &= s
        return rows.join(other, F.col(ref) == F.col(f"{name}_id"), "left").withColumn(name, F.when(ok, F.col(name)))

    rows = near("parent", "c.parent_chunk_id", "parent", hit)
    rows = near("before", "c.previous_chunk_id", "leaf", rows)
    rows = near("after", "c.next_chunk_id", "leaf", rows)
    tokens = F.coalesce("before.token_count", F.lit(0)) + F.coalesce("c.token_count", F.lit(0)) + F.coalesce("after.token_count", F.lit(0))
    parent = F.col("parent").isNotNull() & (F.col("parent.token_count") <= max_parent)
    window = (F.col("before").isNotNull() | F.col("after").isNotNull()) & (tokens <= max_parent)

    def context(kind: str, fits: Column, key: str, size: Column, text: Column) -> Column:
        return F.when(fits, F.struct(F.lit(kind).alias("context_kind"), F.col(key).alias("context_id"), size.cast("int").alias("context_tokens"), text.alias("text")))

    options = F.array(
        context("parent", parent, "parent_id", F.col("parent.token_count"), F.col("parent.text")),
        context("local_window", window, "id", tokens, F.concat_ws("\n\n", "before.text", "c.text", "after.text")),
        context("child", F.lit(True), "id", F.col("c.token_count"), F.col("c.text")),
    )
    return rows.select("id", F.array_compact(options).alias("contexts"))


def expand_context(hits: DataFrame, chunks: DataFrame, max_parent: int = 1600) -> DataFrame:
    """(id, context_kind, context_id, context_tokens, text): the widest of each hit's
    :func:`context_options`."""
    return context_options(hits, chunks, max_parent).select("id", F.col("contexts")[0].alias("c")).select("id", "c.*")


def charge_contexts(contexts: DataFrame, budget: int = 6000) -> DataFrame:
    """Contexts charged in the order of rank and id (query_id, id, rank, context_kind,
    context_id, text, charged, used, kept): the widest context of each hit that still fits the budget;
    one charged before is free.  A hit of which not even the narrowest fits is not kept.
    ``contexts``: query_id, id, rank, contexts (:func:`context_options`), at most a
    selection's few rows per query."""
    slim = F.transform("contexts", lambda c: F.struct(c["context_kind"].alias("kind"), c["context_id"].alias("key"), F.coalesce(c["context_tokens"], F.lit(0)).alias("tokens")))
    rows = contexts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", slim.alias("options")))).alias("rows"))
    taken = "struct<kind:string,key:string,charged:int,used:int>"
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<{taken}>").alias("taken"))

    def charge(state: Column, row: Column) -> Column:
        # a parent and a child of the same id are different contexts
        name = lambda o: F.concat_ws(":", F.when(o["kind"] == "parent", "parent").otherwise("hit"), o["key"])
        cost = lambda o: F.when(F.array_contains(state["seen"], name(o)), 0).otherwise(o["tokens"])
        best = F.get(F.filter(row["options"], lambda o: state["used"] + cost(o) <= budget), F.lit(0))
        spent = F.coalesce(cost(best), F.lit(0))
        used = (state["used"] + F.when(best.isNotNull(), spent).otherwise(0)).cast("int")
        seen = F.when(best.isNotNull(), F.array_append(state["seen"], name(best))).otherwise(state["seen"])
        line = F.struct(best["kind"].alias("kind"), best["key"].alias("key"), F.when(best.isNotNull(), spent).otherwise(0).cast("int").alias("charged"), used.alias("used"))
        return F.struct(used.alias("used"), seen.alias("seen"), F.array_append(state["taken"], line.cast(taken)).alias("taken"))

    folded = rows.select("query_id", F.explode(F.arrays_zip("rows", F.aggregate("rows", start, charge, lambda state: state["taken"]).alias("taken"))).alias("v"))
    charged = folded.select("query_id", "v.rows.id", "v.rows.rank", F.col("v.taken.kind").alias("context_kind"), F.col("v.taken.key").alias("context_id"), "v.taken.charged", "v.taken.used", F.col("v.taken.kind").isNotNull().alias("kept"))
    text = F.get(F.filter("contexts", lambda c: c["context_kind"] == F.col("context_kind")), F.lit(0))["text"]
    return charged.join(contexts.select("query_id", "id", "contexts"), ["query_id", "id"]).select("query_id", "id", "rank", "context_kind", "context_id", text.alias("text"), "charged", "used", "kept")


def overlap_rerank(candidates: DataFrame, limit: int) -> DataFrame:
    """Reranked candidates (query_id, id, score, rank) by the share of the query's terms in
    the passage; the deterministic stand-in for a cross-encoder.  ``candidates``:
    query_id, id, query, passage; rows of a null passage are dropped."""
    rows = candidates.where("passage is not null").select("query_id", "id", content_terms(normal(F.col("query"))).alias("q"), content_terms(normal(F.col("passage"))).alias("p"))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("q", "p")).cast("double"), F.size("q")), F.lit(0.0))
    return rank(rows.select("query_id", "id", F.round(share, 6).alias("score")), "query_id", "id", "score", limit)


def hybrid_stages(dense: DataFrame, sparse: DataFrame, queries: DataFrame, passages: DataFrame, fused: int = 30, limit: int = 10) -> DataFrame:
    """Trace of a hybrid retrieval (query_id, stage, id, score, rank): the two lists, their
    fusion, and the first ``fused`` of it reranked by the passage.  ``dense``, ``sparse``:
    query_id, id, score, rank; ``queries``: query_id, text; ``passages``: id, text.  Each
    list is a few rows per query and is written once."""
    lists = [materialize(x.select("query_id", "id", "score", F.col("rank").cast("int").alias("rank")), "hybrid-list") for x in (dense, sparse)]
    both = materialize(reciprocal_rank_fusion(*lists).select("query_id", "id", "score", "rank"), "hybrid-fused")
    rows = both.where(F.col("rank") <= fused).select("query_id", "id").join(passages.select("id", F.col("text").alias("passage")), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    stages = {"dense": lists[0], "bm25": lists[1], "fused": both, "reranked": overlap_rerank(rows, limit)}
    out = None
    for name, part in stages.items():
        part = part.select("query_id", F.lit(name).alias("stage"), "id", "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out
