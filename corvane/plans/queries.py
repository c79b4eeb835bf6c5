"""The engine's queries over the test tables, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import ids, text
from corvane.functions.storage import materialize, scratch
from corvane.operators import catalog, chunking, dense, evidence, index_text, lexical, metrics, ranking, snapshots, structure
from corvane.plans import sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _SQL[f.__name__] = oracle
        return f

    return add


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.delivered_once(_read(spark, folder, "units"), "unit_id", "loaded_at")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.delivered_once(_read(spark, folder, "chunks"), "id", "loaded_at")


def _leaves(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).where("chunk_level = 'leaf'")


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    return _leaves(spark, folder).select("id", "source_id", F.coalesce(F.nullif("retrieval_text", F.lit("")), "text").alias("text"), "section_number")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("query").alias("text"))


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, folder: str) -> lexical.LexicalIndex:
    """The lexical index of a folder's leaves: built by the first search of a session,
    read by all."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        path = scratch(spark, "lexical-index")
        lexical.write_lexical_index(_entries(spark, folder), path)
        _INDEXES[key] = path
    return lexical.read_lexical_index(spark, _INDEXES[key])


_U = "(SELECT * FROM units WHERE unit_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY loaded_at DESC) = 1)"
_C = "(SELECT * FROM chunks WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1)"
_L = f"(SELECT * FROM {_C} WHERE chunk_level = 'leaf')"
_ENTRY = f"e AS (SELECT id, coalesce(nullif(retrieval_text, ''), text) AS t, section_number AS s FROM {_L})"
_POST = f"x AS (SELECT id, {sql.normal('t')} AS n, s FROM e), p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({sql.tokens('n')}) AS term FROM x) GROUP BY ALL)"

# -- index ------------------------------------------------------------------


@_add(f"WITH {_ENTRY}, {_POST} SELECT id, term, tf FROM p")
def tokenize_terms(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.postings(_entries(spark, folder))


@_add(f"WITH {_ENTRY}, {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.term_statistics(lexical.postings(_entries(spark, folder)))


_LOC = "(starts_with(a, 'clause:') OR starts_with(a, 'chapter:') OR starts_with(a, 'step:'))"
_BM25 = f"""
WITH {_ENTRY}, {_POST},
q AS (SELECT item_id AS query_id, {sql.normal('query')} AS n FROM eval_items),
d AS (SELECT id, sum(tf) AS dl FROM p GROUP BY id), g AS (SELECT (SELECT count(*) FROM e) AS n, (SELECT sum(dl) FROM d) AS tokens),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT DISTINCT query_id, a AS term, CASE WHEN {_LOC} THEN 8.0 ELSE 1.0 END AS weight FROM (SELECT query_id, unnest({sql.tokens('n')}) AS a FROM q)),
hit AS (SELECT query_id, p.id, weight * ln(1 + (g.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * (dl * g.n / g.tokens::DOUBLE))) AS part
        FROM w JOIN f USING (term) JOIN p USING (term) JOIN d ON d.id = p.id, g),
qa AS (SELECT query_id, a FROM (SELECT query_id, unnest({sql.anchors('n')}) AS a FROM q) WHERE {_LOC}),
ea AS (SELECT id, a FROM (SELECT id, unnest({sql.anchors(f"(CASE WHEN length(s) > 0 THEN {sql.normal('s')} ELSE n END)")}) AS a FROM x) WHERE {_LOC}),
al AS (SELECT * FROM hit UNION ALL SELECT query_id, id, 100.0 FROM qa JOIN ea USING (a)),
sc AS (SELECT query_id, id, round(sum(part), 6) AS score FROM al GROUP BY ALL HAVING round(sum(part), 6) > 0)
"""


@_add(_BM25 + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sc QUALIFY rank <= 30")
def bm25_top30(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.bm25_search(_index(spark, folder), _questions(spark, folder), 30)


@_add(
    _BM25 + ", ok AS (SELECT i.item_id AS query_id, l.id FROM eval_items i JOIN " + _L + " l ON list_contains(i.expected_source_ids, l.source_id)) "
    "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sc SEMI JOIN ok USING (query_id, id) QUALIFY rank <= 10"
)
def bm25_scoped(spark: SparkSession, folder: str) -> DataFrame:
    wanted = _read(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct("expected_source_ids")).alias("source_id"))
    return lexical.bm25_search(_index(spark, folder), _questions(spark, folder), 10, wanted)


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_DENSE = """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda z: z::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
r AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS ql, b.label AS bl, round(list_inner_product(a.v, b.v), 6) AS score FROM u a, u b WHERE a.vec_id % 50 = 0),
k AS (SELECT query_id, id, score, ql = bl AS same, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r)
"""


@_add(_DENSE + "SELECT query_id, id, score, rank FROM k WHERE rank <= 10")
def dense_top10(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    return dense.dense_search(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), 10)


@_add("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS norm, round(list_max(list_transform(embedding, lambda z: z::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 6) AS largest FROM embeddings")
def vector_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).select("id", F.round(F.sqrt(dense.squared(F.col("embedding"))), 6).alias("norm"), F.round(F.array_max(dense.normalized(F.col("embedding"))), 6).alias("largest"))


@_add("""
WITH v AS (SELECT embedding, label::VARCHAR AS f FROM embeddings UNION ALL SELECT embedding, 'copy-' || vec_id FROM embeddings WHERE vec_id % 50 = 0),
g AS (SELECT embedding, count(*) AS n, count(DISTINCT f) AS b FROM v GROUP BY embedding), t AS (SELECT sum(n)::BIGINT AS entries, count(*) AS groups, coalesce(max(n) FILTER (n > 1 AND b > 1), 0) AS largest_harmful, coalesce(sum(n) FILTER (n > 1 AND b > 1), 0)::BIGINT AS harmful_entries FROM g)
SELECT *, round(harmful_entries / entries::DOUBLE, 6) AS ratio, largest_harmful <= 3 AND harmful_entries / entries::DOUBLE <= 0.01 AS passed FROM t""")
def vector_collapse(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    copies = v.where("id % 50 = 0").select("embedding", F.concat(F.lit("copy-"), F.col("id")).alias("fingerprint"))
    return dense.collapsed_vectors(v.select("embedding", F.col("label").cast("string").alias("fingerprint")).unionByName(copies))


@_add(
    f"WITH e AS (SELECT source_id, {sql.normal('coalesce(nullif(retrieval_text, %s), text)' % repr(''))} AS n FROM {_L}), c AS (SELECT source_id, term, count(*) AS cf FROM (SELECT source_id, unnest({sql.tokens('n')}) AS term FROM e) WHERE length(term) > 1 GROUP BY ALL) "
    "SELECT source_id, term, cf, row_number() OVER (PARTITION BY source_id ORDER BY cf DESC, term)::INT AS rank FROM c QUALIFY rank <= 32"
)
def source_profiles_top32(spark: SparkSession, folder: str) -> DataFrame:
    rows = _leaves(spark, folder).select("source_id", F.coalesce(F.nullif("retrieval_text", F.lit("")), "text").alias("text"))
    return lexical.frequent_terms(rows, "source_id", 32)


@_add(
    f"WITH e AS (SELECT document_id, {sql.normal('text')} AS n FROM {_C}), c AS (SELECT document_id, term, count(*) AS cf FROM (SELECT document_id, unnest({sql.tokens('n')}) AS term FROM e) WHERE length(term) > 1 GROUP BY ALL) "
    "SELECT document_id, term, cf, row_number() OVER (PARTITION BY document_id ORDER BY cf DESC, term)::INT AS rank FROM c QUALIFY rank <= 24"
)
def profile_terms_top24(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.frequent_terms(_chunks(spark, folder).select("document_id", "text"), "document_id", 24)


@_add("SELECT document_version_id, count(*) AS leaves, sha256(string_agg(content_hash, '|' ORDER BY content_hash)) AS fingerprint FROM (SELECT DISTINCT document_version_id, id, content_hash FROM chunks WHERE chunk_level = 'leaf') GROUP BY 1")
def version_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.fingerprints(_read(spark, folder, "chunks"))


_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@_add(f"SELECT id, sha256(text) AS text_hash, sha256(text) = content_hash AS agrees FROM {_C}")
def content_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("id", ids.content_hash(F.col("text")).alias("text_hash"), (ids.content_hash(F.col("text")) == F.col("content_hash")).alias("agrees"))


@_add()
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    c = _leaves(spark, folder)
    return c.select("id", ids.stable_id("chunk", _NAMESPACE, F.col("tenant_id"), F.col("document_version_id"), F.col("ordinal").cast("string"), F.col("content_hash"), F.coalesce("chunker_version", F.lit(""))).alias("stable"))


# -- retrieval ----------------------------------------------------------------


def _lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, folder)
    near = dense.dense_search(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), 30)
    # a second list by label and closeness of ids stands in for a lexical one
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("label").alias("ql"))
    other = v.join(q, F.col("label") == F.col("ql")).select("query_id", "id", F.abs(F.col("id") - F.col("query_id")).alias("d"))
    return near, lexical.rank(other.withColumn("score", -F.col("d")), "query_id", "id", "score", 30)


_TWO = _DENSE + ", s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY abs(id - query_id), id)::INT AS r2 FROM k WHERE same QUALIFY r2 <= 30), m AS (SELECT coalesce(a.query_id, s.query_id) AS query_id, coalesce(a.id, s.id) AS id, a.rank AS dense_rank, s.r2 AS sparse_rank, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.r2), 0), 9) AS score FROM (SELECT * FROM k WHERE rank <= 30) a FULL JOIN s ON a.query_id = s.query_id AND a.id = s.id) "


@_add(_TWO + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM m")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.reciprocal_rank_fusion(*_lists(spark, folder)).select("query_id", "id", "score", "rank")


@_add(_TWO + ", z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM m), h AS (SELECT *, (score - lead(score) OVER (PARTITION BY query_id ORDER BY rank)) / greatest(abs(score), 1e-12) AS drop_ FROM z) SELECT query_id, count(*) AS candidates, coalesce(min(rank) FILTER (rank >= 3 AND drop_ >= 0.35), 0) AS cut FROM h GROUP BY 1")
def dynamic_gap_cut(spark: SparkSession, folder: str) -> DataFrame:
    cut = ranking.gap_cut(ranking.reciprocal_rank_fusion(*_lists(spark, folder)))
    return cut.withColumn("cut", F.coalesce("cut", F.lit(0)))


@_add(_DENSE + """, t AS (SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0),
n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1), h AS (SELECT query_id, count(*) FILTER (rank <= 10) AS found, min(rank) AS first_, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS gain FROM k SEMI JOIN t USING (query_id, id) WHERE rank <= 30 GROUP BY 1)
SELECT query_id, CASE WHEN coalesce(found, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(coalesce(found, 0) / n::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first_, 0), 6) AS reciprocal_rank,
round(coalesce(gain, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) r(i)), 6) AS ndcg FROM n LEFT JOIN h USING (query_id)""")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    q = v.where("id % 50 = 0")
    near = dense.dense_search(v, q.select(F.col("id").alias("query_id"), "embedding"), 30)
    truth = q.select(F.col("id").alias("query_id"), "label").join(v.select("id", "label"), "label").select("query_id", "id")
    return metrics.ranking_metrics(truth, near, 10)


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    terms = source_profiles_top32(spark, folder).groupBy("source_id").agg(F.array_sort(F.collect_list("term")).alias("profile_terms"))
    return _read(spark, folder, "sources").select(F.col("id").alias("source_id"), "name", "description").join(terms, "source_id", "left")


_ROUTE = f"""
WITH top AS ({_SQL['source_profiles_top32']}), tp AS MATERIALIZED (SELECT source_id, list(DISTINCT term) AS pt FROM top GROUP BY 1),
pr AS MATERIALIZED (SELECT s.id AS source_id, {sql.content(sql.normal("coalesce(name, '')"))} AS nt, {sql.content(sql.normal("coalesce(description, '')"))} AS dt, coalesce(pt, []) AS pt FROM sources s LEFT JOIN tp ON tp.source_id = s.id),
q AS MATERIALIZED (SELECT item_id AS query_id, {sql.content(sql.normal('query'))} AS qt FROM eval_items),
s AS MATERIALIZED (SELECT query_id, source_id, 2.0::DOUBLE * len(list_intersect(qt, nt)) + 1.5::DOUBLE * len(list_intersect(qt, dt)) + 1.0::DOUBLE * len(list_intersect(qt, pt)) AS score FROM q, pr),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS n, max(score) OVER (PARTITION BY query_id) AS best FROM s),
a AS (SELECT query_id, max(best) AS best, max(score) FILTER (n = 2) AS second, count(*) FILTER (score = best) AS tied, count(*) FILTER (score >= best * 0.55) AS many FROM r GROUP BY 1),
w AS (SELECT *, best <= 1.5 OR tied > 4 OR (second IS NOT NULL AND best < greatest(2.0, second * 1.15)) OR many > 4 AS weak FROM a)
SELECT query_id, source_id, coalesce(score, 0.0::DOUBLE) AS score, CASE WHEN weak THEN 'authorized_global' WHEN many = 1 THEN 'single_source' ELSE 'multi_source' END AS mode, weak OR score >= w.best * 0.55 AS selected FROM w LEFT JOIN (SELECT * FROM s WHERE score > 0) s USING (query_id)"""


@_add(_ROUTE)
def source_routing(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.route_sources(_questions(spark, folder), _profiles(spark, folder))


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, routed): the sources a query is routed to, none where it is global."""
    picked = F.when(F.col("selected") & (F.col("mode") != "authorized_global"), F.col("source_id"))
    return source_routing(spark, folder).groupBy("query_id").agg(F.array_sort(F.collect_set(picked)).alias("routed"))


@_add(f"""WITH g AS ({_ROUTE}), x AS (SELECT query_id, coalesce(list(source_id) FILTER (selected AND mode <> 'authorized_global'), []) AS got FROM g GROUP BY 1)
SELECT query_id, round(CASE WHEN len(got) > 0 THEN len(list_intersect(got, expected_source_ids)) / len(got)::DOUBLE WHEN len(expected_source_ids) = 0 THEN 1.0 ELSE 0.0 END, 6) AS source_precision,
round(CASE WHEN len(list_distinct(expected_source_ids)) > 0 THEN len(list_intersect(got, expected_source_ids)) / len(list_distinct(expected_source_ids))::DOUBLE ELSE 1.0 END, 6) AS source_recall FROM x JOIN eval_items ON item_id = query_id""")
def routing_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("expected_source_ids").alias("want")).join(_routed(spark, folder).withColumnRenamed("routed", "got"), "query_id")
    return rows.select("query_id", F.round(metrics.set_precision(F.col("got"), F.col("want")), 6).alias("source_precision"), F.round(metrics.set_recall(F.col("got"), F.col("want")), 6).alias("source_recall"))


def _selection(spark: SparkSession, folder: str) -> DataFrame:
    # hits feed the targets, the reservation and the selection: written once, a few rows per question
    return _placed(spark, folder, materialize(bm25_top30(spark, folder), "selection-hits"))


def _placed(spark: SparkSession, folder: str, hits: DataFrame) -> DataFrame:
    """Hits with what the selection needs: family, tokens, target and reserved place."""
    c = _leaves(spark, folder).select("id", "document_id", F.coalesce("parent_chunk_id", "id").alias("family_id"), F.col("token_count").alias("tokens"), F.coalesce(F.nullif("retrieval_text", F.lit("")), "text").alias("text"))
    found = hits.join(c, "id")
    asked = _questions(spark, folder).where("text is not null").select("query_id", evidence.need_parts(evidence.query_features(F.col("text"))["core_query"]).alias("parts"), text.exact_anchors(text.normal(F.col("text"))).alias("anchors"), evidence.requested_items(F.col("text")).alias("items"))
    plan = asked.select("query_id", F.size("parts").alias("needs"), "items")
    # the locators of a question belong to its only need, not to one of several
    locators = F.when(F.size("parts") == 1, F.col("anchors")).otherwise(F.array().cast("array<string>"))
    needs = asked.select("query_id", locators.alias("anchors"), F.posexplode("parts").alias("need_no", "text"))
    placed = found.join(ranking.reserved_candidates(needs, found), ["query_id", "id"], "left").drop("text")
    return placed.join(ranking.selection_targets(found, plan), "query_id", "left")


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    """Selected candidates, ranked in the order of their selection."""
    return ranking.select_diverse(_selection(spark, folder)).where("outcome = 'selected'").drop("rank").withColumnRenamed("position", "rank")


@_add()
def greedy_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.select_diverse(_selection(spark, folder)).drop("position")


@_add(f"""WITH g AS ({_ROUTE}), x AS (SELECT query_id, coalesce(list(source_id) FILTER (selected AND mode <> 'authorized_global'), []) AS got FROM g GROUP BY 1), a AS (SELECT list(id) AS ids FROM sources WHERE is_active)
SELECT query_id, unnest(CASE WHEN len(list_intersect(got, ids)) > 0 THEN list_intersect(got, ids) ELSE ids END) AS source_id FROM x, a""")
def effective_scopes(spark: SparkSession, folder: str) -> DataFrame:
    scope = _read(spark, folder, "sources").where("is_active").agg(F.array_sort(F.collect_set("id")).alias("scope"))
    return _routed(spark, folder).crossJoin(F.broadcast(scope)).select("query_id", F.explode(ranking.effective_scope(F.col("routed"), F.col("scope"))).alias("source_id"))


@_add(f"""WITH c AS {_C}, h AS (SELECT * FROM c WHERE chunk_level = 'leaf'),
j AS (SELECT h.id, h.text AS t, h.token_count AS n, p.id AS pid, p.text AS pt, p.token_count AS pn, b.id AS bid, b.text AS bt, coalesce(b.token_count, 0) AS bn, a.id AS aid, a.text AS at_, coalesce(a.token_count, 0) AS an FROM h
 LEFT JOIN c p ON p.id = h.parent_chunk_id AND p.chunk_level = 'parent' AND p.document_version_id = h.document_version_id AND p.document_id = h.document_id AND p.source_id = h.source_id AND p.tenant_id = h.tenant_id
 LEFT JOIN c b ON b.id = h.previous_chunk_id AND b.chunk_level = 'leaf' AND b.document_version_id = h.document_version_id AND b.parent_chunk_id IS NOT DISTINCT FROM h.parent_chunk_id AND b.hard_boundary_key IS NOT DISTINCT FROM h.hard_boundary_key
 LEFT JOIN c a ON a.id = h.next_chunk_id AND a.chunk_level = 'leaf' AND a.document_version_id = h.document_version_id AND a.parent_chunk_id IS NOT DISTINCT FROM h.parent_chunk_id AND a.hard_boundary_key IS NOT DISTINCT FROM h.hard_boundary_key),
k AS (SELECT *, CASE WHEN pid IS NOT NULL AND pn <= 1600 THEN 'parent' WHEN (bid IS NOT NULL OR aid IS NOT NULL) AND bn + n + an <= 1600 THEN 'local_window' ELSE 'child' END AS context_kind FROM j)
SELECT id, context_kind, CASE context_kind WHEN 'parent' THEN pid ELSE id END AS context_id, CASE context_kind WHEN 'parent' THEN pn WHEN 'local_window' THEN bn + n + an ELSE n END AS context_tokens,
CASE context_kind WHEN 'parent' THEN pt WHEN 'local_window' THEN concat_ws(chr(10) || chr(10), bt, t, at_) ELSE t END AS text FROM k""")
def parent_expansion(spark: SparkSession, folder: str) -> DataFrame:
    c = _read(spark, folder, "chunks")
    return ranking.expand_context(c.where("chunk_level = 'leaf'"), c)


@_add()
def context_charges(spark: SparkSession, folder: str) -> DataFrame:
    return _charged(spark, folder).drop("text")


def _charged(spark: SparkSession, folder: str) -> DataFrame:
    # the selection is a few rows per question and feeds several joins: written once
    kept = materialize(_selected(spark, folder), "selected")
    options = materialize(kept.join(ranking.context_options(kept, _read(spark, folder, "chunks")), "id"), "context-options")
    return ranking.charge_contexts(options)


@_add(f"""WITH l AS {_L}, b AS ({_SQL['bm25_top30']}), r AS (SELECT b.query_id, b.id, {sql.content(sql.normal('i.query'))} AS q, {sql.content(sql.normal('l.text'))} AS p FROM b JOIN eval_items i ON i.item_id = b.query_id JOIN l ON l.id = b.id),
s AS (SELECT query_id, id, round(coalesce(len(list_intersect(q, p)) / nullif(len(q), 0)::DOUBLE, 0), 6) AS score FROM r) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def overlap_rerank(spark: SparkSession, folder: str) -> DataFrame:
    rows = bm25_top30(spark, folder).select("query_id", "id").join(_leaves(spark, folder).select("id", F.col("text").alias("passage")), "id").join(_questions(spark, folder).withColumnRenamed("text", "query"), "query_id")
    return ranking.overlap_rerank(rows, 10)


def _embeddings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    entries = dense.embed(_entries(spark, folder), "id", "text")
    return entries, dense.embed(_questions(spark, folder), "query_id", "text")


_CODES = "list_transform(string_split({}, ''), lambda c, i: (unicode(c) + i - 1) % 15)"
_CHARS = "list_concat(list_transform(range(0, 15), lambda r: len(list_filter(k, lambda x: x = r))::DOUBLE), [1.0::DOUBLE])"
_UNIT = "list_transform(v, lambda z: z / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
_HYBRID = f"""WITH b AS MATERIALIZED ({_SQL['bm25_top30']}), l AS MATERIALIZED (SELECT id, text, coalesce(nullif(retrieval_text, ''), text) AS t FROM {_L}),
ev AS MATERIALIZED (SELECT id, {_UNIT} AS v FROM (SELECT id, {_CHARS} AS v FROM (SELECT id, {_CODES.format('t')} AS k FROM l))),
qv AS MATERIALIZED (SELECT query_id, {_UNIT} AS v FROM (SELECT query_id, {_CHARS} AS v FROM (SELECT item_id AS query_id, {_CODES.format('query')} AS k FROM eval_items WHERE query IS NOT NULL))),
d AS MATERIALIZED (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM (SELECT query_id, id, round(list_inner_product(qv.v, ev.v), 6) AS score FROM qv, ev) QUALIFY rank <= 30),
m AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score FROM d FULL JOIN b ON d.query_id = b.query_id AND d.id = b.id),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM m),
p AS MATERIALIZED (SELECT id, {sql.content(sql.normal('text'))} AS p FROM l), q AS MATERIALIZED (SELECT item_id AS query_id, {sql.content(sql.normal('query'))} AS q FROM eval_items),
e AS (SELECT query_id, id, round(coalesce(len(list_intersect(q, p)) / nullif(len(q), 0)::DOUBLE, 0), 6) AS score FROM (SELECT query_id, id FROM f WHERE rank <= 30) JOIN p USING (id) JOIN q USING (query_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM e QUALIFY rank <= 10)
SELECT query_id, 'dense' AS stage, id, score, rank FROM d UNION ALL SELECT query_id, 'bm25', id, score, rank FROM b UNION ALL SELECT query_id, 'fused', id, score, rank FROM f UNION ALL SELECT query_id, 'reranked', id, score, rank FROM g"""


@_add(_HYBRID)
def hybrid_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Every stage of the hybrid retrieval of every question over all leaves."""
    entries, questions = _embeddings(spark, folder)
    near = dense.dense_search(entries, questions, 30)
    return ranking.hybrid_stages(near, bm25_top30(spark, folder), _questions(spark, folder), _leaves(spark, folder).select("id", "text"))


@_add()
def hybrid_selected(spark: SparkSession, folder: str) -> DataFrame:
    """The passages that the hybrid retrieval selects, in order."""
    reranked = hybrid_trace(spark, folder).where("stage = 'reranked'").drop("stage")
    return ranking.select_diverse(_placed(spark, folder, materialize(reranked, "reranked"))).where("outcome = 'selected'").select("query_id", "id", "position")


# -- ingestion --------------------------------------------------------------


@_add(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({sql.nfkc('text')}, chr(13) || chr(10) || '?', chr(10), 'g'), '[\\x00-\\x08\\x0b-\\x1f\\x7f]', '', 'g'), '[ \\t]+', ' ', 'g').regexp_replace('\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents".replace("{{3,}}", "{3,}"))
def text_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id", structure.clean_text(F.col("text")).alias("text"))


@_add(r"SELECT doc_id, len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+|[^\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{000b}]'))::INT AS tokens FROM documents")
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


_BLOCKS = "k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS block_no, text FROM (SELECT doc_id, p, regexp_replace(s[p], '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10) || chr(10))) + 1)) AS p FROM documents)) WHERE text <> '')"


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return structure.plain_blocks(_read(spark, folder, "documents"))


@_add(f"WITH {_BLOCKS} SELECT doc_id, block_no::INT AS block_no, text FROM k")
def plain_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return _blocks(spark, folder)


_OFFSETS = f"{_BLOCKS}, o AS (SELECT doc_id, block_no, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_offset FROM k)"


@_add(f"WITH {_OFFSETS} SELECT doc_id, block_no::INT AS block_no, text, start_offset, (start_offset + length(text))::INT AS end_offset FROM o")
def block_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return structure.block_offsets(_blocks(spark, folder))


@_add(f"WITH {_OFFSETS}, t AS (SELECT doc_id, max(start_offset + length(text)) AS n FROM o GROUP BY 1), c AS (SELECT doc_id, i AS chunk_id, i * 500 AS s, least(n, i * 500 + 500) AS e FROM (SELECT doc_id, n, unnest(range(0, (n + 499) // 500)) AS i FROM t)) SELECT doc_id, chunk_id::INT AS chunk_id, count(*) AS blocks, min(block_no)::INT AS first_block, max(block_no)::INT AS last_block FROM c JOIN o USING (doc_id) WHERE s < start_offset + length(text) AND e > start_offset GROUP BY ALL")
def chunk_locator_overlap(spark: SparkSession, folder: str) -> DataFrame:
    blocks = structure.block_offsets(_blocks(spark, folder))
    ends = blocks.groupBy("doc_id").agg(F.max("end_offset").alias("n"))
    windows = ends.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 500).cast("int"))).alias("chunk_id")).select("doc_id", "chunk_id", (F.col("chunk_id") * 500).alias("start_offset"), F.least("n", F.col("chunk_id") * 500 + 500).alias("end_offset"))
    return structure.locate_chunks(windows, blocks)


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    once = catalog.delivered_once(_read(spark, folder, "ocr_results"), "ocr_id", "extracted_at")
    return once.select(F.col("ocr_id").alias("doc_id"), F.explode("blocks").alias("b")).select("doc_id", F.col("b.page_number").alias("page_number"), F.col("b.text").alias("text"))


_PAGES = "o AS (SELECT * FROM ocr_results WHERE ocr_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ocr_id ORDER BY extracted_at DESC) = 1), pg AS (SELECT doc_id, b.page_number AS page_number, b.text AS text FROM (SELECT ocr_id AS doc_id, unnest(blocks) AS b FROM o))"


@_add(f"""WITH {_PAGES}, l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda z: trim(z)), lambda z: z <> '') AS x FROM pg),
e AS (SELECT doc_id, unnest(list_concat(x[1:2], CASE WHEN len(x) = 0 THEN [] ELSE x[greatest(len(x) - 1, 1):] END)) AS z FROM l), k AS (SELECT doc_id, trim(regexp_replace(lower(trim(regexp_replace(z, '\\s+', ' ', 'g'))), '(?:^|\\s)[-—]?\\s*\\d+\\s*[-—]?(?:\\s|$)', ' # ', 'g')) AS key FROM e),
c AS (SELECT doc_id, key, count(*) AS times FROM k WHERE key <> '' AND length(key) <= 80 GROUP BY ALL), n AS (SELECT doc_id, count(*) AS pages FROM pg GROUP BY 1 HAVING count(*) >= 3)
SELECT doc_id, key, times FROM c JOIN n USING (doc_id) WHERE times >= greatest(3, floor(pages * 0.6 + 0.999))""")
def repeated_margins(spark: SparkSession, folder: str) -> DataFrame:
    return structure.repeated_margins(_pages(spark, folder))


@_add()
def line_repair(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("doc_id", "page_number", structure.reflowed(F.col("text")).alias("text"))


@_add()
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select("unit_id", F.posexplode(structure.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@_add()
def markdown_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return structure.markdown_blocks(_read(spark, folder, "documents").select("doc_id", "text"))


_NUM = r"^(?:第\s*[零〇一二两三四五六七八九十百千万亿0-9]+\s*[条款]|(?:article|section|clause)\s+[a-z0-9_.-]+|\d+(?:\.\d+)+)"
_HEAD = r"^(?:第\s*[零〇一二两三四五六七八九十百千万亿0-9]+\s*[编章节]|#{1,6}\s*|\d+(?:\.\d+)*\s+[a-z\x{3400}-\x{9fff}])"
_NUM, _HEAD = (p.replace(r"\s", sql.BLANK).replace(r"\d", r"\p{Nd}") for p in (_NUM, _HEAD))
_EXC = "^(?:但是|但书|除非|例外|except|unless)"
_WARN, _TROUBLE, _PARAM = "^(?:危险|警告|注意|重要|danger|warning|caution|notice)", "^(?:故障|问题|症状|原因|解决方案|troubleshoot|symptom)", "^(?:参数|规格|型号|额定|默认值|取值范围|parameter|specification)"
_STEP = r"^(?:步骤\s*[零〇一二三四五六七八九十0-9]+|第\s*[零〇一二三四五六七八九十0-9]+\s*步|step\s+\d+|\d+[.)、])".replace(r"\s", sql.BLANK).replace(r"\d", r"\p{Nd}")


@_add(f"""WITH b AS (SELECT unit_id, document_version_id, unit_no, text, CASE s.content_profile WHEN 'regulation' THEN 'r' WHEN 'manual' THEN 'm' WHEN 'technical_doc' THEN 'm' ELSE 'e' END AS p FROM {_U} u JOIN sources s ON s.id = u.source_id),
t AS (SELECT *, CASE WHEN p = 'r' THEN CASE WHEN regexp_matches(text, '{_HEAD}', 'i') THEN 'heading' WHEN regexp_matches(text, '{_NUM}', 'i') THEN 'numbered_clause' WHEN regexp_matches(text, '{_EXC}', 'i') THEN 'exception' ELSE 'paragraph' END
 WHEN p = 'm' THEN CASE WHEN regexp_matches(text, '{_WARN}', 'i') THEN 'warning' WHEN regexp_matches(text, '{_TROUBLE}', 'i') THEN 'troubleshooting_entry' WHEN regexp_matches(text, '{_PARAM}', 'i') THEN 'parameter_table' WHEN regexp_matches(text, '{_HEAD}', 'i') THEN 'heading' WHEN regexp_matches(text, '{_STEP}', 'i') THEN 'procedure_step' ELSE 'paragraph' END
 ELSE CASE WHEN regexp_matches(text, '{_HEAD}', 'i') THEN 'heading' ELSE 'paragraph' END END AS structure_type, nullif(replace(regexp_extract(text, '({_NUM})', 1, 'i'), ' ', ''), '') AS anchor FROM b)
SELECT unit_id, structure_type, anchor, last_value(CASE WHEN structure_type = 'heading' THEN left(replace(text, chr(10), ' '), 256) END IGNORE NULLS) OVER w AS heading,
 last_value(CASE WHEN structure_type = 'heading' THEN 'block:' || unit_no WHEN structure_type IN ('numbered_clause', 'procedure_step', 'troubleshooting_entry') THEN coalesce(anchor, 'block:' || unit_no) END IGNORE NULLS) OVER w AS boundary
FROM t WINDOW w AS (PARTITION BY document_version_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def adapt_blocks(spark: SparkSession, folder: str) -> DataFrame:
    s = _read(spark, folder, "sources").select(F.col("id").alias("source_id"), F.col("content_profile").alias("profile"))
    rows = _units(spark, folder).join(s, "source_id").select("unit_id", F.col("document_version_id").alias("doc_id"), F.col("unit_no").alias("block_no"), "text", "profile")
    return structure.adapt_blocks(rows).select("unit_id", "structure_type", "anchor", "heading", "boundary")


def _profiled(spark: SparkSession, folder: str) -> DataFrame:
    s = _read(spark, folder, "sources").select(F.col("id").alias("source_id"), "content_profile")
    return structure.profile_units(_units(spark, folder).join(s, "source_id"))


_RULED = [(p, k, x, keep) for p, rules in structure.UNIT_RULES.items() for k, x, keep in rules]
_STRIP_U = f"regexp_replace(text, '^{sql.BLANK}+|{sql.BLANK}+$', '', 'g')"
_ART, _PRT = (x.replace("(?U)", "").replace(r"\s", sql.BLANK) for x in (structure.ARTICLE, structure.PART))
_KIND = "CASE " + " ".join(f"WHEN cp = '{p}' AND regexp_matches(t, '{x}') THEN '{k}'" for p, k, x, _ in _RULED) + f" WHEN cp = 'regulation' AND regexp_matches(t, '{_PRT}') THEN 'heading' WHEN cp = 'regulation' AND regexp_matches(t, '{_ART}') THEN 'numbered_clause' WHEN cp = 'regulation' AND regexp_matches(t, '{structure.SUB_CLAUSE}') THEN 'sub_clause' ELSE kind END"
_KEEP = "CASE " + " ".join(f"WHEN cp = '{p}' AND regexp_matches(t, '{x}') THEN {'true' if keep else 'coalesce(protected, false)'}" for p, _, x, keep in _RULED) + f" WHEN cp = 'regulation' AND (regexp_matches(t, '{_PRT}') OR regexp_matches(t, '{_ART}')) THEN true ELSE coalesce(protected, false) END"


@_add(f"""WITH a AS (SELECT u.*, s.content_profile AS cp, {_STRIP_U} AS t FROM {_U} u JOIN sources s ON s.id = u.source_id),
o AS (SELECT *, CASE WHEN regexp_matches(t, '{_PRT}') THEN '' WHEN regexp_matches(t, '{_ART}') THEN 'article:' || regexp_replace(regexp_extract(t, '{_ART}'), '\\s+', '', 'g') END AS op FROM a)
SELECT unit_id, {_KIND} AS unit_kind, {_KEEP} AS unit_protected, CASE WHEN cp = 'regulation' THEN coalesce(nullif(last_value(op IGNORE NULLS) OVER (PARTITION BY document_version_id ORDER BY unit_no, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ''), hard_boundary_key) ELSE hard_boundary_key END AS article_key FROM o""")
def profiled_units(spark: SparkSession, folder: str) -> DataFrame:
    return _profiled(spark, folder).select("unit_id", "unit_kind", "unit_protected", "article_key")


_STRIPPED = f"regexp_replace(text, '^{sql.BLANK}+|{sql.BLANK}+$', '', 'g')"
_SECTION, _ARTICLE = (p.replace("(?U)", "").replace(r"\s", sql.BLANK).replace(r"\d", r"\p{Nd}") for p in (structure.SECTION_NUMBER, structure.ARTICLE))
_PART = r"^第\s*[零〇一二两三四五六七八九十百千万亿0-9]+\s*[编章节款]".replace(r"\s", sql.BLANK)


@_add(rf"""SELECT unit_id, nullif(replace(regexp_extract(t, '{_SECTION}', 1), ' ', ''), '') AS section,
CASE WHEN regexp_matches(t, '{_ARTICLE}') THEN 'numbered_clause' WHEN regexp_matches(t, '{_PART}') THEN 'heading' WHEN regexp_matches(t, '^(?:[（(][一二三四五六七八九十0-9]+[）)]|\d+[.)、])') THEN 'sub_clause' ELSE kind END AS line_kind FROM (SELECT *, {_STRIPPED} AS t FROM {_U})""")
def section_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select("unit_id", structure.section_number(F.col("text")).alias("section"), structure.line_kind(F.col("text"), F.col("kind")).alias("line_kind"))


_SCORES = ", ".join("{'s': -(" + " + ".join(f"least(3, len(regexp_extract_all(text, '{p}')))" for p in v) + f"), 'p': '{k}'}}" for k, v in structure.PROFILE_SIGNALS.items())


@_add(f"""WITH a AS (SELECT doc_id, list_sort([{_SCORES}]) AS o FROM documents), b AS (SELECT doc_id, o[1] AS x, o[2] AS y, -list_sum(list_transform(o, lambda z: z.s)) AS n FROM a)
SELECT doc_id, CASE WHEN x.s = 0 OR x.s = y.s OR -x.s / greatest(n, 1)::DOUBLE < 0.55 THEN 'general_prose' ELSE x.p END AS profile, round(-x.s / greatest(n, 1)::DOUBLE, 6) AS confidence FROM b""")
def content_profiles(spark: SparkSession, folder: str) -> DataFrame:
    got = _read(spark, folder, "documents").select("doc_id", structure.assess_profile(F.col("text")).alias("a"))
    return got.select("doc_id", "a.profile", F.round("a.confidence", 6).alias("confidence"))


# -- chunking ---------------------------------------------------------------

_PAIR = f"z AS (SELECT unit_id, coalesce(token_count, 0) AS n, kind, lag(kind) OVER w AS k0, section_number AS s1, lag(section_number) OVER w AS s0, heading_path AS h1, lag(heading_path) OVER w AS h0, page_number AS p1, lag(page_number) OVER w AS p0, lag(unit_id) OVER w AS u0, text AS t1, lag(text) OVER w AS t0 FROM {_U} WINDOW w AS (PARTITION BY document_version_id ORDER BY unit_no, unit_id))"
_ROLE = "'warning', 'step', 'table', 'code', 'api_section', 'parameter'"
_PRESS = "greatest(0, least(1, (n - 150) / 550.0::DOUBLE))"


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("document_version_id").orderBy("unit_no", "unit_id")
    cols = {"kind": "k0", "section_number": "s0", "heading_path": "h0", "page_number": "p0", "unit_id": "u0", "text": "t0"}
    return _units(spark, folder).withColumn("n", F.coalesce("token_count", F.lit(0))).select("*", *[F.lag(c).over(w).alias(a) for c, a in cols.items()]).where("u0 is not null")


@_add(f"SELECT unit_id, round({_PRESS}, 6) AS pressure, round(CASE WHEN n < 150 THEN 0.80 WHEN n <= 400 THEN 0.58 + 0.10 * (1.0 - (n - 150) / 250.0::DOUBLE) ELSE greatest(0.30, 0.58 - 0.24 * (n - 400) / 300.0::DOUBLE) END::DOUBLE, 6) AS threshold FROM (SELECT unit_id, coalesce(token_count, 0) AS n FROM {_U})")
def dynamic_threshold(spark: SparkSession, folder: str) -> DataFrame:
    u = _units(spark, folder).withColumn("n", F.coalesce("token_count", F.lit(0)))
    return u.select("unit_id", F.round(chunking.length_pressure(F.col("n")), 6).alias("pressure"), F.round(chunking.dynamic_threshold(F.col("n")), 6).alias("threshold"))


@_add(f"""WITH {_PAIR}, t AS (SELECT unit_id, list_transform(regexp_extract_all(t0, '[\\x{{3400}}-\\x{{9fff}}]|[A-Za-z0-9_]{{2,}}'), lambda x: lower(x)) AS a, list_transform(regexp_extract_all(t1, '[\\x{{3400}}-\\x{{9fff}}]|[A-Za-z0-9_]{{2,}}'), lambda x: lower(x)) AS b FROM z WHERE u0 IS NOT NULL),
l AS (SELECT unit_id, unnest(a) AS w, 1 AS x, 0 AS y FROM t UNION ALL SELECT unit_id, unnest(b), 0, 1 FROM t), c AS (SELECT unit_id, w, sum(x) AS x, sum(y) AS y FROM l GROUP BY ALL), d AS (SELECT unit_id, sum(x * y)::DOUBLE AS dot, sqrt(sum(x * x)) * sqrt(sum(y * y)) AS nrm FROM c GROUP BY 1)
SELECT t.unit_id, round(coalesce(dot / nullif(nrm, 0), 0), 6) AS similarity FROM t LEFT JOIN d USING (unit_id)""")
def lexical_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return text.term_cosines(_pairs(spark, folder), "unit_id", "t0", "text", 6)


@_add(f"""WITH {_PAIR}, f AS (SELECT unit_id, n, CASE WHEN k0 = kind THEN 0.05 WHEN k0 IN ('prose', 'sub_clause', 'paragraph') AND kind IN ('prose', 'sub_clause', 'paragraph') THEN 0.20 ELSE 0.60 END AS st, CASE WHEN k0 = kind THEN 0.0 WHEN k0 IN ({_ROLE}) OR kind IN ({_ROLE}) THEN 1.0 ELSE 0.45 END AS ro,
CASE WHEN length(s1) > 0 AND length(s0) > 0 AND s0 <> s1 THEN 1.0 WHEN length(s1) > 0 AND s0 IS DISTINCT FROM s1 THEN 0.80 WHEN h0 IS DISTINCT FROM h1 THEN 0.90 WHEN p0 > 0 AND p1 > 0 AND p0 <> p1 THEN 0.20 ELSE 0.0 END AS ma FROM z WHERE u0 IS NOT NULL)
SELECT unit_id, round(0.30 * st::DOUBLE + 0.30 * (1 - coalesce(similarity, 0)) / 2 + 0.20 * {_PRESS} + 0.10 * ma::DOUBLE + 0.10 * ro::DOUBLE, 9) AS score FROM f LEFT JOIN ({_SQL['lexical_cosine']}) USING (unit_id)""")
def boundary_score(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder).join(lexical_cosine(spark, folder), "unit_id", "left")
    c = F.col
    score = chunking.boundary_score(chunking.structure_strength(c("k0"), c("kind")), (1 - F.coalesce("similarity", F.lit(0.0))) / 2, chunking.length_pressure(c("n")), chunking.marker_change(c("s0"), c("section_number"), c("h0"), c("heading_path"), c("p0"), c("page_number")), chunking.role_change(c("k0"), c("kind")))
    return p.select("unit_id", F.round(score, 9).alias("score"))


def _folded(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.link_chunks(chunking.chunk_units(_units(spark, folder)))


@_add()
def semantic_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _folded(spark, folder)


@_add()
def embedded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose semantic gap is that of embeddings."""
    units = _units(spark, folder)
    return chunking.chunk_units(units.join(dense.embed(units, "unit_id", "text"), "unit_id", "left"))


@_add()
def parent_runs(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.parent_runs(_folded(spark, folder))


@_add(f"""WITH c AS {_C} SELECT document_version_id, count(*) AS chunks, round(avg(coalesce(token_count, 0)), 2) AS avg_tokens, round(count(*) FILTER (coalesce(token_count, 0) < 20) / count(*)::DOUBLE, 4) AS tiny_ratio, round((count(*) - count(DISTINCT coalesce(text, ''))) / count(*)::DOUBLE, 4) AS duplicate_ratio,
count(*) >= 5 AND round(count(*) FILTER (coalesce(token_count, 0) < 20) / count(*)::DOUBLE, 4) >= 0.8 AS fragmented, count(*) >= 5 AND round((count(*) - count(DISTINCT coalesce(text, ''))) / count(*)::DOUBLE, 4) >= 0.5 AS repetitive FROM c GROUP BY 1""")
def quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.quality_metrics(_chunks(spark, folder))


@_add("""WITH c AS (SELECT * FROM chunks), l AS (SELECT * FROM c WHERE chunk_level = 'leaf')
SELECT document_version_id, 'empty_text' AS rule, count(*) AS chunks FROM c WHERE trim(coalesce(text, '')) = '' GROUP BY 1 UNION ALL SELECT document_version_id, 'oversized_leaf', count(*) FROM l WHERE token_count > 500 GROUP BY 1 UNION ALL SELECT document_version_id, 'inverted_pages', count(*) FROM c WHERE page_start > page_end GROUP BY 1
UNION ALL SELECT document_version_id, 'duplicate_id', count(*) FROM (SELECT document_version_id, id FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
UNION ALL SELECT document_version_id, 'missing_parent', count(*) FROM l WHERE parent_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c p WHERE p.chunk_level = 'parent' AND p.document_version_id = l.document_version_id AND p.id = l.parent_chunk_id) GROUP BY 1""")
def quality_violations(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.quality_violations(_read(spark, folder, "chunks"), most=500)


@_add(f"""WITH l AS {_L} SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM l o WHERE o.id = l.next_chunk_id) THEN 'unknown_next' ELSE 'not_reciprocal' END AS rule FROM l WHERE next_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM l o WHERE o.id = l.next_chunk_id AND o.previous_chunk_id = l.id)""")
def link_violations(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.link_violations(_read(spark, folder, "chunks"))


# -- questions and evidence ---------------------------------------------------

_PLANS = "(SELECT * FROM query_plans WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY logged_at DESC) = 1)"


def _plans(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.delivered_once(_read(spark, folder, "query_plans"), "query_id", "logged_at")


_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(query), '{c}')" for c in cues) + f" THEN '{n}'" for n, cues in evidence.INTENTS.items()) + " ELSE 'fact' END"


@_add(f"SELECT query_id, CASE WHEN regexp_matches(query, '{evidence.UNSAFE}') THEN 'unsafe' WHEN regexp_matches(query, '{evidence.UNSUPPORTED}') THEN 'unsupported' WHEN regexp_matches(query, '{evidence.CAPABILITY}') THEN 'capability' WHEN regexp_matches(trim(query), '{evidence.SMALL_TALK}') THEN 'small_talk' ELSE 'knowledge' END AS request, {_INTENT} AS intent FROM {_PLANS}")
def intent_router(spark: SparkSession, folder: str) -> DataFrame:
    return _plans(spark, folder).select("query_id", evidence.request_kind(F.col("query")).alias("request"), evidence.intent(F.col("query")).alias("intent"))


_PLAIN = f"trim(regexp_replace(query, '{sql.BLANK}+', ' ', 'g'))"
_CORE = f"regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(q, '{evidence.NAMED_SOURCE}', ''), '{evidence.FORMAT_PHRASE}', ' ', 'g'), '{sql.BLANK}+', ' ', 'g')), '^[ ，,;；。]+|[ ，,;；。]+$', '', 'g')"


@_add(f"SELECT query_id, coalesce(nullif({_CORE}, ''), trim(query)) AS core_query, coalesce(regexp_extract(q, '{evidence.NAMED_SOURCE}', 1), '') AS source_hint FROM (SELECT query_id, query, {_PLAIN} AS q FROM {_PLANS})")
def query_features(spark: SparkSession, folder: str) -> DataFrame:
    got = _plans(spark, folder).select("query_id", evidence.query_features(F.col("query")).alias("f"))
    return got.select("query_id", "f.core_query", F.coalesce("f.source_hint", F.lit("")).alias("source_hint"))


@_add()
def need_parts(spark: SparkSession, folder: str) -> DataFrame:
    return _plans(spark, folder).select("query_id", F.posexplode(evidence.need_parts(F.col("query"))).alias("need_no", "need"))


@_add(f"SELECT query_id, unnest({sql.anchors('n')}) AS anchor FROM (SELECT query_id, {sql.normal('query')} AS n FROM {_PLANS})")
def exact_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return _plans(spark, folder).select("query_id", F.explode(text.exact_anchors(text.normal(F.col("query")))).alias("anchor"))


def _cases(x: str, table: dict[str, list[str]]) -> str:
    return "list_sort(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains({x}, '{c}')" for c in cues) + f" THEN '{n}' END" for n, cues in table.items()) + "], lambda z: z IS NOT NULL))"


@_add(f"SELECT id, array_to_string({_cases('text', evidence.TEMPORAL)}, ',') AS times, array_to_string({_cases('text', evidence.MODALITY)}, ',') AS modalities, array_to_string({_cases('text', {e: [e] for e in evidence.ENTITIES})}, ',') AS entities FROM {_L}")
def semantic_signals(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _leaves(spark, folder).select("id", F.array_join(evidence.all_of(t, evidence.TEMPORAL), ",").alias("times"), F.array_join(evidence.all_of(t, evidence.MODALITY), ",").alias("modalities"), F.array_join(evidence.entities(t), ",").alias("entities"))


_SUBJECT = "CASE " + " ".join(f"WHEN contains(s, '{e}') THEN '{e}'" for e in evidence.ENTITIES) + " ELSE '' END"
_LEADING = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(s, '{c}')" for c in cues) + f" THEN '{n}'" for n, cues in evidence.MODALITY.items()) + " ELSE 'fact' END"


@_add(f"SELECT id, s AS sentence, {_SUBJECT} AS subject, {_LEADING} AS modality, array_to_string({_cases('s', evidence.TEMPORAL)}, ',') AS temporal FROM (SELECT id, trim(unnest(regexp_extract_all(text, '[^。！？!?；;\\n]+[。！？!?；;]?'))) AS s FROM {_L}) WHERE s <> ''")
def propositions(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.propositions(_leaves(spark, folder).select("id", "text")).select("id", "sentence", F.coalesce("subject", F.lit("")).alias("subject"), "modality", "temporal")


_TOP10 = f"b AS ({_SQL['bm25_top30']}), t AS (SELECT query_id, id FROM b WHERE rank <= 5)"
_GRADES = f"""l AS {_L}, {_TOP10}, n AS (SELECT item_id AS need_id, {sql.content(sql.normal('query'))} AS q, {sql.anchors(sql.normal('query'))} AS qa, {_cases('query', evidence.ASKED_TIMES)} AS qt FROM eval_items),
e AS (SELECT t.query_id AS need_id, {sql.content(sql.normal('l.text'))} AS p, {sql.anchors(sql.normal('l.text'))} AS pa, {_cases('l.text', evidence.TEMPORAL)} AS pt FROM t JOIN l ON l.id = t.id),
j AS (SELECT n.need_id, CASE WHEN p IS NOT NULL AND len(list_intersect(qa, pa)) = len(qa) AND len(list_intersect(qt, pt)) = len(qt) THEN coalesce(len(list_intersect(q, p)) / nullif(len(q), 0)::DOUBLE, 0) ELSE 0.0 END AS share FROM n LEFT JOIN e USING (need_id)),
g AS (SELECT need_id, round(max(share), 6)::DOUBLE AS coverage, count(*) FILTER (share >= 0.35) AS supporting FROM j GROUP BY 1)"""


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    hits = bm25_top30(spark, folder).where("rank <= 5").join(_leaves(spark, folder).select("id", "text"), "id").select(F.col("query_id").alias("need_id"), F.col("id").alias("chunk_id"), "text")
    return evidence.grade_needs(_questions(spark, folder).withColumnRenamed("query_id", "need_id"), hits)


@_add(f"WITH {_GRADES} SELECT need_id, CASE WHEN supporting > 0 THEN 'supported' WHEN coverage > 0 THEN 'partial' ELSE 'unsupported' END AS grade, coverage, supporting FROM g")
def need_grading(spark: SparkSession, folder: str) -> DataFrame:
    return _graded(spark, folder)


@_add(f"WITH {_GRADES}, x AS (SELECT lang, CASE WHEN supporting > 0 THEN 's' WHEN coverage > 0 THEN 'p' ELSE 'u' END AS v FROM g JOIN eval_items ON item_id = need_id) SELECT lang AS query_id, CASE WHEN count(*) FILTER (v = 's') = count(*) THEN 'complete' WHEN count(*) FILTER (v <> 'u') > 0 THEN 'partial' ELSE 'insufficient' END AS decision FROM x GROUP BY 1")
def coverage_decision(spark: SparkSession, folder: str) -> DataFrame:
    lang = _read(spark, folder, "eval_items").select(F.col("item_id").alias("need_id"), F.col("lang").alias("query_id"))
    return evidence.coverage_decision(_graded(spark, folder).join(lang, "need_id"))


@_add()
def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    items = _read(spark, folder, "eval_items").where("reference_answer is not null")
    rows = evidence.claims(items.select(F.col("item_id").alias("answer_id"), F.col("reference_answer").alias("text")))
    return rows.join(items.select(F.col("item_id").alias("answer_id"), "passage"), "answer_id").select("answer_id", "claim_no", evidence.claim_support(F.col("claim"), F.col("passage")).alias("verdict"))


@_add(f"SELECT query_id, round(coalesce(1.0 - len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0), 6) AS drift FROM (SELECT query_id, {sql.content(sql.normal('query'))} AS a, {sql.content(sql.normal('core_query'))} AS b FROM {_PLANS})")
def rewrite_drift(spark: SparkSession, folder: str) -> DataFrame:
    return _plans(spark, folder).select("query_id", F.round(evidence.rewrite_drift(F.col("query"), F.col("core_query")), 6).alias("drift"))


# -- evaluation ---------------------------------------------------------------


@_add("""WITH r AS (SELECT item_id, list_transform(regexp_extract_all(lower(coalesce(reference_answer, '')), '[\\x{3400}-\\x{9fff}]|[A-Za-z0-9_]+'), lambda x: x) AS a, regexp_extract_all(lower(coalesce(passage, '')), '[\\x{3400}-\\x{9fff}]|[A-Za-z0-9_]+') AS b FROM eval_items),
l AS (SELECT item_id, unnest(a) AS w, 1 AS x, 0 AS y FROM r UNION ALL SELECT item_id, unnest(b), 0, 1 FROM r), c AS (SELECT item_id, w, least(sum(x), sum(y)) AS c FROM l GROUP BY ALL), s AS (SELECT item_id, sum(c) AS c FROM c GROUP BY 1)
SELECT r.item_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(c, 0) / (len(a) + len(b))::DOUBLE END::DOUBLE, 6) AS f1, a = b AS exact FROM r LEFT JOIN s USING (item_id)""")
def answer_token_f1(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.token_f1(_read(spark, folder, "eval_items"), "item_id", "reference_answer", "passage")


@_add(f"WITH {_GRADES}, x AS (SELECT should_refuse AS s, supporting = 0 AS r FROM g JOIN eval_items ON item_id = need_id) SELECT count(*) FILTER (s AND r) AS correct, count(*) FILTER (NOT s AND r) AS false_refusals, count(*) FILTER (s AND NOT r) AS missed FROM x")
def refusal_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _graded(spark, folder).select(F.col("need_id").alias("item_id"), (F.col("supporting") == 0).alias("refused"))
    return metrics.refusal_counts(rows.join(_read(spark, folder, "eval_items").select("item_id", "should_refuse"), "item_id"))


@_add("WITH b AS (SELECT event_type AS metric, round(avg(value) FILTER (event_id % 2 = 0), 6) AS b, round(avg(value) FILTER (event_id % 2 = 1), 6) AS c FROM events GROUP BY 1) SELECT metric, round(c - b, 6) AS delta, coalesce(round(c - b, 6) >= 0, false) AS passed FROM b")
def report_compare(spark: SparkSession, folder: str) -> DataFrame:
    e = _read(spark, folder, "events")
    half = lambda k: e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg(F.when(F.col("event_id") % 2 == k, F.col("value"))), 6).alias("value"))
    return metrics.compare_reports(half(0), half(1), e.select(F.col("event_type").alias("metric")).distinct().withColumn("min_delta", F.lit(0.0)))


@_add("SELECT event_type, count(value) AS observations, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def metric_series(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.observation_series(_read(spark, folder, "events"), "event_type", "value")


# -- catalogue ----------------------------------------------------------------


@_add("SELECT tenant_id, document_id, id, version_number FROM document_versions QUALIFY row_number() OVER (PARTITION BY tenant_id, document_id ORDER BY version_number DESC, id DESC) = 1")
def active_versions(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.active_versions(_read(spark, folder, "document_versions")).select("tenant_id", "document_id", "id", "version_number")


@_add(f"SELECT c.id, c.document_version_id, c.ordinal FROM {_C} c WHERE document_version_id IN (SELECT id FROM document_versions QUALIFY row_number() OVER (PARTITION BY tenant_id, document_id ORDER BY version_number DESC, id DESC) = 1) AND source_id IN (SELECT id FROM sources WHERE is_active)")
def active_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.active_chunks(_read(spark, folder, "chunks"), _read(spark, folder, "document_versions"), _read(spark, folder, "sources")).select("id", "document_version_id", "ordinal")


_MANIFEST = "(SELECT * FROM manifests WHERE index_version_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_version_id ORDER BY loaded_at DESC) = 1)"


@_add(f"""WITH f AS (SELECT * FROM {_MANIFEST} QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY created_at, index_version_id) = 1), s AS (SELECT name, max(a) AS a FROM (SELECT unnest(map_keys(child_content_hashes)) AS name, unnest(map_values(child_content_hashes)) AS a FROM f) GROUP BY 1), t AS (SELECT id AS name, content_hash AS b FROM {_L}),
j AS (SELECT coalesce(s.name, t.name) AS name, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unexpected' WHEN a <> b THEN 'changed' ELSE 'ok' END AS state FROM s FULL JOIN t ON s.name = t.name) SELECT * FROM j WHERE state <> 'ok'""")
def manifest_verify(spark: SparkSession, folder: str) -> DataFrame:
    """The first manifest of each collection against the leaves there are today."""
    w = Window.partitionBy("collection_id").orderBy("created_at", "index_version_id")
    first = _manifests(spark, folder).withColumn("n", F.row_number().over(w)).where("n = 1")
    stated = first.select(F.explode("child_content_hashes").alias("name", "checksum")).groupBy("name").agg(F.max("checksum").alias("checksum"))
    return catalog.verify_artifacts(stated, _leaves(spark, folder).select(F.col("id").alias("name"), F.col("content_hash").alias("checksum")))


def _manifests(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.delivered_once(_read(spark, folder, "manifests"), "index_version_id", "loaded_at")


@_add("""SELECT index_version_id, record_kind, record_id, change FROM (
WITH m AS (SELECT * FROM manifests WHERE index_version_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY index_version_id ORDER BY loaded_at DESC) = 1),
s AS (SELECT index_version_id, collection_id, row_number() OVER (PARTITION BY collection_id ORDER BY created_at, index_version_id) AS seq FROM m),
r AS (SELECT index_version_id, 'chunk' AS record_kind, record_id, child_content_hashes[record_id] AS v FROM (SELECT index_version_id, child_content_hashes, unnest(list_distinct(chunk_ids)) AS record_id FROM m)
 UNION ALL SELECT index_version_id, 'document', k, source_document_fingerprints[k] FROM (SELECT index_version_id, source_document_fingerprints, unnest(map_keys(source_document_fingerprints)) AS k FROM m)),
x AS (SELECT r.*, collection_id, seq FROM r JOIN s USING (index_version_id)),
j AS (SELECT coalesce(a.collection_id, b.collection_id) AS c, coalesce(b.seq, a.seq + 1) AS seq, coalesce(a.record_kind, b.record_kind) AS record_kind, coalesce(a.record_id, b.record_id) AS record_id, a.record_id IS NULL AS new_, b.record_id IS NULL AS gone, a.v AS va, b.v AS vb
 FROM x a FULL JOIN x b ON a.collection_id = b.collection_id AND a.record_kind = b.record_kind AND a.record_id = b.record_id AND b.seq = a.seq + 1)
SELECT s.index_version_id, record_kind, record_id, CASE WHEN new_ THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change FROM j JOIN s ON s.collection_id = j.c AND s.seq = j.seq
WHERE j.seq > 1 AND (new_ OR gone OR va IS DISTINCT FROM vb))""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.manifest_changes(_read(spark, folder, "manifests"))


# -- index texts and reports --------------------------------------------------


@_add()
def index_texts(spark: SparkSession, folder: str) -> DataFrame:
    return index_text.index_texts(_leaves(spark, folder))


@_add(f"WITH g AS (SELECT document_version_id, arg_min(heading_path[len(heading_path)], (ordinal, id)) FILTER (len(heading_path) > 0 AND heading_path[len(heading_path)] IS NOT NULL) AS h, count(*) AS chunks, sum(coalesce(token_count, 0))::BIGINT AS tokens FROM {_C} GROUP BY 1) SELECT document_version_id, coalesce(h, regexp_replace(original_filename, '\\.[^.]*$', '')) AS title, chunks, tokens FROM g LEFT JOIN document_versions v ON v.id = document_version_id")
def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    return index_text.document_titles(_chunks(spark, folder), _read(spark, folder, "document_versions"))


@_add(f"SELECT document_version_id, coalesce(min(page_number), 0) AS first_page, coalesce(max(page_number), 0) AS last_page, count(*) AS units, CASE WHEN min(hard_boundary_key) = max(hard_boundary_key) AND count(hard_boundary_key) = count(*) THEN min(hard_boundary_key) END AS boundary FROM {_U} GROUP BY 1")
def version_spans(spark: SparkSession, folder: str) -> DataFrame:
    got = index_text.merged_locators(_units(spark, folder), "document_version_id").drop("common_path")
    return got.withColumn("first_page", F.coalesce("first_page", F.lit(0))).withColumn("last_page", F.coalesce("last_page", F.lit(0)))


@_add("SELECT document_version_id, code, min(ordinal) AS first_ordinal FROM (SELECT document_version_id, ordinal, trim(unnest(string_split(boundary_reason, ','))) AS code FROM chunks) WHERE code <> '' GROUP BY ALL")
def degradation_codes(spark: SparkSession, folder: str) -> DataFrame:
    return index_text.degradation_codes(_read(spark, folder, "chunks"), "document_version_id", "boundary_reason")


@_add("SELECT string_agg(v, '+' ORDER BY v) AS chunker_version FROM (SELECT DISTINCT chunker_version AS v FROM chunks)")
def population_version(spark: SparkSession, folder: str) -> DataFrame:
    return index_text.population_version(_read(spark, folder, "chunks"))


@_add(f"WITH x AS (SELECT DISTINCT document_version_id, left(coalesce(nullif(retrieval_text, ''), text), 12) AS p, text FROM {_L} WHERE length(coalesce(nullif(retrieval_text, ''), text)) >= 12) SELECT document_version_id, count(*) AS bodies FROM x GROUP BY document_version_id, p HAVING count(*) >= 2")
def shared_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return index_text.shared_prefixes(_leaves(spark, folder), 12, 2).select("document_version_id", "bodies")


@_add()
def shared_prefix_violations(spark: SparkSession, folder: str) -> DataFrame:
    """The rule itself: 320 characters, four bodies."""
    return index_text.shared_prefixes(_leaves(spark, folder)).select("document_version_id", "bodies")


@_add(f"WITH l AS {_L}, p AS (SELECT id FROM {_C} WHERE chunk_level = 'parent') SELECT count(*) AS leaves, count(*) FILTER (token_count > 400) AS oversized, round(count(*) FILTER (len(heading_path) > 0) / count(*)::DOUBLE, 6) AS heading_ratio, round((count(*) - count(DISTINCT coalesce(text, ''))) / count(*)::DOUBLE, 6) AS duplicate_ratio, round(count(*) FILTER (parent_chunk_id IS NULL OR parent_chunk_id IN (SELECT id FROM p)) / count(*)::DOUBLE, 6) AS parent_integrity FROM l")
def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.chunk_report(_chunks(spark, folder), 400)


@_add(f"""WITH b AS ({_SQL['bm25_top30']}), l AS {_L}, c AS (SELECT query_id, list(DISTINCT source_id) AS cited FROM b JOIN l ON l.id = b.id WHERE rank <= 3 GROUP BY 1), r AS (SELECT item_id, coalesce(cited, []) AS c, list_distinct(expected_source_ids) AS e FROM eval_items LEFT JOIN c ON query_id = item_id)
SELECT item_id, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, e)) / len(c)::DOUBLE WHEN len(e) = 0 THEN 1.0 ELSE 0.0 END, 6) AS precision, round(CASE WHEN len(e) > 0 THEN len(list_intersect(c, e)) / len(e)::DOUBLE ELSE 1.0 END, 6) AS recall, 1.0::DOUBLE AS completeness FROM r""")
def citation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    hits = bm25_top30(spark, folder).where("rank <= 3").join(_leaves(spark, folder).select("id", "source_id"), "id").groupBy(F.col("query_id").alias("item_id")).agg(F.collect_set("source_id").alias("cited"))
    rows = _read(spark, folder, "eval_items").select("item_id", F.col("expected_source_ids").alias("relevant")).join(hits, "item_id", "left")
    rows = rows.select("item_id", "relevant", F.coalesce("cited", F.array().cast("array<string>")).alias("cited"), F.lit(3).alias("claims"), F.lit(3).alias("cited_claims"))
    return metrics.citation_metrics(rows, "item_id")


@_add(f"WITH m AS ({_SQL['retrieval_metrics']}) SELECT 'hit' AS metric, round(avg(hit), 6) AS value, count(hit) AS examples FROM m UNION ALL SELECT 'recall', round(avg(recall), 6), count(recall) FROM m UNION ALL SELECT 'reciprocal_rank', round(avg(reciprocal_rank), 6), count(reciprocal_rank) FROM m UNION ALL SELECT 'ndcg', round(avg(ndcg), 6), count(ndcg) FROM m")
def run_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.run_report(retrieval_metrics(spark, folder), ["hit", "recall", "reciprocal_rank", "ndcg"])


@_add()
def citation_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    items = _read(spark, folder, "eval_items").where("reference_answer is not null")
    answers = items.select(F.col("item_id").alias("answer_id"), F.concat(F.regexp_replace("reference_answer", r"[。.]$", ""), F.lit("[C1]。")).alias("text"))
    cited = items.select(F.col("item_id").alias("answer_id"), F.lit(1).alias("label"), F.col("passage").alias("text"), F.lit(True).alias("allowed"), F.lit(True).alias("live"))
    return evidence.verify_citations(answers, cited)


@_add()
def support_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "eval_items").where("passage is not null").select("item_id", "passage", text.content_terms(text.normal(F.col("query"))).alias("terms"))
    return rows.select("item_id", evidence.support_excerpt(F.col("passage"), F.col("terms")).alias("excerpt"))


@_add()
def context_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.context_blocks(_charged(spark, folder))


@_add(f"SELECT id, tenant_id, source_id FROM {_C} WHERE tenant_id = 'tenant-metro' AND source_id IN ('src-metro-signal', 'src-cold-chain')")
def scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.in_scope(_chunks(spark, folder), F.lit("tenant-metro"), F.array(F.lit("src-metro-signal"), F.lit("src-cold-chain"))).select("id", "tenant_id", "source_id")


# -- plans of questions --------------------------------------------------------


_Q = f"(SELECT query_id, query, trim(regexp_replace({sql.nfkc('query')}, '{sql.BLANK}+', ' ', 'g')) AS n FROM {_PLANS})"


@_add(f"SELECT query_id, list_sort(string_split(trim(concat_ws(' ', n, array_to_string({sql.anchors('lower(n)')}, ' '))), ' ')) AS words FROM {_Q}")
def normalized_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the normalised questions; their locators stand behind them."""
    got = _plans(spark, folder).select("query_id", evidence.normalized_query(F.col("query")).alias("t"))
    return got.select("query_id", F.array_sort(F.split("t", " ")).alias("words"))


_FORMAT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(query), '{c}')" for c in cues) + f" THEN '{n}'" for n, cues in evidence.FORMATS.items()) + " ELSE 'auto' END"
_ITEMS = "nullif(CASE WHEN regexp_matches(query, '(?:^|[^0-9])([0-9]{1,2})\\s*(?:项|个|种|steps?|items?)', 'i') THEN least(50, regexp_extract(query, '(?:^|[^0-9])([0-9]{1,2})\\s*(?:项|个|种|steps?|items?)', 1, 'i')::INT) WHEN regexp_matches(query, '[一二两三四五六七八九十]\\s*(?:项|个|种|步|条)') THEN CASE regexp_extract(query, '([一二两三四五六七八九十])\\s*(?:项|个|种|步|条)', 1) WHEN '十' THEN 10 ELSE translate(regexp_extract(query, '([一二两三四五六七八九十])\\s*(?:项|个|种|步|条)', 1), '一二两三四五六七八九', '1223456789')::INT END END, 0)"


@_add(f"SELECT query_id, {_FORMAT} AS format, coalesce(CASE WHEN contains(query, '用英文') OR contains(lower(query), 'in english') THEN 'en' WHEN contains(query, '用中文') OR contains(lower(query), 'in chinese') THEN 'zh-CN' END, '') AS language, contains(lower(query), '引用') OR contains(query, '依据') OR contains(query, '页码') OR contains(lower(query), 'cite') AS citations, coalesce({_ITEMS}, 0) AS items FROM {_PLANS}")
def response_contracts(spark: SparkSession, folder: str) -> DataFrame:
    got = _plans(spark, folder).select("query_id", evidence.response_contract(F.col("query")).alias("c")).select("query_id", "c.*")
    return got.withColumn("language", F.coalesce("language", F.lit(""))).withColumn("items", F.coalesce("items", F.lit(0)))


@_add(f"SELECT query_id, anchor, CASE WHEN regexp_matches(anchor, '^(?:clause|chapter|step):') THEN 'structure_id' ELSE 'error_code' END AS kind FROM (SELECT query_id, unnest(list_slice({sql.anchors('n')}, 1, 32)) AS anchor FROM (SELECT query_id, {sql.normal('query')} AS n FROM {_PLANS}))")
def typed_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return _plans(spark, folder).select("query_id", F.explode(evidence.typed_anchors(text.normal(F.col("query")))).alias("a")).select("query_id", "a.anchor", "a.kind")


@_add(f"SELECT query_id, sha256('plan-1' || chr(0) || query) AS key FROM {_PLANS}")
def planning_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _plans(spark, folder).select("query_id", evidence.planning_key(F.col("query"), "plan-1").alias("key"))


_SENT = f"s AS (SELECT id, no, {_SUBJECT} AS subject, {_LEADING} AS modality, array_to_string({_cases('s', evidence.TEMPORAL)}, ',') AS temporal FROM (SELECT id, trim(unnest(x)) AS s, generate_subscripts(x, 1) AS no FROM (SELECT id, regexp_extract_all(text, '[^。！？!?；;\\n]+[。！？!?；;]?') AS x FROM {_L})) WHERE s <> '')"


@_add(f"""WITH {_SENT}, p AS (SELECT id, no, nullif(subject, '') AS subject, modality, nullif(temporal, '') AS temporal, row_number() OVER (PARTITION BY id ORDER BY no) AS n FROM s)
SELECT a.id, a.n AS left_no, b.n AS right_no, CASE WHEN a.modality = 'exception' OR b.modality = 'exception' THEN 'exception' WHEN coalesce(a.subject <> b.subject, false) OR coalesce(a.temporal <> b.temporal, false) THEN 'different_scope' WHEN (a.modality, b.modality) IN (('required', 'prohibited'), ('prohibited', 'required'), ('permitted', 'prohibited'), ('prohibited', 'permitted')) THEN 'conflict' WHEN a.subject IS NULL OR b.subject IS NULL THEN 'ambiguous' ELSE 'compatible' END AS relation
FROM p a JOIN p b ON a.id = b.id AND a.n < b.n""")
def proposition_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations of the sentences of each leaf, of one predicate."""
    found = evidence.propositions(_leaves(spark, folder).select("id", "text")).withColumn("no", F.row_number().over(Window.partitionBy("id").orderBy("sentence_no")))
    texts = F.array().cast("array<string>")
    rows = found.select(
        "id", "no", "subject", F.lit("states").alias("predicate"), F.lit(None).cast("string").alias("object"), "modality", texts.alias("conditions"),
        F.when(F.col("modality") == "exception", F.array("sentence")).otherwise(texts).alias("exceptions"), F.nullif("temporal", F.lit("")).alias("temporal"), F.lit(None).cast("string").alias("authority"),
    )
    return evidence.proposition_relations(rows, "id")


@_add(f"WITH {_GRADES} SELECT lang AS query_id, round(avg(coverage), 6) AS coverage, coalesce(string_agg(need_id::VARCHAR, ',' ORDER BY need_id) FILTER (supporting = 0), '') AS missing FROM g JOIN eval_items ON item_id = need_id GROUP BY 1")
def evidence_sufficiency(spark: SparkSession, folder: str) -> DataFrame:
    lang = _read(spark, folder, "eval_items").select(F.col("item_id").alias("need_id"), F.col("lang").alias("query_id"))
    return evidence.sufficiency(_graded(spark, folder).join(lang, "need_id")).withColumn("missing", F.array_join(F.transform("missing", lambda n: n.cast("string")), ","))


# -- selection of chunks -------------------------------------------------------


@_add(f"""WITH m AS (SELECT index_version_id, chunk_ids AS c FROM {_MANIFEST} QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC, index_version_id DESC) = 1), i AS (SELECT index_version_id AS list_id, unnest(c) AS id, generate_subscripts(c, 1) - 1 AS place FROM m)
SELECT list_id, place::INT AS place, l.id, l.document_version_id FROM i JOIN {_L} l ON l.id = i.id JOIN sources s ON s.id = l.source_id WHERE s.is_active""")
def retrievable_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the newest manifest of each collection in their order, of active sources."""
    w = Window.partitionBy("collection_id").orderBy(F.desc("created_at"), F.desc("index_version_id"))
    newest = _manifests(spark, folder).withColumn("n", F.row_number().over(w)).where("n = 1")
    ids_ = newest.select(F.col("index_version_id").alias("list_id"), F.posexplode("chunk_ids").alias("place", "id"))
    active = _read(spark, folder, "sources").where("is_active").select(F.col("id").alias("source_id"))
    return catalog.chunks_in_order(ids_, _leaves(spark, folder).join(active, "source_id")).select("list_id", "place", "id", "document_version_id")


@_add(f"""WITH v AS (SELECT id, tenant_id, document_id, version_number, max(version_number) OVER (PARTITION BY tenant_id, document_id) AS top FROM document_versions), l AS (SELECT l.id, l.tenant_id, l.document_id, version_number, top FROM {_L} l JOIN v ON v.id = l.document_version_id)
SELECT id, tenant_id, document_id FROM l WHERE top > 1 AND version_number = top UNION ALL SELECT id, tenant_id, document_id FROM l WHERE version_number = 1 AND (tenant_id, document_id) NOT IN (SELECT (tenant_id, document_id) FROM l WHERE top > 1 AND version_number = top)""")
def published_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """An index of first versions after the newest later versions were published."""
    w = Window.partitionBy("tenant_id", "document_id")
    v = _read(spark, folder, "document_versions").withColumn("top", F.max("version_number").over(w)).select(F.col("id").alias("document_version_id"), "version_number", "top")
    rows = _leaves(spark, folder).select("id", "tenant_id", "document_id", "document_version_id").join(v, "document_version_id")
    cols = ["id", "tenant_id", "document_id"]
    return catalog.rebuilt(catalog.published_chunks(rows.where("version_number = 1").select(*cols), rows.where("top > 1 AND version_number = top").select(*cols)))


@_add(f"SELECT collection_id, index_version_id FROM {_MANIFEST} QUALIFY row_number() OVER (PARTITION BY collection_id ORDER BY created_at DESC, index_version_id DESC) > 3")
def outdated_indexes(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.outdated(_manifests(spark, folder), "collection_id", "index_version_id", "created_at", 3)


@_add(f"""WITH a AS ({_SQL['content_profiles']}) SELECT doc_id, CASE WHEN content_profile IS NOT NULL THEN content_profile WHEN confidence >= 0.55 THEN profile ELSE 'general_prose' END AS profile, CASE WHEN content_profile IS NOT NULL THEN 'source_explicit' WHEN confidence >= 0.55 THEN 'content_profiler' ELSE 'fallback' END AS method, coalesce(content_profile <> profile AND confidence >= 0.8, false) AS mismatch
FROM a JOIN (SELECT doc_id, CASE WHEN title IS NOT NULL THEN content_profile END AS content_profile FROM documents) USING (doc_id)""")
def profile_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions where titled documents state their profile and the others are assessed."""
    stated = _read(spark, folder, "documents").select("doc_id", F.when(F.col("title").isNotNull(), F.col("content_profile")).alias("stated"))
    rows = content_profiles(spark, folder).join(stated, "doc_id")
    return rows.select("doc_id", structure.profile_decision(F.col("stated"), F.col("profile"), F.col("confidence")).alias("d")).select("doc_id", "d.profile", "d.method", "d.mismatch")


@_add()
def structured_units(spark: SparkSession, folder: str) -> DataFrame:
    return structure.structured_units(structure.markdown_blocks(_read(spark, folder, "documents").select("doc_id", "text")))


def _profiled_chunks(spark: SparkSession, folder: str) -> DataFrame:
    s = _read(spark, folder, "sources").select(F.col("id").alias("source_id"), "content_profile")
    return _chunks(spark, folder).join(s, "source_id", "left")


_ARTICLES = f"list_distinct(list_transform(regexp_extract_all(text, '(?:^|\\n)\\s*(第\\s*[{sql.NUMERAL}]+\\s*条)', 1), lambda x: regexp_replace(x, '\\s+', '', 'g')))"


@_add(f"""WITH l AS (SELECT c.*, s.content_profile AS cp FROM {_L} c LEFT JOIN sources s ON s.id = c.source_id), v AS (SELECT document_version_id, count(*) AS chunks, count(*) FILTER (coalesce(token_count, 0) < 20) / count(*)::DOUBLE AS tiny, 1 - count(DISTINCT coalesce(text, '')) / count(*)::DOUBLE AS twice FROM l GROUP BY 1), a AS (SELECT document_version_id, hard_boundary_key AS k, len({_ARTICLES}) AS n FROM l WHERE cp = 'regulation')
SELECT document_version_id, 'all_tiny' AS rule, chunks FROM v WHERE chunks >= 10 AND tiny >= 0.95 UNION ALL SELECT document_version_id, 'all_duplicates', chunks FROM v WHERE chunks >= 10 AND twice >= 0.8 UNION ALL SELECT document_version_id, 'several_articles', count(*) FROM a WHERE n > 1 GROUP BY 1 UNION ALL SELECT document_version_id, 'missing_article_key', count(*) FROM a WHERE n > 0 AND NOT coalesce(starts_with(k, 'article:'), false) GROUP BY 1""")
def version_faults(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.version_faults(_profiled_chunks(spark, folder))


_TYPES = " OR ".join(f"(cp = '{p}' AND unit_type IN ({', '.join(repr(k) for k in kinds)}))" for p, kinds in chunking.EXPECTED_TYPES.items())


@_add(f"""WITH l AS (SELECT c.*, s.content_profile AS cp, row_number() OVER (PARTITION BY document_version_id ORDER BY ordinal, c.id) AS n FROM {_L} c LEFT JOIN sources s ON s.id = c.source_id)
SELECT document_version_id, 'possible_table_of_contents' AS warning FROM l WHERE n <= 3 AND (contains(text, '目录') OR contains(lower(text), 'table of contents')) GROUP BY 1
UNION ALL SELECT document_version_id, 'content_profile_signal_weak' FROM l GROUP BY 1 HAVING bool_or(cp IN ({', '.join(repr(p) for p in chunking.EXPECTED_TYPES)})) AND NOT bool_or(coalesce({_TYPES}, false))""")
def quality_warnings(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.quality_warnings(_profiled_chunks(spark, folder))


@_add("SELECT event_id, regexp_replace(t, '(api[_-]?key|authorization|bearer|password|secret)([\"''=:\\s]+)([^\\s,;\"'']+)', '\\1\\2[REDACTED]', 'gi') AS line FROM (SELECT event_id, 'user ' || user_id || ' API_KEY=k' || event_id || ', password: \"p' || user_id || '\" ' || props AS t FROM events)")
def redacted_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = F.concat(F.lit("user "), F.col("user_id"), F.lit(" API_KEY=k"), F.col("event_id"), F.lit(', password: "p'), F.col("user_id"), F.lit('" '), F.col("props"))
    return _read(spark, folder, "events").select("event_id", evidence.redacted_line(line).alias("line"))


@_add("SELECT ocr_id, page_number, len(list_filter(map_keys(m), lambda k: NOT contains(lower(k), 'key') AND NOT contains(lower(k), 'token'))) AS names FROM (SELECT ocr_id, b.page_number AS page_number, map_concat(coalesce(b.metadata, MAP {}), MAP {'Api-Key': 'x', 'tokens': 'y', 'kind': coalesce(b.kind, '')}) AS m FROM (SELECT ocr_id, unnest(blocks) AS b FROM (SELECT * FROM ocr_results WHERE ocr_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ocr_id ORDER BY extracted_at DESC) = 1)))")
def safe_metadata(spark: SparkSession, folder: str) -> DataFrame:
    once = catalog.delivered_once(_read(spark, folder, "ocr_results"), "ocr_id", "extracted_at").select("ocr_id", F.explode("blocks").alias("b"))
    stated = F.coalesce("b.metadata", F.create_map().cast("map<string,string>"))
    more = F.create_map(F.lit("Api-Key"), F.lit("x"), F.lit("tokens"), F.lit("y"), F.lit("kind"), F.coalesce("b.kind", F.lit("")))
    return once.select("ocr_id", F.col("b.page_number").alias("page_number"), F.size(evidence.safe_metadata(F.map_concat(F.map_filter(stated, lambda k, _: ~k.isin("Api-Key", "tokens", "kind")), more))).alias("names"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
