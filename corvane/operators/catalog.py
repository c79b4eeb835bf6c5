"""Joins and windows over the versioned tables of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The latest row per key, by the order columns descending; ties by all columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delivered_once(rows: DataFrame, key: str, loaded: str) -> DataFrame:
    """Rows delivered again count once: per key the latest loaded, whole."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(loaded)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def active_versions(versions: DataFrame) -> DataFrame:
    """The highest version of each document."""
    return latest(versions, ["tenant_id", "document_id"], "version_number", "id")


def active_chunks(chunks: DataFrame, versions: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of active versions of active sources, each once."""
    live = active_versions(versions).select(F.col("id").alias("document_version_id"))
    open_ = sources.where("is_active").select(F.col("id").alias("source_id"))
    return delivered_once(chunks, "id", "loaded_at").join(live, "document_version_id", "left_semi").join(open_, "source_id", "left_semi")


def in_scope(rows: DataFrame, tenant: Column, sources: Column, documents: Column | None = None, versions: Column | None = None) -> DataFrame:
    """Rows of the tenant whose source is listed, and whose document and version are, if any are."""
    keep = (F.col("tenant_id") == tenant) & F.array_contains(sources, F.col("source_id"))
    if documents is not None:
        keep &= (F.size(documents) == 0) | F.array_contains(documents, F.col("document_id"))
    if versions is not None:
        keep &= (F.size(versions) == 0) | F.array_contains(versions, F.col("document_version_id"))
    return rows.where(keep)


def fingerprints(chunks: DataFrame) -> DataFrame:
    """(document_version_id, leaves, fingerprint): SHA-256 of a version's sorted leaf hashes.
    The hashes of one version are collected, a document's worth."""
    rows = chunks.where("chunk_level = 'leaf'").select("document_version_id", "id", "content_hash").distinct()
    return rows.groupBy("document_version_id").agg(F.count("*").alias("leaves"), F.sha2(F.array_join(F.array_sort(F.collect_list("content_hash")), "|"), 256).alias("fingerprint"))


def verify_artifacts(stated: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, state): checksums (name, checksum) that are missing, unexpected or changed."""
    a, b = stated.select("name", F.col("checksum").alias("x")), actual.select("name", F.col("checksum").alias("y"))
    state = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").when(F.col("x") != F.col("y"), "changed").otherwise("ok")
    return a.join(b, "name", "full_outer").select("name", state.alias("state")).where("state <> 'ok'")


def link_violations(chunks: DataFrame) -> DataFrame:
    """(id, rule): leaves whose next leaf does not point back, or whose neighbour is unknown."""
    leaves = delivered_once(chunks.where("chunk_level = 'leaf'"), "id", "loaded_at").select("id", "previous_chunk_id", "next_chunk_id")
    other = leaves.select(F.col("id").alias("o"), F.col("previous_chunk_id").alias("back"))
    rows = leaves.where("next_chunk_id is not null").join(other, F.col("next_chunk_id") == F.col("o"), "left")
    return rows.select("id", F.when(F.col("o").isNull(), "unknown_next").when(~F.col("back").eqNullSafe(F.col("id")), "not_reciprocal").alias("rule")).where("rule is not null")


def redact(attributes: Column, fragments: tuple[str, ...] = ("key", "token", "authorization", "password", "prompt", "chunk_text"), most: int = 2000) -> Column:
    """A map without entries whose name contains a fragment, values cut to ``most``."""
    def safe(name: Column) -> Column:
        out = F.lit(True)
        for f in fragments:
            out &= ~F.lower(name).contains(f)
        return out

    return F.transform_values(F.map_filter(attributes, lambda k, _: safe(k)), lambda _, v: F.substring(v, 1, most))


def chunks_in_order(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of listed ids (list_id, place, id), in the order of the list: adds list_id and
    place to the chunks found; ids without a chunk are left out."""
    return ids.select("list_id", "place", F.col("id").alias("_id")).join(chunks, F.col("_id") == F.col("id")).drop("_id")


def published_chunks(active: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks of an index after a publication: those of ``fresh`` and the active ones of all
    other documents (both: tenant_id, document_id and the same further columns)."""
    documents = fresh.select("tenant_id", "document_id").distinct()
    return active.join(documents, ["tenant_id", "document_id"], "left_anti").select(*fresh.columns).unionByName(fresh)


def rebuilt(chunks: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Chunks of a full rebuild; an empty one is refused unless it is allowed."""
    if not allow_empty and chunks.isEmpty():
        raise ValueError("a rebuild without chunks would empty the index")
    return chunks


def outdated(versions: DataFrame, group: str, key: str, order: str, keep: int) -> DataFrame:
    """(group, key): all but the ``keep`` newest of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc(key))
    return versions.select(group, key, F.row_number().over(w).alias("_n")).where(F.col("_n") > keep).drop("_n")
