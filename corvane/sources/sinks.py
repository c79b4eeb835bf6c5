"""Writing an index: staged tables, checksums, one atomic switch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import lexical
from corvane.operators.catalog import verify_artifacts


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def write_index(entries: DataFrame, vectors: DataFrame | None, profiles: DataFrame, folder: str) -> None:
    """Lexical index, vectors and source profiles as parquet below a staging folder.
    ``entries``: id, text, section_number."""
    lexical.write_lexical_index(entries, folder)
    if vectors is not None:
        vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
    profiles.write.mode("overwrite").parquet(f"{folder}/profiles")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(name, checksum): SHA-256 of every data file below a folder, relative to it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return rows.select(name.alias("name"), F.sha2("content", 256).alias("checksum"))


def write_manifest(spark: SparkSession, folder: str, **facts: str) -> None:
    """Checksums of the folder, written beside it with the given facts."""
    rows = checksums(spark, folder).withColumn("facts", F.lit(json.dumps(facts, sort_keys=True)))
    rows.write.mode("overwrite").parquet(f"{folder}.manifest")


def damaged_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, state) of files that are missing, unexpected or changed against the manifest."""
    return verify_artifacts(spark.read.parquet(f"{folder}.manifest").select("name", "checksum"), checksums(spark, folder))


def publish(spark: SparkSession, staging: str, final: str) -> None:
    """Verify a staged folder and move it, with its manifest, to its final name; an existing
    final folder is an error, and a failed move leaves nothing behind under that name."""
    if damaged_files(spark, staging).limit(1).count():
        raise ValueError(f"{staging} does not match its manifest")
    fs, source, path = _fs(spark, staging)
    target = path(final)
    if fs.exists(target):
        raise FileExistsError(final)
    if not fs.rename(path(f"{staging}.manifest"), path(f"{final}.manifest")) or not fs.rename(source, target):
        fs.delete(path(f"{final}.manifest"), True)
        raise OSError(f"could not publish {final}")


def replace_versions(chunks: DataFrame, table: str) -> None:
    """Replace the chunks of the versions in ``chunks``, and only those: one folder each."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_version_id").parquet(table)


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key does not exist yet, each key once: inserting twice changes nothing."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
