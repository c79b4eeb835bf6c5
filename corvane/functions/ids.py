"""Stable ids and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, hexadecimal."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def canonical_join(*parts: Column) -> Column:
    """Parts with their lengths in code points, so that no two lists collide."""
    return F.concat_ws("|", *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def name_uuid(namespace: str, name: Column) -> Column:
    """32 hexadecimal digits of the version-5 UUID of ``name`` in a namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def stable_id(prefix: str, namespace: str, *parts: Column) -> Column:
    """``prefix_`` and the name UUID of the joined parts."""
    return F.concat(F.lit(f"{prefix}_"), name_uuid(namespace, canonical_join(*parts)))


def set_fingerprint(values: Column) -> Column:
    """SHA-256 of the sorted values of an array; order in the array does not count."""
    return content_hash(F.array_join(F.array_sort(values), "|"))
