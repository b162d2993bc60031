"""Identities: every id is a digest of what it names, so that a second run makes the same ids."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TENANT = re.compile(r"[a-z0-9](?:[a-z0-9_-]*[a-z0-9-])?")


def _digest(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16))


def normalise_source(uri: Column) -> Column:
    """One spelling of a source: urls stay, separators become slashes, drive paths are lower-cased; null if it holds a NUL."""
    path = F.translate(uri, "\\", "/")
    return F.when(F.contains(uri, F.lit("\0")), None).when(F.contains(uri, F.lit("://")), uri).when(path.rlike("^[A-Za-z]:/"), F.lower(path)).otherwise(path)


def source_kind(value: Column) -> Column:
    return F.when(value.rlike("^https?://"), "url").otherwise("path")


def document_id(source: Column, tenant: Column | None = None) -> Column:
    return _digest("d_", normalise_source(source), F.coalesce(tenant, F.lit("")) if tenant is not None else F.lit(""))


def chunk_id(document: Column, index: Column, chunker: str) -> Column:
    return _digest("c_", document, index.cast("string"), F.lit(chunker))


def job_id(ms: Column, sequence: Column, salt: Column) -> Column:
    """An id that sorts by time, then by the order within a millisecond; salt (any text of its own, like uuid()) keeps drivers apart."""
    return F.concat(F.lit("job_"), F.lpad(ms.cast("string"), 13, "0"), F.lpad(sequence.cast("string"), 4, "0"), F.substring(F.sha2(salt, 256), 1, 8))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def settings_hash(**settings) -> str:
    """A digest of key-sorted compact JSON: one value a run, made on the driver."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def chunker_hash(strategy: str, chunk_size: int, overlap: int) -> str:
    return settings_hash(strategy=strategy, chunk_size=chunk_size, overlap=overlap)


def scoped(tenant: str | None, name: Column) -> Column:
    """A collection's name within a tenant."""
    if tenant is None:
        return name
    if not _TENANT.fullmatch(tenant) or "__" in tenant:
        raise ValueError(f"not a tenant's name: {tenant!r}")
    return F.concat_ws("__", F.lit(tenant), name)


def unscoped(tenant: str | None, name: Column) -> Column:
    return name if tenant is None else F.when(F.startswith(name, F.lit(f"{tenant}__")), F.substring(name, len(tenant) + 3, 2**31 - 1))


def visible_to(tenant: str | None, owner: Column) -> Column:
    """Rows that a tenant sees; no tenant sees all."""
    return F.lit(True) if tenant is None else owner.eqNullSafe(F.lit(tenant))
