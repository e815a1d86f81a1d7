"""Hashes that identify content, context and whole sets of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space


def nul() -> Column:
    return F.lit("\0")


def content_hash(text: Column) -> Column:
    """SHA-256 of the trimmed text, lower-case hex."""
    return F.sha2(trim_space(F.coalesce(text, F.lit(""))), 256)


def context_hash(name: Column, kind: Column, properties: Column) -> Column:
    """SHA-256 over name, type and sorted properties, each followed by nul(); keys that start with @ don't count."""
    entries = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, _: ~k.startswith("@"))))
    parts = F.transform(entries, lambda e: F.concat(e["key"], nul(), e["value"], nul()))
    return F.sha2(F.concat(name, nul(), kind, nul(), F.array_join(parts, "")), 256)


def record_hash(content: Column, context: Column) -> Column:
    return F.sha2(F.concat(content, nul(), context), 256)


def store_key(path: Column, block_id: Column, text: Column) -> Column:
    """Hash of the source path and the block id, or the text where there is no id."""
    return F.sha2(F.concat(path, nul(), F.when(F.coalesce(block_id, F.lit("")) != "", block_id).otherwise(text)), 256)


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of nul()-terminated parts."""
    return F.substring(F.sha2(F.concat(*[x for p in parts for x in (p, nul())]), 256), 1, 16)


def set_hash(hashes: Column) -> Column:
    """Order-free hash of a group's hashes; use inside an aggregation of bounded groups (items of a document)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(hashes)), ""), 256)
