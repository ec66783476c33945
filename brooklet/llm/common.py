"""Shared plumbing: word scanning, ids as text, tables, groups of sorted rows."""

from __future__ import annotations

import re
import sys
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.plans.lineage import shared_dir, written

__all__ = ["WORD", "WORD_RE", "crc_mod", "kept_by_worker", "read", "runs", "shared_dir", "text_or_empty", "written"]

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(column: str, modulus: int):
    """crc32 of a column as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def runs(batches, n_keys: int):
    """Groups of consecutive rows with equal leading columns, as (key, rows); a group may
    span batches. For input that is dealt and sorted by those columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_keys] != key:
                if held:
                    yield key, held
                key, held = row[:n_keys], []
            held.append(row[n_keys:])
    if held:
        yield key, held


def kept_by_worker(owner: str) -> dict:
    """What this Python worker keeps between tasks of one operator; what another operator
    has left is dropped, so that caches never add up."""
    held = sys.modules.setdefault("_brooklet_worker", types.ModuleType("_brooklet_worker"))
    if getattr(held, "owner", None) != owner:
        held.owner, held.store = owner, {}
    return held.store
