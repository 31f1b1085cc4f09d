"""Compaction of index segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: segments from which compaction is due.
SEGMENTS = 10


def should_compact(segments: int) -> bool:
    return segments >= SEGMENTS


def merge(postings: DataFrame) -> DataFrame:
    """One segment of all: the last version of each (term, key)."""
    return postings.groupBy("term", "u_hash").agg(F.max("lsn").alias("lsn"))


def merged(postings: DataFrame, segment_id: int) -> DataFrame:
    """merge() as a segment."""
    return merge(postings).select("term", "u_hash", "lsn", F.lit(segment_id).cast("long").alias("segment_id"))


def compact(postings: DataFrame, live: DataFrame | None, segment_id: int = 0) -> DataFrame:
    """One segment without keys that aren't live; terms without keys go by themselves.

    Dead keys go before the shuffle by term.
    """
    kept = postings if live is None else postings.join(live.select("u_hash").distinct(), "u_hash", "left_semi")
    return merged(kept, segment_id)
