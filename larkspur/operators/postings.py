"""The inverted index: build, segments, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import terms

from .changelog import PUT, indexed_text


def build(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """(term, u_hash, lsn, segment_id) for every put of a change log."""
    text = indexed_text(F.col("content"), F.col("metadata"))
    number = F.lit(0) if segment is None else segment
    return log.filter(F.col("op") == PUT).select(F.explode(terms(text)).alias("term"), "u_hash", "lsn", number.cast("long").alias("segment_id"))


def arranged(postings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings in the order they are stored in, so that file statistics prune by term.

    Ranges run over (term, u_hash): a term that most documents have spans many partitions.
    """
    by = ["term", "u_hash"]
    dealt = postings.repartitionByRange(partitions, *by) if partitions else postings.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by)


def without(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """Postings without those of some keys; terms left without keys are gone by themselves."""
    return postings.join(keys.select("u_hash"), "u_hash", "left_anti").select(*postings.columns)


def frequencies(postings: DataFrame, versions: bool = True) -> DataFrame:
    """Documents per term.

    Where a key has one version only (versions=False) its terms are distinct already, and a count, summed
    in each task first, does.
    """
    return postings.groupBy("term").agg((F.countDistinct("u_hash") if versions else F.count("u_hash")).alias("df"))


def nested(postings: DataFrame) -> DataFrame:
    """Terms with their lists of keys.  A list is one row: meant for export and for rare terms."""
    return postings.groupBy("term").agg(F.array_sort(F.collect_set("u_hash")).alias("keys"))
