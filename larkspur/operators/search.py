"""Keyword search over the index.

A query's terms are found on one row first, so that they are a literal list which the Parquet scan
prunes by; postings are sorted by term.  Hits are narrow (key, score) until the page is known, and the log is cut
down to the hits before current values are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import found_terms, query_terms, terms

from . import kv

HIT = ["u_hash", "score", "url", "content", "metadata", "type"]


def matching(postings: DataFrame, keyword: str) -> DataFrame:
    """Postings of the query's terms."""
    words = query_terms(postings.sparkSession, keyword)
    return postings.filter(F.col("term").isin(words)) if words else postings.filter(F.lit(False))


def current(postings: DataFrame, log: DataFrame, deleted: Column | None = None) -> DataFrame:
    """Postings of each live key's last version only."""
    return postings.join(kv.live_keys(log, deleted=deleted), ["u_hash", "lsn"], "left_semi").select(*postings.columns)


def hits(postings: DataFrame, keyword: str) -> DataFrame:
    """Distinct keys with any of the query's terms."""
    return matching(postings, keyword).select("u_hash").distinct()


def scores(postings: DataFrame, keyword: str, per_segment: bool = False) -> DataFrame:
    """Keys with the number of the query's terms they have; with per_segment a term counts once for each segment it is in."""
    found = matching(postings, keyword)
    unit = found.select("u_hash", "term", "segment_id") if per_segment else found.select("u_hash", "term")
    return unit.distinct().groupBy("u_hash").agg(F.count(F.lit(1)).alias("score"))


def many_scores(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Scores of many queries (qid, keyword) in one join; neither side is broadcast unless it is small."""
    asked = queries.select("qid", F.explode(terms(F.col("keyword"))).alias("term"))
    found = postings.select("u_hash", "term").distinct()
    return asked.join(found, "term").groupBy("qid", "u_hash").agg(F.count(F.lit(1)).alias("score"))


def scan_scores(docs: DataFrame, keyword: str, text: str = "content", *keep: str) -> DataFrame:
    """Scores of texts that have no index: one scan, each row judged by itself, nothing shuffled or cut into terms.

    Returns the columns `keep` and score for rows with any of the query's terms.
    """
    found = found_terms(F.col(text), query_terms(docs.sparkSession, keyword))
    score = F.size(F.filter(found, lambda x: x)).cast("long")
    return docs.select(*keep, score.alias("score")).filter(F.col("score") > 0)


def search(postings: DataFrame, log: DataFrame, keyword: str) -> DataFrame:
    """Live documents with any of the query's terms, in no order."""
    found = hits(postings, keyword)
    return kv.of_keys(log, found).withColumn("score", F.lit(None).cast("long")).select(*HIT)


def ranking_search(postings: DataFrame, log: DataFrame, keyword: str, per_segment: bool = False, limit: int | None = None) -> DataFrame:
    """Live documents by score, then key.  With a limit only that many documents are looked up."""
    ranked = scores(postings, keyword, per_segment)
    if limit is not None:
        alive = kv.live_keys(log.join(ranked.select("u_hash"), "u_hash", "left_semi")).select("u_hash")
        ranked = ranked.join(alive, "u_hash", "left_semi").orderBy(F.desc("score"), "u_hash").limit(limit)
    rows = kv.of_keys(log, ranked).join(ranked, "u_hash").select(*HIT)
    return rows.orderBy(F.desc("score"), "u_hash")
