"""Batches of the change log: puts and deletes with sequence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.keys import is_filled, json_field, shard_of, url_key

PUT, DELETE = "put", "delete"


def indexed_text(content: Column, metadata: Column) -> Column:
    """What a put is found by: the description if there is metadata, else the content; one rule for ingest and for every rebuild."""
    return F.when(is_filled(metadata), json_field(metadata, "description")).otherwise(content)


def is_valid(url: Column, content: Column, metadata: Column) -> Column:
    """False for puts to reject as a whole: no url or content, or metadata without a description."""
    described = ~is_filled(metadata) | json_field(metadata, "description").isNotNull()
    return url.isNotNull() & content.isNotNull() & described


def changes(rows: DataFrame, lsn: Column, ts: Column | None = None) -> DataFrame:
    """Change-log rows from (url, content[, metadata, type, op]); tombstones carry no content.

    Metadata is JSON text; the log's own keys `u` and `t` live in columns, so the caller's object is kept as it is.
    """
    given = rows.columns
    op = F.coalesce(F.col("op"), F.lit(PUT)) if "op" in given else F.lit(PUT)
    metadata = F.col("metadata") if "metadata" in given else F.lit(None).cast("string")
    kind = F.coalesce(F.col("type"), F.lit(1)) if "type" in given else F.lit(1)
    return rows.select(
        lsn.cast("long").alias("lsn"),
        op.alias("op"),
        url_key(F.col("url")).alias("u_hash"),
        shard_of(url_key(F.col("url"))).alias("shard_id"),
        "url",
        F.when(op == PUT, F.col("content")).alias("content"),
        F.when(op == PUT, metadata).alias("metadata"),
        kind.cast("int").alias("type"),
        (F.unix_timestamp() if ts is None else ts).cast("long").alias("ts"),
    )
