"""The current value of each key, derived from the change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.keys import shard_of, url_key

from .changelog import PUT


def latest(log: DataFrame, key: str = "u_hash", order: str = "lsn") -> DataFrame:
    """The row of each key that was logged last.

    Only (key, order) is aggregated, with map-side combine; whole rows meet it in one join.
    """
    last = log.groupBy(key).agg(F.max(order).alias("_last"))
    held = last.select(F.col(key).alias("_key"), "_last")
    return log.join(held, (log[key] == held["_key"]) & (log[order] == held["_last"])).select(*log.columns)


def live(log: DataFrame, key: str = "u_hash", order: str = "lsn", deleted: Column | None = None) -> DataFrame:
    """The current rows of keys that aren't deleted."""
    gone = F.col("op") != PUT if deleted is None else deleted
    return latest(log, key, order).filter(~F.coalesce(gone, F.lit(False)))


def live_keys(log: DataFrame, key: str = "u_hash", order: str = "lsn", deleted: Column | None = None) -> DataFrame:
    """(key, order) of keys that aren't deleted, from narrow columns in one shuffle."""
    gone = F.col("op") != PUT if deleted is None else deleted
    narrow = log.select(key, order, F.coalesce(gone, F.lit(False)).alias("_gone"))
    last = narrow.groupBy(key).agg(F.max(F.struct(order, "_gone")).alias("_m"))
    return last.filter(~F.col("_m._gone")).select(key, F.col(f"_m.{order}").alias(order))


def get(log: DataFrame, url: str) -> DataFrame:
    """The current row of one url, or none; the shard and key filters reach the scan."""
    spark = log.sparkSession
    k, shard = spark.range(1).select(url_key(F.lit(url)), shard_of(url_key(F.lit(url)))).first()
    mine = log.filter((F.col("shard_id") == shard) & (F.col("u_hash") == k))
    return live(mine)


def get_many(log: DataFrame, urls: DataFrame, versions: bool = False) -> DataFrame:
    """The current rows of the urls in a column url.

    versions: urls has a column lsn too, and the rows logged under these numbers are returned, replaced since or
    not; a delete is no row.  A log may have rows without a url: they are versions of one key, which has no current row.
    """
    if not versions:
        wanted = urls.select(url_key(F.col("url")).alias("u_hash")).distinct()
        return live(log.join(wanted, "u_hash", "left_semi"))
    asked = urls.select(url_key(F.col("url")).alias("_key"), F.col("lsn").alias("_lsn"))
    # key and number are hashed together, so a key with many versions is split
    held = log.join(asked, F.col("u_hash").eqNullSafe(F.col("_key")) & (F.col("lsn") == F.col("_lsn")), "left_semi")
    return held.filter(~F.coalesce(F.col("op") != PUT, F.lit(False)))


def of_keys(log: DataFrame, keys: DataFrame, key: str = "u_hash", order: str = "lsn", deleted: Column | None = None) -> DataFrame:
    """The current rows of some keys: the log is cut down to them before it is aggregated."""
    return live(log.join(keys.select(key), key, "left_semi"), key, order, deleted)
