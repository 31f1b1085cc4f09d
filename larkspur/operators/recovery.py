"""Replay of a write-ahead log, and rebuilds from the change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kv, postings

# States of a log entry.
PREPARE, COMMIT, RESIZE_START, RESIZE_END, COMPACT_START, COMPACT_END = range(1, 7)


def valid_prefix(wal: DataFrame) -> DataFrame:
    """Entries before the first bad one.  The first bad position is one row, so it is joined, not windowed."""
    bad = wal.filter(~F.coalesce(F.col("crc_ok"), F.lit(False))).agg(F.min("pos").alias("_bad"))
    return wal.join(F.broadcast(bad)).filter(F.col("_bad").isNull() | (F.col("pos") < F.col("_bad"))).drop("_bad")


def latest_lsn(wal: DataFrame) -> DataFrame:
    """`lsn` of the physically last entry; 0 if there is none or it is bad."""
    last = wal.agg(F.max(F.struct("pos", "lsn", "crc_ok")).alias("m"))
    return last.select(F.when(F.coalesce(F.col("m.crc_ok"), F.lit(False)), F.col("m.lsn")).otherwise(F.lit(0)).cast("long").alias("lsn"))


def redo(wal: DataFrame, checkpoint: int) -> DataFrame:
    """For each key the last prepared entry that was committed and is newer than the checkpoint."""
    valid = valid_prefix(wal)
    done = valid.filter(F.col("state") == COMMIT).select("lsn").distinct()
    prepared = valid.filter((F.col("state") == PREPARE) & (F.col("lsn") > checkpoint))
    return kv.latest(prepared.join(done, "lsn", "left_semi").select(*wal.columns), "u_hash", "pos")


def rebuild(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current values and a fresh single-segment index of a whole change log."""
    return kv.live(log), postings.build(log)


def sound(log: DataFrame, body: str = "content", digest: str = "checksum") -> tuple[DataFrame, DataFrame]:
    """Rows whose checksum holds, and the others for quarantine."""
    ok = F.coalesce(F.md5(F.col(body).cast("binary")) == F.col(digest), F.lit(False))
    return log.filter(ok), log.filter(~ok)
