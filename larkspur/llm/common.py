"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, and a word, for Java's regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder.
    """
    sc = spark.sparkContext
    held = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if held:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(held)
        return held
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="larkspur-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute df once and keep it in the shared folder.

    The files stay valid when executors are lost, and Spark's cleaner removes them with the last
    reference when so configured.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables as Parquet in the shared folder, deleted on leaving the block.

    For tables that nothing needs after the block; what a result still reads goes through checkpointed().
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        remove(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.folder}/{self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


def words_of(text: Column) -> Column:
    """The words of a text in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 on division by 3; a null id is hashed as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores at its end as keep it from meeting a column (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """df marked for broadcast if it is known to have at most `limit` narrow rows; more are left to shuffle joins."""
    return F.broadcast(df) if rows <= limit else df


def least_by_hash(rows: DataFrame, order: str, n: int, *ties: str) -> DataFrame:
    """The n rows of the least `order` (a 64-bit hash, not null), ties by `ties`.

    Counts over ranges of the hash tell where the n-th row lies, so rows far beyond it are dropped before
    anything is sorted, however often a hash repeats.
    """
    steps = 1 << 12
    step = F.shiftright(F.col(order), 52)  # -2048 .. 2047
    counts = sorted((r[0], r[1]) for r in rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect())  # at most 4096 rows
    assert len(counts) <= steps
    last, seen = None, 0
    for at, many in counts:
        last, seen = at, seen + many
        if seen >= n:
            break
    if last is not None:
        rows = rows.filter(step <= last)
    return rows.orderBy(order, *ties).limit(n)


def range_parts(df: DataFrame, order: list[str], rows: int, out: str, rows_per_part: int = 100_000) -> DataFrame:
    """df, kept in the shared folder, with `out`: the number of its part among parts that are cut along `order`.

    Rows that tie in all of `order` share a part.  Spark takes the cuts from a sample; they decide speed only.
    """
    parts = max(1, -(-rows // rows_per_part))
    return checkpointed(df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id()))


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str, rows: int) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the same group that come before, by `order`.

    No task holds a whole group: parts are cut along (group, order), summed, and added up part by part.
    """
    part, g, p, start = free_names(df.columns, "__part", "__g", "__p", "__start")
    dealt = range_parts(df, [group, *order], rows, part)
    before = Window.partitionBy(g).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(F.col(group).alias(g), F.col(part).alias(p)).agg(F.sum(value).alias("__sum"))
    starts = sums.select(g, p, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = dealt.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = made.join(starts, made[group].eqNullSafe(starts[g]) & (made[part] == starts[p]))
    return joined.withColumn(out, F.col(out) + F.col(start)).drop(part, g, p, start)


def numbered(df: DataFrame, group: str, order: list[str], out: str, rows_per_part: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in `out`.

    No task holds a whole group: rows are dealt by (group, hash of the order columns), counted
    per part, and numbered inside each part from its group's running total.  The counts have one
    row per part, about one for every `rows_per_part` rows and group.
    """
    part, g, p, start, k = free_names(df.columns, "__part", "__g", "__p", "__start", "__k")
    n = df.count()
    parts = max(8, n // rows_per_part)
    dealt = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = dealt.groupBy(group, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias(g), F.col(part).alias(p), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(group, part).orderBy(*order)
    ranked = dealt.withColumn(k, F.row_number().over(inside) - 1)
    joined = ranked.join(starts, ranked[group].eqNullSafe(starts[g]) & (ranked[part] == starts[p]))
    return joined.withColumn(out, (F.col(start) + F.col(k)).cast("long")).drop(part, k, g, p, start)
