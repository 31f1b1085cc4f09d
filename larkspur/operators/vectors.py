"""Extensions: similarity search over vectors, rank fusion, resumable embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the constant of reciprocal rank fusion.
RRF_K = 60


def _dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(size > 0, _dot(a, b) / size)


def semantic_search(vectors: DataFrame, query: list[float], key: str = "u_hash", vector: str = "embedding", limit: int | None = None) -> DataFrame:
    """(key, similarity) of every vector to one query, or of the `limit` nearest."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select(key, cosine(F.col(vector), q).alias("similarity")).filter(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), key)
    return out if limit is None else out.limit(limit)


def reciprocal_ranks(ranked: DataFrame, key: str, order: list, buckets: list[Column], k: int = RRF_K) -> DataFrame:
    """1 / (k + rank) of one ranked list, rank from 1.

    buckets: whole numbers that rise along `order`.  Buckets are counted, and rows are ranked inside theirs, so only
    the table of buckets is in one task.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    dealt = ranked.withColumns(dict(zip(names, buckets)))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(*names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return dealt.withColumn("_place", place).join(starts, names).select(key, (F.lit(1.0) / (F.lit(k) + F.col("_start") + F.col("_place"))).alias("part"))


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """(key, rrf): the sum of reciprocal ranks over lists."""
    all_parts = lists[0]
    for more in lists[1:]:
        all_parts = all_parts.unionByName(more)
    return all_parts.groupBy(key).agg(F.sum("part").alias("rrf"))


def pending(docs: DataFrame, vectors: DataFrame, key: str, vector_key: str | None = None) -> DataFrame:
    """Documents without a vector."""
    done = vectors.select(F.col(vector_key or key).alias("_done"))
    return docs.join(done, docs[key] == done["_done"], "left_anti")


def embed(docs: DataFrame, encode: Callable[[list[str]], list[list[float]]], key: str = "u_hash", text: str = "content", batch: int = 64) -> DataFrame:
    """(key, embedding) by an injected encoder, in batches, with Arrow transfer."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": [list(map(float, v)) for v in encode(part[text].fillna("").tolist())]})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def build(docs: DataFrame, folder: str, encode: Callable[[list[str]], list[list[float]]], key: str = "u_hash", text: str = "content", batch: int = 64) -> DataFrame:
    """Vectors of all docs, kept in a folder: documents that have one are skipped, so a build that was cut short resumes."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    left = docs
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        left = pending(docs, spark.read.parquet(folder), key)
    embed(left, encode, key, text, batch).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)
