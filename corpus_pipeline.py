"""The corpus pipeline: language ID, line dedup, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  run() writes each stage's result as Parquet to the
shared checkpoint folder, reads it again for the next one, and removes what no stage needs any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard_join, language_id, line_dedup, mixing, packing
from larkspur.llm.common import WORD, free_names, read_table, remove, shared_folder

WEIGHTS = [3, 1, 2]
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or two languages too close to tell apart."""
    lang, score, unclear = names = tuple(free_names(docs.columns, "lang_pred", "score", "ambiguous"))
    told = language_id.identify(docs, language_id.train(docs), names=names)
    return told.filter((F.col(lang) != language_id.UNKNOWN) & ~F.col(unclear)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated three-line windows; a document that had words and keeps none goes."""
    n_lines, gone = names = tuple(free_names(docs.columns, "n_lines", "n_removed"))
    cleaned = line_dedup.dedup_lines(docs, names=names)
    kept = (F.col(gone) == 0) | (F.trim(F.col("text")) != "")
    return cleaned.filter(kept).withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the least id in each group of near duplicates.

    A row goes by a hash of all it holds, so rows that share an id, or have none, meet by their texts alone;
    of rows equal in every column one stays.  Texts without words are no duplicates, and all stay.
    """
    key = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    (k,) = free_names([*docs.columns, "id", "m"], "_k")
    some = docs.filter(worded).withColumn(k, key)
    groups = jaccard_join.near_duplicates(some, key=k).select(k, "component_id").distinct()
    ids = some.select(k, F.col("doc_id").cast("long").alias("id")).distinct()
    # a null id comes before all others; equal ids go by the hash
    least = ids.join(groups, k).groupBy("component_id").agg(F.min(F.struct("id", k)).alias("m")).select(F.col(f"m.{k}").alias(k))
    return some.dropDuplicates([k]).join(least, k, "left_semi").select(*docs.columns).union(docs.filter(~worded))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that their sources meet their target weights."""
    prefix = "_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    mixed = mixing.mix(docs, lambda s: mixing.cycled_weights(s, WEIGHTS), BUDGET_SHARE, MAX_EPOCHS, SEED, prefix=prefix)
    return mixing.repeated(mixed, docs.columns, prefix=prefix)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the mix out in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mixture),
    ("best_fit_packing", sequences),
]

#: SQL cannot express the language classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder, last = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(at), at
    return docs
