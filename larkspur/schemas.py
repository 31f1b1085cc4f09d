"""Schemas of the tables the engine keeps."""

from pyspark.sql.types import BooleanType, ByteType, IntegerType, LongType, StringType, StructField, StructType

#: The change log: one row for each put or delete, never updated.
RECORDS = StructType([
    StructField("lsn", LongType(), False),
    StructField("op", StringType(), False),
    StructField("u_hash", StringType(), False),
    StructField("shard_id", IntegerType(), False),
    StructField("url", StringType(), False),
    StructField("content", StringType()),
    StructField("metadata", StringType()),
    StructField("type", IntegerType(), False),
    StructField("ts", LongType(), False),
])

#: The inverted index: each term of each version of a document.
POSTINGS = StructType([StructField("term", StringType(), False), StructField("u_hash", StringType(), False), StructField("lsn", LongType(), False), StructField("segment_id", LongType(), False)])

#: A write-ahead log to replay.
WAL = StructType([
    StructField("pos", LongType(), False),
    StructField("lsn", LongType(), False),
    StructField("state", ByteType(), False),
    StructField("u_hash", StringType(), False),
    StructField("offset", LongType()),
    StructField("length", LongType()),
    StructField("ts", LongType()),
    StructField("shard_id", IntegerType()),
    StructField("crc_ok", BooleanType()),
])
