"""Read-only data sources for existing files of the binary layout: record shards, write-ahead log, index segments.

    spark.dataSource.register(RecordSource)
    spark.read.format("record_shards").load("/data/storage")

One partition a shard or segment file; files are read in a stream, record by record.  The log is one
file that ends at its first bad entry, so it is one partition.  Paths are local or mounted on every
worker.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Magic numbers and little-endian layouts of the files.
RECORD_MAGIC, RECORD_HEADER = b"NEXS", struct.Struct("<4sHHII16s")  # magic, version, type, metadata bytes, body bytes, MD5 of the body
SEGMENT_MAGIC, SEGMENT_HEADER = b"NSST", struct.Struct("<4sI")  # magic, terms
TERM_LENGTH, LIST_LENGTH, KEY_BYTES = struct.Struct("<H"), struct.Struct("<I"), 16
WAL_ENTRY = struct.Struct("<QB16sQIIHI")  # lsn, state, key, offset, length, time, shard, CRC32 of what comes before
INDEX_MAGIC, INDEX_HEADER = b"NIDX", struct.Struct("<4sHIIQB1x")  # magic, version, buckets, used, lsn, clean
INDEX_SLOT = struct.Struct("<16sQIIH2x")  # key (zero: empty), offset, length, time, shard


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Files(DataSourceReader):
    pattern = "*"

    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, self.pattern))) if os.path.isdir(self.path) else [self.path]
        return [FilePart(f) for f in files]


class _Records(_Files):
    pattern = "*.nxs"

    def read(self, part: FilePart) -> Iterator[tuple]:
        """Whole records; the rest of a shard after a torn or foreign header is left out, and strict raises there."""
        import zstandard

        shard = int(os.path.basename(part.path).split(".")[0], 16)
        with open(part.path, "rb") as f:
            while True:
                offset = f.tell()
                head = f.read(RECORD_HEADER.size)
                if len(head) < RECORD_HEADER.size:
                    if head and self.strict:
                        raise ValueError(f"{part.path}: torn header at {offset}")
                    return
                magic, _, kind, meta_size, body_size, digest = RECORD_HEADER.unpack(head)
                rest = f.read(meta_size + body_size) if magic == RECORD_MAGIC else b""
                if len(rest) < meta_size + body_size or magic != RECORD_MAGIC:
                    if self.strict:
                        raise ValueError(f"{part.path}: bad record at {offset}")
                    return
                meta, body = rest[:meta_size], rest[meta_size:]
                sound = hashlib.md5(body).digest() == digest
                if not sound and self.strict:
                    raise ValueError(f"{part.path}: checksum at {offset}")
                fields = json.loads(meta)
                content = zstandard.ZstdDecompressor().decompressobj().decompress(body).decode() if sound else None
                url = fields.get("u", "")
                own = {k: v for k, v in fields.items() if k not in ("u", "t")}
                yield hashlib.sha256(url.encode()).hexdigest()[:32], shard, offset, RECORD_HEADER.size + len(rest), kind, url, int(fields.get("t", 0)), json.dumps(own, ensure_ascii=False) if own else None, content, sound


class RecordSource(DataSource):
    """Record shards: one row a record; checksum_ok tells damaged bodies, whose content is null."""

    @classmethod
    def name(cls) -> str:
        return "record_shards"

    def schema(self) -> str:
        return "u_hash string, shard_id int, offset long, length long, type int, url string, ts long, metadata string, content string, checksum_ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Records(self.options)


class _Wal(_Files):
    def read(self, part: FilePart) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            pos = 0
            while entry := f.read(WAL_ENTRY.size):
                if len(entry) < WAL_ENTRY.size:
                    yield pos, 0, 0, "", None, None, None, None, False
                    return
                lsn, state, key, offset, length, ts, shard, crc = WAL_ENTRY.unpack(entry)
                yield pos, lsn, state, key.hex(), offset, length, ts, shard, zlib.crc32(entry[:-4]) == crc
                pos += 1


class WalSource(DataSource):
    """A write-ahead log, all entries with crc_ok; recovery.valid_prefix() ends it at the first bad one."""

    @classmethod
    def name(cls) -> str:
        return "binary_wal"

    def schema(self) -> str:
        return "pos long, lsn long, state byte, u_hash string, offset long, length long, ts long, shard_id int, crc_ok boolean"

    def reader(self, schema) -> DataSourceReader:
        return _Wal(self.options)


class _Segments(_Files):
    pattern = "*.sst"

    def partitions(self) -> list[InputPartition]:
        parts = super().partitions()
        for i, p in enumerate(parts):
            p.number = i
        return parts

    def read(self, part: FilePart) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            magic, _ = SEGMENT_HEADER.unpack(f.read(SEGMENT_HEADER.size))
            if magic != SEGMENT_MAGIC:
                raise ValueError(f"{part.path}: not a segment")
            while len(head := f.read(TERM_LENGTH.size)) == TERM_LENGTH.size:
                term = f.read(TERM_LENGTH.unpack(head)[0]).decode()
                (n,) = LIST_LENGTH.unpack(f.read(LIST_LENGTH.size))
                for _ in range(n):
                    yield term, f.read(KEY_BYTES).hex(), part.number


class SegmentSource(DataSource):
    """Index segments: one row a posting; segment_id follows the order of names."""

    @classmethod
    def name(cls) -> str:
        return "index_segments"

    def schema(self) -> str:
        return "term string, u_hash string, segment_id long"

    def reader(self, schema) -> DataSourceReader:
        return _Segments(self.options)


class _Slots(_Files):
    def read(self, part: FilePart) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            magic, _, buckets, *_ = INDEX_HEADER.unpack(f.read(INDEX_HEADER.size))
            if magic != INDEX_MAGIC:
                raise ValueError(f"{part.path}: not an index")
            for bucket in range(buckets):
                slot = f.read(INDEX_SLOT.size)
                if len(slot) < INDEX_SLOT.size:
                    return
                key, offset, length, ts, shard = INDEX_SLOT.unpack(slot)
                if any(key):
                    yield key.hex(), offset, length, ts, shard, bucket


class IndexSource(DataSource):
    """A key index: one row a used slot."""

    @classmethod
    def name(cls) -> str:
        return "key_index"

    def schema(self) -> str:
        return "u_hash string, offset long, length long, ts long, shard_id int, bucket long"

    def reader(self, schema) -> DataSourceReader:
        return _Slots(self.options)


def register(spark: SparkSession) -> None:
    for source in (RecordSource, WalSource, SegmentSource, IndexSource):
        spark.dataSource.register(source)
