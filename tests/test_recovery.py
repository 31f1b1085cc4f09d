import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from larkspur.operators import recovery
from larkspur.schemas import WAL
from larkspur.sources import binary


def wal(spark, rows):
    return spark.createDataFrame([(i, lsn, state, key, 0, 0, 0, 0, ok) for i, (lsn, state, key, ok) in enumerate(rows)], WAL)


LOG = [(1, 1, "a", True), (1, 2, "a", True), (5, 1, "a", True), (5, 2, "a", True), (6, 1, "b", True), (7, 1, "a", True), (7, 2, "a", True), (8, 1, "c", True), (8, 2, "c", False), (9, 1, "d", True), (9, 2, "d", True)]


def test_redo(spark):
    got = {(r["u_hash"], r["lsn"]) for r in recovery.redo(wal(spark, LOG), 1).collect()}
    assert got == {("a", 7)}
    assert recovery.redo(wal(spark, LOG), 7).count() == 0
    assert recovery.redo(wal(spark, []), 0).count() == 0


def test_valid_prefix_and_last(spark):
    assert recovery.valid_prefix(wal(spark, LOG)).count() == 8
    assert recovery.latest_lsn(wal(spark, LOG)).first()["lsn"] == 9
    assert recovery.latest_lsn(wal(spark, LOG[:9])).first()["lsn"] == 0
    assert recovery.latest_lsn(wal(spark, [])).first()["lsn"] == 0


def test_quarantine(spark):
    rows = spark.createDataFrame([("x", hashlib.md5(b"x").hexdigest()), ("y", "0"), (None, None)], "content string, checksum string")
    good, bad = recovery.sound(rows)
    assert good.count() == 1 and bad.count() == 2


def record(url, content, meta=None, kind=1, ts=7, spoil=False):
    zstandard = pytest.importorskip("zstandard")
    body = zstandard.ZstdCompressor(level=3).compress(content.encode())
    head = json.dumps({"u": url, "t": ts} | (meta or {})).encode()
    digest = hashlib.md5(body).digest()
    return struct.pack("<4sHHII16s", b"NEXS", 1, kind, len(head), len(body), b"0" * 16 if spoil else digest) + head + body


def test_binary_files(spark, tmp_path):
    binary.register(spark)
    (tmp_path / "storage").mkdir()
    (tmp_path / "storage" / "0a.nxs").write_bytes(record("u1", "eins", {"description": "d"}) + record("u2", "zwei", spoil=True) + record("u3", "drei") + b"NEX")
    (tmp_path / "storage" / "ff.nxs").write_bytes(b"")
    rows = {r["url"]: r for r in spark.read.format("record_shards").load(str(tmp_path / "storage")).collect()}
    assert rows["u1"]["content"] == "eins" and json.loads(rows["u1"]["metadata"]) == {"description": "d"} and rows["u1"]["shard_id"] == 10
    assert not rows["u2"]["checksum_ok"] and rows["u2"]["content"] is None and rows["u3"]["content"] == "drei" and rows["u3"]["metadata"] is None
    assert rows["u1"]["u_hash"] == hashlib.sha256(b"u1").hexdigest()[:32]
    with pytest.raises(Exception):
        spark.read.format("record_shards").option("strict", "true").load(str(tmp_path / "storage")).collect()

    def entry(lsn, state):
        e = struct.pack("<QB16sQIIH", lsn, state, b"k" * 16, 1, 2, 3, 4)
        return e + struct.pack("<I", zlib.crc32(e))

    (tmp_path / "log").write_bytes(entry(1, 1) + entry(1, 2) + b"\x01\x02\x03")
    log = spark.read.format("binary_wal").load(str(tmp_path / "log"))
    assert recovery.valid_prefix(log).count() == 2 and log.count() == 3
    assert recovery.redo(log, 0).first()["u_hash"] == (b"k" * 16).hex()

    (tmp_path / "x").mkdir()
    for name, terms in (("a.sst", {"ab": [b"1" * 16, b"2" * 16], "가나": [b"1" * 16]}), ("b.sst", {"ab": [b"1" * 16]})):
        out = struct.pack("<4sI", b"NSST", len(terms))
        for t, ks in terms.items():
            out += struct.pack("<H", len(t.encode())) + t.encode() + struct.pack("<I", len(ks)) + b"".join(ks)
        (tmp_path / "x" / name).write_bytes(out)
    seg = spark.read.format("index_segments").load(str(tmp_path / "x"))
    assert seg.count() == 4 and seg.filter("term = 'ab'").select(F.countDistinct("segment_id")).first()[0] == 2

    slots = [b"\0" * 36, struct.pack("<16sQIIH2x", b"q" * 16, 5, 6, 7, 8)]
    (tmp_path / "idx").write_bytes(struct.pack("<4sHIIQB1x", b"NIDX", 1, 2, 1, 9, 1) + b"".join(slots))
    assert [tuple(r) for r in spark.read.format("key_index").load(str(tmp_path / "idx")).collect()] == [((b"q" * 16).hex(), 5, 6, 7, 8, 1)]
