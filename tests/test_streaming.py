from larkspur.store import DocumentStore
from larkspur.streaming.ingest import ingest

SCHEMA = "url string, content string, op string, seq long"


def test_ingest_and_replay(spark, tmp_path):
    source, checkpoint = tmp_path / "in", tmp_path / "cp"
    store = DocumentStore(spark, str(tmp_path / "store"))

    def feed(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(str(source / name))

    def run(target):
        stream = spark.readStream.schema(SCHEMA).json(str(source / "*"))
        ingest(stream, target, str(checkpoint), rejects=str(tmp_path / "bad")).awaitTermination(120)

    feed("1", [("a", "alpha", "put", 0), ("b", "beta", "put", 1), (None, "x", "put", 2)])
    run(store)
    feed("2", [("a", "gamma", "put", 0), ("b", None, "delete", 1)])
    run(store)
    again = DocumentStore(spark, store.folder)
    assert {r["url"]: r["content"] for r in again.values().collect()} == {"a": "gamma"}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    # a batch that was committed but not noted by the stream is not applied twice
    for f in (checkpoint / "commits").iterdir():
        if f.name.endswith("1") or f.name.endswith("1.crc"):
            f.unlink()
    lsn = again.last_lsn
    run(again)
    assert again.last_lsn == lsn
