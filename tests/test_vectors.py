import math

from pyspark.sql import functions as F

from larkspur.operators import vectors


def test_cosine_and_search(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0])], "u_hash string, embedding array<float>")
    got = [(r["u_hash"], round(r["similarity"], 6)) for r in vectors.semantic_search(rows, [2.0, 0.0]).collect()]
    assert got == [("a", 1.0), ("b", round(1 / math.sqrt(2), 6)), ("d", -1.0)]
    assert vectors.semantic_search(rows, [2.0, 0.0], limit=1).count() == 1


def test_fusion(spark):
    a = spark.createDataFrame([("x", 3), ("y", 2)], "k string, s int")
    b = spark.createDataFrame([("y", 9)], "k string, s int")
    got = {r["k"]: r["rrf"] for r in vectors.fuse([vectors.reciprocal_ranks(t, "k", [F.desc("s"), "k"], [F.floor(F.col("s") / -2)]) for t in (a, b)], "k").collect()}
    assert abs(got["y"] - (1 / 62 + 1 / 61)) < 1e-12 and abs(got["x"] - 1 / 61) < 1e-12


def test_resumable_embedding(spark):
    docs = spark.createDataFrame([("a", "xx"), ("b", "y"), ("c", None)], "u_hash string, content string")
    done = spark.createDataFrame([("a", [1.0])], "u_hash string, embedding array<float>")
    left = vectors.pending(docs, done, "u_hash")
    made = vectors.embed(left, lambda texts: [[float(len(t))] for t in texts], batch=1)
    assert {r["u_hash"]: list(r["embedding"]) for r in made.collect()} == {"b": [1.0], "c": [0.0]}


def test_build_resumes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "xx"), ("b", "y")], "u_hash string, content string")
    folder = str(tmp_path / "v")
    assert vectors.build(docs.filter("u_hash = 'a'"), folder, lambda t: [[1.0] for _ in t]).count() == 1
    again = {r["u_hash"]: list(r["embedding"]) for r in vectors.build(docs, folder, lambda t: [[2.0] for _ in t]).collect()}
    assert again == {"a": [1.0], "b": [2.0]}
