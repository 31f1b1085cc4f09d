"""Each stage of the pipeline against brute force on what its predecessor kept."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import language_id
from tests.llm.rows import SCHEMA, nothing, odd_documents, words
from tests.llm.test_native import plain_line_dedup
from tests.llm.test_packing import check
from tests.llm.test_similar import plain_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """documents with odd rows beside the driver's."""
    folder = str(tmp_path_factory.mktemp("tables"))
    extra = odd_documents(spark, extra=False).withColumn("doc_id", F.col("doc_id") + 100_000)
    spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra).write.parquet(f"{folder}/documents.parquet")
    return folder


def plain_targets(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    caps, full, budget = {s: 2 * sizes[s] for s in sizes}, set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in sizes if s not in full]
        share = (budget - sum(caps[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        over = {s for s in rest if share * weight[s] > caps[s]}
        if not over:
            return {s: caps[s] if s in full else share * weight[s] for s in sizes}
        full |= over


def test_stages(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    columns, made = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, odd_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        made[name] = (before.collect(), docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert [n for n, _ in corpus_pipeline.STAGES] == list(made)

    before, after = made["language_id"]
    kept = {r["doc_id"] for r in after}
    told = language_id.identify(spark.read.parquet(f"{odd_dir}/documents.parquet"), language_id.train(spark.read.parquet(f"{odd_dir}/documents.parquet")))
    assert kept == {r["doc_id"] for r in told.collect() if r["lang_pred"] != "und" and not r["ambiguous"]}
    assert len([r for r in before if r["doc_id"] < 100_000]) - len([k for k in kept if k < 100_000]) <= 2  # clean documents stay

    before, after = made["line_dedup"]
    want = plain_line_dedup([(r["doc_id"], r["text"]) for r in before])
    want = {k: t for k, (n, t) in want.items() if n == 0 or t.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in after} == want

    before, after = made["ngram_jaccard_join"]
    assert {r["doc_id"] for r in after} == {k for k, (_, c) in plain_components([(r["doc_id"], r["text"]) for r in before]).items() if k == c}
    assert len(after) == len({r["doc_id"] for r in after})

    before, after = made["source_mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r["source"]] += len(words(r["text"]))
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) < 1, s

    before, after = made["best_fit_packing"]
    texts = defaultdict(list)
    for r in before:
        texts[r["doc_id"]].append(r["text"])
    check(after, texts)


def test_run(spark, odd_dir):
    rows = corpus_pipeline.run(spark, odd_dir)
    assert rows.count() > 100 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_empty_table(spark, tmp_path):
    nothing(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_columns_are_carried(spark):
    docs = odd_documents(spark)
    assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    for stage in (corpus_pipeline.language, corpus_pipeline.lines, corpus_pipeline.near_duplicates, corpus_pipeline.mixture):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        # the user's values, not ours, in the columns whose names clash
        assert [tuple(r) for r in out.select(*docs.columns[5:]).distinct().collect()] == [("x", 1, 2, 3, "y", 4, 5, 6, 7)]


def test_shared_and_null_ids_lose_no_text(spark):
    """Rows of one id, or of none, are merged only where their texts are near."""
    make = lambda name: " ".join(f"{name}{i}" for i in range(60))
    near = lambda name: make(name) + " tail"
    rows = [(None, make("a")), (None, make("b")), (None, make("c")), (None, make("c")), (None, None), (None, None), (7, make("d")), (7, make("e")), (7, near("a")), (8, near("b")), (3, make("f")), (9, near("f")), (9, near("e")), (4, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    want = [(None, make("a")), (None, make("b")), (None, make("c")), (None, None), (None, None), (7, make("d")), (7, make("e")), (3, make("f")), (4, "")]
    assert got == sorted(want, key=repr)
