"""Quality rules, language ID, quality network: counts by brute force, verdicts on held-out rows."""

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from larkspur.llm import language_id, quality_cnn, quality_rules, queries
from tests.llm.rows import nothing, odd_documents, with_null_id, words

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def plain_statistics(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    docs = odd_documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.statistics(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_statistics(texts[r["doc_id"]]), texts[r["doc_id"]][:50]


def test_quality_rules_query(spark):
    rows = queries.op3_quality_rules(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == len(texts)
    kept = {0: [], 1: []}
    for r in rows:
        n, chars, symbols, dup, repeat = plain_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n) and not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and held(r["doc_id"]) and not r["base_failed"]:
            kept[labels[r["doc_id"]]].append(r["kept"])
    assert np.mean(kept[1]) >= 0.95 and np.mean(kept[0]) <= 0.2


def test_rules_without_labels(spark):
    docs = with_null_id(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.judged(docs, none).collect()
    assert len(rows) == docs.count() and {r["threshold"] for r in rows} == {quality_rules.DEFAULT_THRESHOLD}
    assert all(r["kept"] == (not r["base_failed"] and r["anomaly"] < r["threshold"]) for r in rows)
    odd = [" ".join(f"{w}{i % 90}" for i in range(100)) for w in "abcdefghij" * 8] + [" ".join(f"#%{i}#" for i in range(100))]
    rows = quality_rules.judged(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), none).collect()
    assert max(rows, key=lambda r: r["anomaly"])["doc_id"] == 80  # the forest works without labels
    labels = spark.createDataFrame([(24, 1), (24, 0), (27, None), (30, 1), (None, 1)], "doc_id long, quality int")
    assert quality_rules.judged(docs, labels).count() >= docs.count()
    assert quality_rules.judged(nothing(spark), labels).count() == 0


def test_threshold():
    seen = [(100, 1, 990), (900, 1, 10), (1500, 0, 50), (800, 0, 50)]
    assert quality_rules.choose_threshold(seen, 0.0) == 901 / 2000 or 901 / 2000 <= quality_rules.choose_threshold(seen, 0.0) <= 0.75
    assert 101 / 2000 <= quality_rules.choose_threshold(seen, 0.02) <= 0.4
    assert quality_rules.choose_threshold([(1, 1, 5)], 0.1) == quality_rules.DEFAULT_THRESHOLD


def test_forest_isolates():
    rng = np.random.Generator(np.random.PCG64(1))
    rows = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    scores = quality_rules.IsolationForest(rows).scores(rows)
    assert scores.argmax() == 500 and 0 < scores.min() and scores.max() < 1


def test_verdicts_equal_plain_forest(spark):
    """Paths walked row by row, the threshold by trying every step."""
    docs = odd_documents(spark).filter("length(text) > 200")
    labels = spark.createDataFrame([(r["doc_id"], int(r["doc_id"] % 2)) for r in docs.collect()], "doc_id long, quality int")
    rows = quality_rules.judged(docs, labels).collect()
    passing = [r for r in rows if not r["base_failed"]]
    table = quality_rules.ratios({c: np.array([r[c] for r in rows]) for c in quality_rules.COUNTS})
    some = np.array([not r["base_failed"] for r in rows])
    good = np.array([not r["base_failed"] and r["doc_id"] % 2 == 1 and not held(r["doc_id"]) for r in rows])
    order = {r["doc_id"]: r["o"] for r in spark.createDataFrame([tuple(r[c] for c in ("doc_id", *quality_rules.COUNTS)) for r in rows], "doc_id long, " + ", ".join(f"{c} long" for c in quality_rules.COUNTS)).select("doc_id", F.xxhash64("doc_id", *quality_rules.COUNTS, F.lit(quality_rules.SEED)).alias("o")).collect()}
    by_order = sorted(np.flatnonzero(some), key=lambda i: order[rows[i]["doc_id"]])
    view = quality_rules.Excess(table[good])
    forest = quality_rules.IsolationForest(view(table[by_order]))

    def path(tree, x):
        feature, value, child, length = tree
        node = 0
        while feature[node] >= 0:
            node = child[node] + int(x[feature[node]] >= value[node])
        return length[node]

    for i, r in enumerate(rows):
        mean = np.mean([path(t, view(table[i : i + 1])[0]) for t in forest.trees])
        assert abs(r["anomaly"] - 2 ** (-mean / forest.norm)) < 1e-9
    known = [(r["anomaly"], r["doc_id"] % 2) for r in passing if not held(r["doc_id"])]
    goods, bads = [a for a, y in known if y == 1], [a for a, y in known if y == 0]
    tries = [s / 2000 for s in range(2001) if sum(a >= s / 2000 for a in goods) <= quality_rules.MAX_LOSS * len(goods)]
    most = max(sum(a >= t for a in bads) for t in tries)
    assert rows[0]["threshold"] in [t for t in tries if sum(a >= t for a in bads) == most]
    assert all(r["kept"] == (not r["base_failed"] and r["anomaly"] < r["threshold"]) for r in rows)


# --- language


def plain_decoding(model, text):
    """The language by walking over n-grams one by one."""
    body = bytes(32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in text.encode())
    grams = [body[i : i + n] for n in (1, 2, 3, 4) for i in range(len(body) - n + 1)]
    place = lambda g: (((int.from_bytes(g, "big") + len(g)) * 0x9E3779B1) % 2**32) >> 16
    margin = sum(model.weights[place(g)].astype(float) for g in grams) / len(grams) * model.scale
    loss = [sum(t * np.log1p(np.exp(-m * c)) for t, m, c in zip(model.trust, margin, code)) / sum(model.trust) for code in model.code]
    odds = np.exp(-(np.array(loss) - min(loss)) * model.code.shape[1])
    ordered = sorted(loss)
    return model.languages[int(np.argmin(loss))], odds.max() / odds.sum(), ordered[1] - ordered[0] < language_id.MARGIN


def test_languages_equal_plain_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(docs)
    assert len(model.languages) == 4
    for r in language_id.identify(docs.filter("length(text) < 3000"), model).collect():
        if language_id.has_letter(r["text"] or ""):
            lang, score, unclear = plain_decoding(model, r["text"])
            assert (r["lang_pred"], r["ambiguous"]) == (lang, unclear) and abs(r["score"] - score) < 1e-6


def test_codewords():
    for n in (2, 3, 4, 9, 30):
        code = language_id.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
    nine = language_id.codewords(9)
    distance = min((nine[i] != nine[j]).sum() for i in range(9) for j in range(i))
    assert distance >= 4  # so one wrong bit can be corrected


def test_language_query(spark):
    rows = queries.op5_language_id(spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(langs) and all(0 <= r["score"] <= 1 for r in rows)
    out = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert all(r["held_out"] == held(r["doc_id"]) for r in rows) and np.mean(out) >= 0.97


def test_language_of_odd_rows(spark):
    docs = with_null_id(spark)
    model = language_id.train(docs)
    assert model.languages == ["en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in (0, 3, 6)] == ["und"] * 3 and got[0]["score"] == 0 and got[9]["lang_pred"] in ("en", "fr")
    assert got[9]["size"] == "x"
    assert language_id.train(nothing(spark)) is None
    assert {r["lang_pred"] for r in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(nothing(spark), model).count() == 0
    digits = spark.createDataFrame([(1, "123 456 !?"), (2, "12 é"), (3, "½ ² ① _"), (4, "² 한"), (5, "Ⅷ ٣"), (6, "_ª")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.identify(digits, model).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


# --- network


def test_chunks_cover_texts():
    for n in (0, 1, 12, 1023, 1024, 1025, 5000):
        body = np.arange(n, dtype=np.int64).astype(np.uint8)
        chunks, steps = quality_cnn.chunks_of(body)
        again = np.concatenate([chunks[0], *[c[quality_cnn.OVERLAP :] for c in chunks[1:]]])
        assert (again[:n] == body).all() and not again[n:].any() and len(steps) == len(chunks) and steps.min() >= 1


def test_gradients():
    rng = np.random.Generator(np.random.PCG64(2))
    # doubles, so that the step can be too small to move a maximum
    net = quality_cnn.Network.of([p.astype(np.float64) for p in quality_cnn.Network(3).parameters()])
    net.embed[0] = 0
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (40, 1500, 700)]
    cut = [quality_cnn.chunks_of(np.frombuffer(t, dtype=np.uint8)) for t in texts]
    chunks, steps = (np.concatenate([c[i] for c in cut]) for i in (0, 1))
    who, labels = np.repeat(np.arange(3), [len(c[0]) for c in cut]), np.array([0.0, 1.0, 1.0], dtype=np.float32)

    def loss():
        pool = net.pooled(chunks, steps)
        mean = np.array([pool[who == i].mean(0) for i in range(3)])
        most = np.array([pool[who == i].max(0) for i in range(3)])
        p = net.probability(mean, most)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for p, g in zip(net.parameters(), net.gradients(chunks, steps, who, labels)):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-abs(slope))[:3]:
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - slope[i]) < 1e-3 * abs(slope[i]) + 1e-6


def plain_score(net, body):
    """Chunk by chunk, step by step, filter by filter."""
    pools, at = [], 0
    while True:
        chunk = body[at : at + quality_cnn.CHUNK]
        best = np.zeros(quality_cnn.FILTERS)
        for step in range(0, max(1, min(len(chunk), quality_cnn.CHUNK - quality_cnn.WIDTH + 1)), quality_cnn.STRIDE):
            seen = chunk[step : step + quality_cnn.WIDTH].ljust(quality_cnn.WIDTH, b"\0")
            x = np.concatenate([net.embed[b] for b in seen]).astype(np.float64)
            best = np.maximum(best, [x @ net.filters[:, f] + net.bias[f] for f in range(quality_cnn.FILTERS)])
        pools.append(best)
        at += quality_cnn.STEP
        if at + quality_cnn.OVERLAP >= len(body):
            break
    z = np.concatenate([np.mean(pools, 0), np.max(pools, 0)]) @ net.out + net.base[0]
    return 1 / (1 + np.exp(-z))


def test_scores_equal_plain_convolution(spark):
    net = quality_cnn.Network(5)
    net.embed[0] = 0
    net.out *= 20
    texts = ["", "a", "short text", "x y " * 300, "ab cde é " * 500, "tail " * 192]
    got = {r["doc_id"]: r["score"] for r in quality_cnn.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()}
    want = [plain_score(net, t.encode()) for t in texts]
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-4) and np.ptp(want) > 0.01


def test_network_query(spark):
    rows = queries.op7_quality_cnn(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in labels]) >= 0.9


def test_network_on_odd_rows(spark):
    docs = with_null_id(spark)
    one = spark.createDataFrame([(24, 1), (27, 1), (30, None)], "doc_id long, quality int")
    assert quality_cnn.train(docs, one) in (1.0, 0.5)
    cut = [quality_cnn.chunks_of(np.frombuffer(t, dtype=np.uint8)) for t in (b"good words", b"bad%%%")] * 4
    net = quality_cnn.fit(cut, np.array([1, 0] * 4, dtype=np.float32), epochs=1)
    rows = quality_cnn.scored(docs, net).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        assert abs(same.setdefault(texts[r["doc_id"]], r["score"]) - r["score"]) < 1e-6
    assert quality_cnn.scored(nothing(spark), net).count() == 0
    assert quality_cnn.scored(docs, 0.5).agg(F.max("score")).first()[0] == 0.5
