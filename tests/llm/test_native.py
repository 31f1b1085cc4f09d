"""Sharding, mixing, line dedup and fingerprints."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import fingerprints, line_dedup, mixing, queries, sharding
from tests.llm.rows import nothing, odd_documents, with_null_id, words

SF = "/root/testdata/sf0.001"


def by_id(frame, key="doc_id"):
    return {r[key]: r for r in frame.collect()}


def oracle(name, sf=SF):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    out = c.sql(queries.oracle_sql()[name])
    at = [out.columns.index(x) for x in sorted(out.columns)]
    return sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    frame = queries.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect()), key=repr)
    assert got == oracle(name)


# --- sharding


def test_shards_cover_and_balance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.kd_shards(docs, ["source", "lang", "n_chars"], shards=7).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sums = {}
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(body) + 8, zlib.crc32(body))
        sums.setdefault(r["shard"], []).append(r)
    assert sorted(sums) == list(range(7))
    for own in sums.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    bytes_ = [sum(r["size"] for r in own) for own in sums.values()]
    assert max(bytes_) - min(bytes_) <= 3 * max(r["size"] for r in rows)


def test_shards_of_odd_rows(spark):
    docs = with_null_id(spark)
    rows = sharding.kd_shards(docs, ["source", "lang", "n_chars"], shards=5).collect()
    assert len(rows) == docs.count() and {r["size"] for r in rows if r["doc_id"] == 0} == {8}
    assert sharding.kd_shards(nothing(spark), ["source"], shards=3).count() == 0
    assert sharding.kd_shards(docs, ["n_chars"], target_bytes=10**9).select("shard").distinct().count() == 1


def test_one_hot_value_is_cut(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("s").alias("source"))
    counts = [r["count"] for r in sharding.kd_shards(docs, ["source"], shards=4).groupBy("shard").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 8


def plain_kd(rows, shards):
    """(key, shard) of rows (key, size, tie, coordinates): the tree by sorting whole nodes."""
    if not rows:
        return []
    reach = [max(1, max(r[3][i] for r in rows) - min(r[3][i] for r in rows)) for i in range(len(rows[0][3]))]
    out, todo = [], [(rows, 0, shards)]
    while todo:
        own, first, k = todo.pop()
        if k == 1 or len(own) == 1:
            out += [(r[0], first) for r in own]
            continue
        width = [(max(r[3][i] for r in own) - min(r[3][i] for r in own)) / u for i, u in enumerate(reach)]
        dim = width.index(max(width))
        own = sorted(own, key=lambda r: (r[3][dim], r[2]))
        total, done, at = sum(r[1] for r in own), 0, 0
        want = total * (k // 2) // k
        while done + own[at][1] < want:
            done, at = done + own[at][1], at + 1
        if at + 1 < len(own) and (at == 0 or 2 * (want - done) > own[at][1]):
            at += 1
        at = min(at, len(own) - 1)
        low = max(1, min(round(k * sum(r[1] for r in own[:at]) / total), k - 1, at))
        high = max(1, min(k - low, len(own) - at))
        low = max(low, min(k - high, at))
        todo += [(own[:at], first, low), (own[at:], first + low, high)]
    return out


def shard_case(spark, name):
    rng = random.Random(name)
    letters = lambda n: "".join(rng.choices("abc é", k=n))
    if name == "odd":
        return with_null_id(spark).select("doc_id", "text", "source", F.col("n_chars").alias("n"))
    rows = {
        "few": [(i, letters(9), "s", i) for i in range(23)],
        "one": [(1, "x", None, None)],
        "two": [(1, "x", "s", 1), (2, "y", "s", 1)],
        "huge": [(0, "x" * 30_000, "m", 5), *[(i, letters(60), rng.choice("pmq"), rng.randrange(9)) for i in range(1, 400)]],
        "equal": [(7, "the same", "s", 3)] * 400,
        "long prefix": [(i, letters(30), "common_crawl_" + rng.choice("abcdefg") * 3, -rng.randrange(50)) for i in range(500)],
        "wide": [(i, letters(30), None if i % 3 else f"{i:09}", rng.choice([-(2**63), 2**63 - 1, 0, None])) for i in range(300)],
    }[name]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n long").repartition(3)


@pytest.mark.parametrize("name, shards", [("odd", 1), ("odd", 5), ("few", 24), ("one", 24), ("two", 24), ("huge", 24), ("equal", 4), ("long prefix", 7), ("wide", 6)])
def test_shards_equal_plain_tree(spark, name, shards):
    docs = shard_case(spark, name)
    got = sharding.kd_shards(docs, ["source", "n"], shards=shards).collect()
    body = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    ties = docs.select("*", F.shiftright(F.xxhash64(body, "doc_id", "source", "n"), 2).alias("tie")).collect()
    ranks = [{v: i for i, v in enumerate(sorted({r[c] for r in ties} - {None}))} for c in ("source", "n")]
    numbers = [r["n"] for r in ties if r["n"] is not None]
    if not numbers or max(map(abs, numbers)) < 1 << 61:
        ranks[1] = {v: v for v in numbers} | {None: min(numbers, default=0) - 1}
    rows = [(r["doc_id"], len((r["text"] or "").encode()) + 8, r["tie"], (ranks[0].get(r["source"], -1), ranks[1].get(r["n"], -1))) for r in ties]
    assert sorted(((r["doc_id"], r["shard"]) for r in got), key=repr) == sorted(plain_kd(rows, shards), key=repr)
    held = {}
    for r in got:
        held.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in held.values())
    assert len(held) == min(shards, len(got)) and max(held) == len(held) - 1
    sizes = [sum(r["size"] for r in own) for own in held.values()]
    assert max(sizes) <= max(1.3 * sum(sizes) / len(sizes), 2 * max(r["size"] for r in got))


def test_shards_keep_the_order_of_any_type(spark):
    """The first cut parts values in their own order."""
    for values, kind in (([9.5, 10.0, -3.0, 100.25], "double"), ([-7, -40, 3, 12], "int"), (["common_crawl_b", "common_crawl_a", "zz", "common_crawl_aa"], "string")):
        docs = spark.createDataFrame([(i, "x" * 100, values[i % 4]) for i in range(40)], f"doc_id long, text string, v {kind}")
        got = sharding.kd_shards(docs, ["v"], shards=2).join(docs.select("doc_id", "v"), "doc_id").groupBy("shard").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("shard").collect()
        assert got[0]["hi"] < got[1]["lo"], kind


# --- mixing


def test_water_fill(spark):
    rows = spark.createDataFrame([("a", 10, 3.0), ("b", 100, 1.0), ("c", 1000, 2.0), (None, 50, 0.0), ("z", 0, 5.0)], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.water_fill(rows, 0.5, 2).collect()}
    # budget 580: a is full at 20, the rest is shared 1 : 2
    assert got["a"] == 20 and abs(got["b"] - 560 / 3) < 1e-9 and abs(got["c"] - 1120 / 3) < 1e-9 and got[None] == 0 and got["z"] == 0
    full = {r["source"]: r["target"] for r in mixing.water_fill(rows, 9, 2).collect()}
    assert full["a"] == 20 and full["b"] == 200 and full["c"] == 2000


def test_mix_of_odd_rows(spark):
    docs = with_null_id(spark)
    weigh = lambda s: mixing.cycled_weights(s, [3, 1, 2])
    once = sorted(mixing.mix(docs, weigh, 1.5, 2, 17).select("doc_id", "_size", "_source_size", "_target", mixing.taken().alias("taken"), "source").collect(), key=repr)
    again = sorted(mixing.mix(docs.repartition(3), weigh, 1.5, 2, 17).select("doc_id", "_size", "_source_size", "_target", mixing.taken().alias("taken"), "source").collect(), key=repr)
    assert once == again and len(once) == docs.count()
    taken, target, texts = {}, {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in once:
        assert r["_size"] == len(words(texts[r["doc_id"]])) and r["taken"] <= 2 * r["_size"] and r["_target"] <= 2 * r["_source_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["_target"]
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert mixing.mix(nothing(spark), weigh, 1.5, 2).count() == 0


def test_repeated_texts_add_up(spark):
    docs = odd_documents(spark)
    mixed = mixing.mix(docs, lambda s: mixing.cycled_weights(s, [3, 1, 2]), 1.5, 2, 17)
    want = mixed.agg(F.sum(mixing.taken())).first()[0]
    out = mixing.repeated(mixed, ["doc_id", "text", "lang", "source", "n_chars"]).collect()
    assert sum(len(words(r["text"])) for r in out) == want and all(r["n_chars"] == len(r["text"]) for r in out)


# --- line dedup


def plain_line_dedup(docs):
    seen, out = {}, {}
    for key, text in sorted(docs):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            else:
                seen[w] = (key, i)
        out[key] = (len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup(spark):
    docs = odd_documents(spark)
    got = by_id(line_dedup.dedup_lines(docs))
    want = plain_line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()])
    for key, (n, text) in want.items():
        assert got[key]["n_removed"] == n, key
        assert (got[key]["text"] or "") == text
    assert got[0]["text"] is None and got[0]["n_lines"] == 0 and got[9]["size"] == "x"
    assert sum(n for n, _ in want.values()) > 10


def test_line_dedup_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc\nd"), (None, "q\na\nb\nc"), (3, "a\nb")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).collect()), key=repr)
    assert got == sorted([(1, ""), (1, ""), (2, "d"), (None, "q\na\nb\nc"), (3, "a\nb")], key=repr)
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0


def test_no_python_in_native_plans(spark):
    docs = odd_documents(spark)
    for frame in (line_dedup.dedup_lines(docs), fingerprints.fingerprints(docs), queries.op10_bottom_k_fingerprints(spark, SF), queries.op1_kd_sharding(spark, SF)):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- fingerprints


def true_likeness(a, b):
    s = []
    for t in (a, b):
        w = words(t)
        s.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] | s[1] else 1.0


def plain_fingerprint(text):
    """The 256 least XXH64 hashes, seed 42, chained over a shingle's word hashes."""
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words(text)]
    out = set()
    for i in range(max(1, len(h) - 4) if h else 0):
        one = 42
        for x in h[i : i + 5]:
            one = xxhash.xxh64(x.to_bytes(8, "little"), seed=one).intdigest()
        out.add(one - 2**64 if one >= 2**63 else one)
    return " ".join(f"{x % 2**64:x}" for x in sorted(out)[:256])


def test_fingerprint_query(spark):
    got = by_id(queries.op10_bottom_k_fingerprints(spark, SF))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts)
    same = {}
    for i, key in enumerate(order):
        t, after = texts[key], texts[order[(i + 1) % len(order)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[key]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(t)
        assert abs(r["near_edited"] - true_likeness(t, edited)) < 0.15 and abs(r["near_next"] - true_likeness(t, after)) < 0.15
        assert same.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if i % 7 == 0:
            assert r["fingerprint"] == plain_fingerprint(t) and r["edited_fingerprint"] == plain_fingerprint(edited)


def test_next_row_over_ranges(spark):
    docs = spark.range(0, 3000, 3).select((F.col("id") - 500).alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(5)
    for size in (7, 100, 5000):
        rows = fingerprints.with_next(docs, {"text": F.col("text")}, rows_per_range=size).collect()
        assert len(rows) == 1000
        for r in rows:
            assert r["next_text"] == str((int(r["text"]) + 3) % 3000)


def test_next_row_of_odd_rows(spark):
    docs = with_null_id(spark)
    rows = fingerprints.with_next(docs, {"text": F.coalesce("text", F.lit(""))}, rows_per_range=4).collect()
    assert len(rows) == docs.count()
    assert fingerprints.with_next(nothing(spark), {"text": F.col("text")}).count() == 0
    one = fingerprints.with_next(docs.filter("doc_id = 9"), {"text": F.col("text")}).collect()
    assert [r["next_text"] for r in one] == ["a"]


def test_next_row_of_shared_ids(spark):
    """Rows of one id follow a hash of all they hold, whatever the order of the input; a hot id spans ranges."""
    rows = [(5 if i % 3 else None if i % 2 else i, f"t{i}") for i in range(120)]
    runs = [sorted(((r["text"], r["next_text"]) for r in fingerprints.with_next(spark.createDataFrame(some, "doc_id long, text string").repartition(n), {"text": F.col("text")}, rows_per_range=5).collect())) for some, n in ((rows, 2), (rows[::-1], 5))]
    assert runs[0] == runs[1] and sorted(n for _, n in runs[0]) == sorted(t for _, t in rows)
    ids = {t: k for k, t in rows}
    rank = lambda k: -(10**9) if k is None else k
    assert sum(rank(ids[n]) < rank(ids[t]) for t, n in runs[0]) == 1  # the last goes to the first
    after, at, seen = dict(runs[0]), "t1", set()
    while at not in seen:
        seen.add(at)
        at = after[at]
    assert len(seen) == 120


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(2000, 6000))
    f = lambda t: fingerprints.fingerprint(F.lit(t))
    row = spark.range(1).select(
        fingerprints.resemblance(f(a), f(b)).alias("r"),
        fingerprints.containment(f(a), f(b)).alias("c"),
        fingerprints.distinct_shingles(f(a)).alias("n"),
        (fingerprints.merged(f(a), f(b)) == fingerprints.merged(f(b), f(a))).alias("m"),
        fingerprints.resemblance(f(""), f("")).alias("e"),
        fingerprints.resemblance(f(""), f("x")).alias("z"),
        F.size(fingerprints.fingerprint(F.lit(None).cast("string"))).alias("k"),
    ).first()
    assert abs(row["r"] - 1 / 3) < 0.1 and abs(row["c"] - 0.5) < 0.15 and abs(row["n"] - 3996) < 800
    assert row["m"] and row["e"] == 1.0 and row["z"] == 0.0 and row["k"] == 0
