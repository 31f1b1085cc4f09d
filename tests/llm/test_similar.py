"""Jaccard join and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bytehash, components, jaccard_join, sketch, substring_dedup
from tests.llm.rows import nothing, odd_documents, shingles, with_null_id, words


def plain_components(docs):
    sets = {k: shingles(t) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed, n=260):
    """Groups of near copies around the threshold, shared passages, copies, short texts."""
    rng = random.Random(seed)
    make = lambda k: " ".join(f"w{rng.randrange(400)}" for _ in range(k))
    bases = [make(rng.randrange(5, 160)) for _ in range(18)]
    passages = [make(60) for _ in range(3)]
    out = []
    for i in range(n):
        kind = rng.random()
        b = rng.choice(bases)
        if kind < 0.5:
            out.append(near(rng, b, rng.randrange(0, 6)))
        elif kind < 0.6:
            out.append(near(rng, bases[0], rng.randrange(0, 4)) + " tail" * rng.randrange(3))
        elif kind < 0.8:
            out.append(f"{make(rng.randrange(1, 40))} {rng.choice(passages)} {make(rng.randrange(1, 10))}")
        else:
            out.append(make(rng.randrange(1, 12)))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_components(docs)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == plain_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    extra = with_null_id(spark)
    rows = jaccard_join.near_duplicates(extra).collect()
    assert len(rows) == extra.count() and [r for r in rows if r["doc_id"] is None]
    assert jaccard_join.near_duplicates(nothing(spark)).count() == 0


def test_chain_of_links(spark):
    """A path: neighbours link, the ends do not."""
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[i * 9 : i * 9 + 100])) for i in range(11)]
    got = {r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0} and plain_components(docs)[10] == (96, 0)


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {k: find(k) for e in edges if e[0] != e[1] for k in e}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_count_filter_of_shared_ids(spark):
    """A larger text of the same id does not raise what a pair needs."""
    entries = lambda k, tokens, n, last: [(t, k, n, 0, last) for t in tokens]
    columns = "token long, rep long, n long, dead int, last long"
    a = spark.createDataFrame(entries(1, range(12), 100, 30) + entries(1, [0], 120, 50), columns)
    b = spark.createDataFrame(entries(2, range(21), 100, 20), columns)
    assert [tuple(r) for r in jaccard_join._met(a, b, F.col("a.rep") != F.col("b.rep")).collect()] == [(1, 2)]


def test_rows_of_shared_ids_keep_apart(spark):
    """Beside a text that links, an id holds a larger one that shares a few shingles, or texts of several groups."""
    rng = random.Random(11)
    make = lambda name, k: " ".join(f"{name}{i}" for i in range(k))
    docs, want = [], {}
    for i in range(60):
        text = make(f"g{i}x", 104)
        docs += [(1000 + i, text), (2000 + i, near(rng, text, 2)), (2000 + i, " ".join(text.split()[:12]) + " " + make(f"h{i}x", 110))]
        # longer texts that hold the first, so that its shingles count as shared
        docs += [(10_000 + 10 * i + j, text + " " + make(f"z{i}y{j}x", 300)) for j in range(4)]
        one, other = shingles(text), shingles(docs[-6][1])
        if 100 * len(one & other) >= 80 * len(one | other):
            want[1000 + i] = want[2000 + i] = {1000 + i}
    docs += [(5, make("p", 50)), (7, make("p", 50)), (7, make("q", 50)), (7, ""), (9, make("q", 50) + " tail")]
    docs += [(None, make("p", 50)), (None, make("r", 50)), (None, make("s", 50)), (None, make("s", 50)), (4, make("r", 50) + " tail"), (None, None)]
    got = {}
    for r in jaccard_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert len(want) > 60
    for k in want:
        assert {c for _, c in got[k]} == ({1000 + k % 1000} if k < 2000 else {1000 + k % 1000, k})
    # rows as nodes: the texts of 7 belong to the groups of 5, of itself, and to none
    assert [c for _, c in got[5]] == [5] and sorted(got[7]) == [(0, 7), (46, 5), (46, 7)] and [c for _, c in got[9]] == [7]
    assert sorted(got[None], key=repr) == sorted([(46, 5), (46, 4), (46, None), (46, None), (0, None)], key=repr) and [c for _, c in got[4]] == [4]


# --- substring dedup


def plain_substrings(docs, size=50):
    first = {}
    for key, text in docs:
        w = words(text)
        for i in range(len(w) - size + 1):
            win = tuple(w[i : i + size])
            first[win] = min(first.get(win, key), key)
    out = {}
    for key, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key:
                gone |= set(range(i, i + size))
        out[key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_substrings_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in odd_documents(spark).collect()] + [(1000 + k, t) for k, t in corpus(7, 150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup_substrings(frame).collect()}
    assert got == plain_substrings(docs)
    assert sum(n for _, n, _ in got.values()) > 500


def test_substrings_of_odd_tables(spark):
    extra = with_null_id(spark)
    rows = substring_dedup.dedup_substrings(extra).collect()
    assert len(rows) == extra.count()
    shared = [(1, " ".join(f"a{i}" for i in range(80))), (2, " ".join(f"a{i}" for i in range(80))), (2, " ".join(f"b{i}" for i in range(80))), (3, " ".join(f"b{i}" for i in range(10, 90)))]
    shared += [(None, "c " * 60), (None, " ".join(f"a{i}" for i in range(70))), (5, "c " * 60 + "d"), (5, "c " * 60 + "d")]
    got = sorted(((r["doc_id"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(shared, "doc_id long, text string")).collect()), key=repr)
    b = [f"b{i}" for i in range(90)]
    want = [(1, 70, " ".join(f"a{i}" for i in range(70, 80))), (2, 80, ""), (2, 0, " ".join(b[:80])), (3, 70, " ".join(b[80:])), (None, 0, "c " * 59 + "c"), (None, 0, shared[5][1]), (5, 60, "d"), (5, 60, "d")]
    assert got == sorted(want, key=repr)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert len(by[24]) == 2 and by[24][0] == by[24][1]
    assert by[None][0][1] == 0  # the null id comes first
    assert substring_dedup.dedup_substrings(nothing(spark)).count() == 0


# --- hashes and sketches


def test_hashes_of_words_and_windows():
    rng = random.Random(1)
    texts = [None, "", " ", "a", *("".join(rng.choice("ab \t\né") for _ in range(rng.randint(0, 40))) for _ in range(800))]
    data, offsets = bytehash.text_bytes(pa.array(texts))
    starts, stops, first = bytehash.word_spans(data, offsets)
    hashes, seen, windows = bytehash.hash_spans(data, starts, stops), {}, {}
    for i, t in enumerate(texts):
        own = [bytes(data[starts[j] : stops[j]]).decode() for j in range(first[i], first[i + 1])]
        assert own == words(t)
        for j, w in enumerate(own):
            assert seen.setdefault(w, hashes[first[i] + j]) == hashes[first[i] + j]
    assert len(set(seen.values())) == len(seen)
    for size in (3, 20):
        made = bytehash.window_hashes(hashes, size)
        for i, h in enumerate(made):
            assert windows.setdefault(tuple(hashes[i : i + size]), h) == h
    assert len(set(windows.values())) == len(windows)


def test_pieces_do_not_change_hashes(monkeypatch):
    text = pa.array([" ".join(f"w{i}" for i in range(3000)), "x" * 5000])
    data, offsets = bytehash.text_bytes(text)
    starts, stops, _ = bytehash.word_spans(data, offsets)
    whole = bytehash.hash_spans(data, starts, stops)
    monkeypatch.setattr(bytehash, "PIECE", 100)
    assert (bytehash.hash_spans(data, starts, stops) == whole).all()


def test_sketch_misses_nothing(spark):
    values = [i % 700 for i in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)

    def names(batch):
        yield bytehash.mixed(batch.column(0).to_numpy().view(np.uint64))

    for bits in (16, 18):
        tables = sketch.repeated_bits(frame, names, bits)
        flags = sketch.maybe_repeated(tables, bytehash.mixed(np.arange(700, dtype=np.uint64)))
        assert flags[:300].all() and flags[300:].mean() < 0.1
    held = sketch.members(frame)
    assert sketch.maybe_member(held, np.arange(700)).all() and sketch.maybe_member(held, np.arange(700, 5000)).mean() < 0.1


def test_kept_digest(spark):
    from larkspur.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_substrings(docs)
    for r in queries.op9_substring_dedup(spark, sf).select("*", F.lit(1).alias("one")).collect():
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]][2].encode()).hexdigest()
