"""Packing: tokens by the tokenizer itself, bins against exhaustive search; and the pipeline."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from larkspur.llm import packing, queries
from tests.llm.rows import nothing, odd_documents, with_null_id

SF = "/root/testdata/sf0.001"


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins) if b >= items[i]}.values():
            bins[j] -= items[i]
            place(i + 1, bins)
            bins[j] += items[i]
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


def bins_of(counts, capacity, **more):
    made, got = packing.pack_lengths(dict(counts), capacity, **more), Counter()
    for pattern, n in made:
        assert sum(pattern) <= capacity and n > 0
        for x in pattern:
            got[x] += n
    assert got == Counter(counts)
    return sum(n for _, n in made)


def test_bins_are_the_fewest():
    rng, better = random.Random(3), 0
    for _ in range(250):
        capacity = rng.choice([20, 61, 100])
        items = Counter(rng.randint(capacity // 10, capacity * 6 // 10) for _ in range(rng.randint(1, 12)))
        n, greedy = bins_of(items, capacity), sum(k for _, k in packing.best_fit(dict(items), capacity))
        assert packing.lower_bound(dict(items), capacity) <= n == fewest(list(items.elements()), capacity) <= greedy
        better += n < greedy
    assert better


def test_exhaustive_search():
    """Without a bound on its effort the search finds the fewest bins, also where best fit and the bound disagree."""
    rng, better = random.Random(8), 0
    for _ in range(150):
        capacity = rng.choice([12, 30, 50])
        items = Counter(rng.randint(max(1, capacity // 8), capacity * 6 // 10) for _ in range(rng.randint(1, 11)))
        n = bins_of(items, capacity, effort=None, look=rng.choice([1, 3, 1000]))
        assert n == fewest(list(items.elements()), capacity)
        better += n < sum(k for _, k in packing.best_fit(dict(items), capacity))
    assert better
    # many of each: a filling is not best used as often as possible
    assert bins_of({6: 4, 4: 2, 3: 8, 2: 4, 5: 2}, 10, effort=None) == fewest(list(Counter({6: 4, 4: 2, 3: 8, 2: 4, 5: 2}).elements()), 10)


def test_long_runs_and_words(spark):
    """Texts that the fast engine's pattern gives up on."""
    long = ["x" + c * 1_000_000 + "y" for c in (" ", "\n", "\t")] + ["a" * 1_000_000, " \n" * 300_000]
    docs = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    check(packing.pack_documents(docs).collect(), {i: [t] for i, t in enumerate(long)})


def test_large_histograms():
    rng = random.Random(5)
    counts = {i: rng.randrange(10**6) for i in range(1, 1025)}
    n = bins_of(counts, 1024)
    assert n <= 1.01 * packing.lower_bound(counts, 1024)
    assert bins_of({}, 1024) == 0 and bins_of({1024: 5, 1: 3}, 1024) == 6


def check(rows, texts, capacity=1024):
    """rows: pieces with places; texts: id -> list of texts."""
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    for key, some in texts.items():
        want = Counter()
        for t in some:
            ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
            n = -(-len(ids) // capacity)
            head = len(ids) - (n - 1) * capacity
            for p in range(n):
                a, b = (0, head) if not p else (head + (p - 1) * capacity, head + p * capacity)
                want[(p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own[key]) == want
    assert sum(len(v) for v in own.values()) == len(rows)
    return len(places)


def test_packing_query(spark):
    texts = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_best_fit_packing(spark, SF).collect()
    n = check(rows, texts)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 2


def test_packing_odd_rows(spark):
    docs = with_null_id(spark)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    check(packing.pack_documents(docs, capacity=64).collect(), texts, 64)
    assert packing.pack_documents(nothing(spark)).count() == 0
    special = spark.createDataFrame([(1, "a<|endoftext|>b"), (2, "<|endoftext|>")], "doc_id long, text string")
    check(packing.pack_documents(special).collect(), {1: ["a<|endoftext|>b"], 2: ["<|endoftext|>"]})


def test_engines_agree():
    encode = packing._load(None)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    alphabet = [" ", "\n", "\t", "\r", "a", "B", "é", "1", "'", "s", "'ll", "!", " ", "　", "한", "😀", "٣", "́", "\x0b", "\x85", "½", "​"]
    texts = ["".join(rng.choices(alphabet, k=30)) for _ in range(3000)] + [f"a{chr(c)}b 1{chr(c)}" for c in range(1, 0xD800, 7)]
    for t, e in zip(texts, exact.encode_batch(texts, add_special_tokens=False)):
        assert encode(t).tolist() == e.ids, repr(t)


def test_ids_are_the_pieces(spark):
    docs = odd_documents(spark).filter("doc_id >= 24")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    exact, made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(list)
    for r in packing.pieces(docs, capacity=100).orderBy("doc_id", "piece").collect():
        made[r["doc_id"]] += np.frombuffer(r["ids"], dtype="<u4").tolist()
    for key, ids in made.items():
        assert ids[-1] == 2 and exact.decode(ids[:-1], skip_special_tokens=False) == texts[key]
