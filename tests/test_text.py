import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import keys, text


def plain_terms(value):
    """What a text is found by: each run of letters and digits whole, and its neighbours in pairs, those of numbers apart."""
    runs = re.findall("[a-z0-9가-힣ぁ-んァ-ヶ亜-熙]+", (value or "").lower())
    pairs = {a + b for r in runs if not re.fullmatch("[0-9]+", r) for a, b in zip(r, r[1:])}
    return pairs | set(runs)


FIXTURE = {
    "": set(),
    "   ": set(),
    None: set(),
    "파이썬 엔진": {"파이", "이썬", "파이썬", "엔진"},
    "検索エンジン": {"検", "エン", "ンジ", "ジン", "エンジン"},
    "日本語": {"日本"},
    "中国語": {"国"},
    "データベース": {"デ", "タベ", "ス"},
    "Search Engine": {"se", "ea", "ar", "rc", "ch", "search", "en", "ng", "gi", "in", "ne", "engine"},
    "café 2024 a abc123 x_y": {"ca", "af", "caf", "2024", "a", "ab", "bc", "c1", "12", "23", "abc123", "x", "y"},
    "x_y 12 日本語": {"x", "y", "12", "日本"},
}


def tokens(spark, values, f=text.terms):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_fixture(spark):
    for (value, expected), got in zip(FIXTURE.items(), tokens(spark, list(FIXTURE))):
        assert set(got) == expected and len(got) == len(expected), value


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aB1 _é\t\n가ァ日中ー🙂 　Σ٣", max_size=25), min_size=20, max_size=40))
def test_against_rule(spark, values):
    for value, got in zip(values, tokens(spark, values)):
        assert set(got) == plain_terms(value), repr(value)


def test_odd_strings(spark):
    odd = ["x y", "a\u001cb", "a\u0085b", "ＡＢＣ", "K", "a" * 3000, "ab " * 500]
    for value, got in zip(odd, tokens(spark, odd)):
        assert set(got) == plain_terms(value), repr(value)


def test_other_tokenizers(spark):
    assert set(tokens(spark, ["The cat, a dog! x"], text.split_terms)[0]) == {"the", "cat", "dog"}
    assert set(tokens(spark, ["The cat is a b 7 dog's"], text.ascii_terms)[0]) == {"cat", "7", "dog"}


def test_query_terms(spark):
    assert text.query_terms(spark, "Ab ab 12") == ["12", "ab"]
    assert text.query_terms(spark, "it's") == ["it", "s"]
    assert text.query_terms(spark, "") == []


def test_keys(spark):
    import hashlib

    url = "https://example.com/ä"
    digest = hashlib.sha256(url.encode()).digest()
    row = spark.range(1).select(keys.url_key(F.lit(url)).alias("k"), keys.shard_of(keys.url_key(F.lit(url))).alias("s"), keys.bucket_of(keys.url_key(F.lit(url)), 999_983).alias("b"), keys.shard_name(F.lit(10)).alias("n")).first()
    assert row["k"] == digest[:16].hex() and row["s"] == digest[0] and row["n"] == "0a"
    assert row["b"] == int.from_bytes(digest[:8], "little") % 999_983


@pytest.mark.parametrize("meta,filled,field", [('{"description": "red"}', True, "red"), ("{}", False, ""), (None, False, ""), ("no json", False, ""), ('{"x": 1}', True, "")])
def test_metadata(spark, meta, filled, field):
    m = F.lit(meta).cast("string")
    row = spark.range(1).select(keys.is_filled(m).alias("f"), keys.json_field(m, "description", F.lit("")).alias("d")).first()
    assert (row["f"], row["d"]) == (filled, field)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="aB12 _é\t\n가ァ日ー🙂", max_size=14), min_size=20, max_size=40))
def test_terms_without_cutting(spark, values):
    wanted = ["a", "b", "1", "ab", "a1", "12", "22", "121", "aab", "가", "가a", "ァ"]
    tests = text.found_terms(F.col("t"), wanted)
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", tests.alias("x")).collect()
    for value, r in zip(values, sorted(rows)):
        assert [t for t, x in zip(wanted, r["x"]) if x] == [t for t in wanted if t in plain_terms(value)], repr(value)


def test_scan_scores(spark):
    from larkspur.operators import search

    rows = spark.createDataFrame([(1, "Search Engine 12"), (2, None), (3, "x12y"), (4, "112")], "id int, content string")
    got = {r["id"]: r["score"] for r in search.scan_scores(rows, "engine 12", "content", "id").collect()}
    assert got == {1: len(plain_terms("engine 12")), 3: 1}
    assert search.scan_scores(rows, " ", "content", "id").count() == 0
