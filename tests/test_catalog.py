import duckdb
import pytest

from larkspur.operators import kv
from larkspur.plans import catalog
from larkspur.store import DocumentStore

#: Urls that come again before and after an id divisible by 20, twice under such ids, and under one id; no url, no id.
PAGES = [(0, "a"), (7, "a"), (20, "b"), (13, "b"), (40, "c"), (60, "c"), (61, "c"), (-20, "d"), (-5, "d"), (80, "e"), (80, "e"), (80, "f"), (100, None), (120, None), (121, None), (None, "g"), (None, "a"), (33, "h"), (140, "")]


@pytest.mark.parametrize("pages", [PAGES, [(20 * i % 340, "hot") for i in range(300)], []])
def test_get_many_against_its_sql(spark, tmp_path, pages):
    spark.createDataFrame([(i, u, f"{i} {u}") for i, u in pages], "page_id long, url string, html string").coalesce(2).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(catalog.oracle_sql()["kv_get_many"])
    got = catalog.queries()["kv_get_many"](spark, str(tmp_path))
    assert got.columns == want.columns

    def rows(of):
        return sorted(((u is not None, u or "", n) for u, n in of))

    assert rows(tuple(r) for r in got.collect()) == rows(want.fetchall())


def test_versions_of_a_key(spark, tmp_path):
    store = DocumentStore(spark, str(tmp_path / "store"))
    changes = [("a", "one", "put", 0), ("a", "two", "put", 1), ("b", "x", "put", 2), ("a", None, "delete", 3), ("b", "y", "put", 4)]
    store.put_many(spark.createDataFrame(changes, "url string, content string, op string, seq long"))
    numbers = [r["lsn"] for r in store.log().orderBy("lsn").collect()]
    # the first two of a, its delete, both of b, one of b asked twice, and what isn't there
    asked = spark.createDataFrame([("a", numbers[0]), ("a", numbers[1]), ("a", numbers[3]), ("b", numbers[2]), ("b", numbers[2]), ("b", numbers[4]), ("b", numbers[0]), ("c", numbers[0]), ("b", None), (None, numbers[0])], "url string, lsn long")
    got = kv.get_many(store.log(), asked, versions=True).collect()
    assert sorted((r["url"], r["content"]) for r in got) == [("a", "one"), ("a", "two"), ("b", "x"), ("b", "y")]
    # without versions a column lsn says nothing
    assert [(r["url"], r["content"]) for r in kv.get_many(store.log(), asked).collect()] == [("b", "y")]
