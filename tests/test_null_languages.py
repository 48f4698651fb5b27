"""Documents without a language stay in the topic tables and embeddings, as in the SQL (nulls rank last)."""

from __future__ import annotations

import pytest

from skein import catalog

LANGS = ["de", None, "en", None, "fr"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("null-languages"))
    words = ["sunset beach", "rain cloud", "train city", "moon night", "river stone"]
    rows = [(i, f"{words[i % 5]} word{i % 3} common talk", LANGS[i % 5]) for i in range(1, 101)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["topic_info", "topic_table"])
def test_null_languages_equal_the_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    found = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(r) for r in found.fetchall()), key=repr)
    got = catalog.QUERIES[name](spark, folder).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_null_languages_are_counted_and_embedded(spark, folder):
    info = {r["topic"]: r["count"] for r in catalog.QUERIES["topic_info"](spark, folder).collect()}
    assert info.keys() == {-1, 0, 1, 2, 3} and sum(info.values()) == 100  # topic 3 has no language
    assert catalog.QUERIES["embed_hashed"](spark, folder).count() == 100
