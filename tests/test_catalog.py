"""Every core query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from docsieve import catalog

FOLDER = os.environ.get("DOCSIEVE_TABLES", "/root/testdata/sf0.001")


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, tables, name):
    found = catalog.queries()[name](spark, FOLDER)
    rows = found.collect()
    if name in catalog.oracle_sql():
        wanted = tables.execute(catalog.oracle_sql()[name])
        columns = [d[0] for d in wanted.description]
        assert sorted(columns) == sorted(found.columns)
        assert rows_of(found.columns, rows) == rows_of(columns, wanted.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_learning_loop_takes_every_document(spark, tmp_path):
    rows = [(1, "le chat est dans la maison et les enfants jouent dehors", "fr"), (2, "les fleurs sont dans le jardin", None), (3, "καλημέρα", "el"), (4, None, "fr"), (5, "a house", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    corpus = {r["id"]: r for r in catalog._learner(spark, str(tmp_path)).corpus.collect()}
    assert set(corpus) == {"1", "2", "3", "4", "5"} and corpus["2"]["type"] is None
    assert all((set(r["embedding"]) == {0.0}) == (i in "34") and len(r["embedding"]) == 64 for i, r in corpus.items())


def test_padded_search_fuses_every_query(spark, tmp_path):
    place = {20: 1.0, 40: 2.0, 60: 50.0, 80: 90.0} | {i: 50.0 + i for i in range(1, 11)} | {i: 500.0 + i for i in range(100, 119) if i % 20}
    label = {i: 3 if i in (1, 2, 101, 102, 103, 104, 105, 106, 107, 108) else 0 for i in place}
    rows = [(i, [x] + [1.0] * 63, label[i]) for i, x in place.items()]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = [(r["vec_id"], r["score"]) for r in catalog.search_filtered_padded(spark, str(tmp_path)).collect()]
    near = {}
    for q in (i for i in place if i % 20 == 0):
        ranked = sorted((-1 / (1 + (place[q] - place[i]) ** 2), i) for i in place)[:10]
        for s, i in ranked:
            near[i] = max(near.get(i, 0), -s)
    want = sorted(((round(near.get(i, 0.0), 6), i) for i in place if label[i] == 3), key=lambda t: (-t[0], t[1]))[:10]
    assert found == [(i, s) for s, i in want] and found[0] == (1, 0.5) and found[-1] == (108, 0.0)
