import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.operators import labels as L
from docsieve.operators import metrics, ranking, sampling
from docsieve.operators.classifier import BalancedLogisticRegression
from docsieve.operators.search import search, top_k
from docsieve.sources.files import attach_vectors, read_csv, read_vectors, settings
from docsieve.sources.index import Index, as_list, newest


def test_as_list():
    assert (as_list(None), as_list(""), as_list("a"), as_list(["a", "b"])) == ([], [], ["a"], ["a", "b"])


def test_index_pages_and_filters(spark, tmp_path):
    rows = [(f"d{i:03}", "a" if i % 2 else "b", f"n{i}", "t", [1.0]) for i in range(25)]
    spark.createDataFrame(rows, "id string, type string, name string, text string, embedding array<float>").write.parquet(str(tmp_path / "ix"))
    index = Index(spark, str(tmp_path / "ix"))
    assert index.count() == 25
    assert [p.count() for p in index.pages(10)] == [10, 10, 5]
    assert [r["id"] for r in index.page("d003", 2, "a").collect()] == ["d005", "d007"]
    plan = index.scan(["a"], ("id",))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(type" in plan or "EqualTo(type" in plan
    assert "ReadSchema: struct<id:string,type:string>" in plan
    with index.snapshot("b", ("id",)) as view:
        assert view.count() == 13


def test_newest_breaks_ties_and_drops_null_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 9, "n")], "k string, o int, v string")
    assert [tuple(r) for r in newest(df, ["k"], "o").collect()] == [("a", 2, "z")]
    assert newest(df.limit(0), ["k"], "o").count() == 0


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('text\n"a, ""b""\nc"\nplain\n')
    assert [r["text"] for r in read_csv(spark, str(tmp_path / "x.csv")).collect()] == ['a, "b"\nc', "plain"]


def test_vectors_from_a_file_and_row_counts(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(3, 2))
    vectors = read_vectors(spark, str(tmp_path / "v.npy"))
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "row long, t string")
    assert attach_vectors(docs, vectors, "row").count() == 3
    with pytest.raises(ValueError, match="one to one"):
        attach_vectors(docs, vectors.where("row < 2"), "row")


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "s").write_text("# no\nA=1\nB = 'two'\nbroken\n")
    monkeypatch.setenv("A", "env")
    assert settings(tmp_path / "s") == {"A": "env", "B": "two"}
    assert settings(tmp_path / "none") == {}


def test_labels(spark):
    replies = spark.createDataFrame([(1, "s", ["a", "b"], "10", 1), (2, "s", ["b"], "1", 2), (3, "s", ["a", "c"], "1", 3)], "eval_id long, session_id string, record_ids array<string>, raw_reply string, replied_at int")
    found = L.latest_labels(replies)
    assert {(r["id"], r["verdict"]) for r in found.collect()} == {("a", True), ("b", True)}
    rows = spark.createDataFrame([("s", "a", False, False), ("s", "b", False, None), ("s", "c", False, None), ("s", "syn-0", True, True)], "session_id string, id string, is_synthetic boolean, gt boolean")
    merged = {r["id"]: r["gt"] for r in L.merge_labels(rows, found, ["session_id", "id"]).collect()}
    assert merged == {"a": True, "b": True, "c": None, "syn-0": True}
    assert [r["id"] for r in L.unlabelled(rows, found, ["session_id", "id"]).collect()] == ["c"]
    weights = {r["gt"]: r["weight"] for r in L.class_weights(rows, []).collect()}
    assert weights == {True: 1.0, False: 1.0}


def test_nearest_and_furthest_break_ties_by_id(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "id string, distance double")
    assert [r["id"] for r in ranking.nearest(df, 2).collect()] == ["a", "b"]
    assert [r["id"] for r in ranking.furthest(df, 2).collect()] == ["c", "a"]
    assert ranking.nearest(df, 40).count() == 3


def test_flip_rate(spark):
    a, b, none = (spark.createDataFrame([(x,) for x in v], "id string") for v in (["1", "2"], ["3"], []))
    rate = lambda x, y: metrics.flip_rate_of_sets(x, y).first()["flip_rate"]
    assert (rate(none, none), rate(a, a), rate(a, b), rate(b, a)) == (0, 0, 1, 1)


def picks(spark, rows, n):
    df = spark.createDataFrame(rows, "id string, prediction double, embedding array<double>")
    return sampling.stratified_diverse(df, n)


def test_selection(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{i:03}", float(p), [float(x) for x in rng.standard_normal(4)]) for i, p in enumerate(rng.random(300))]
    found = picks(spark, rows, 20).collect()
    assert len({r["id"] for r in found}) == len(found) <= 20
    assert [r["zone"] for r in sorted(found, key=lambda r: r["pick"])] == sorted(r["zone"] for r in found)
    assert {r["id"] for r in found} == {r["id"] for r in picks(spark, rows[::-1], 20).collect()}
    assert picks(spark, rows, 0).count() == 0
    assert picks(spark, [r for r in rows if r[1] <= 0.7], 20).count() <= 12  # an unused budget is not passed on
    assert len(picks(spark, rows, 1).collect()) == 1


def test_zone_picks(spark):
    df = spark.createDataFrame([(f"{i:03}", i / 100) for i in range(100)] + [("nan", float("nan")), ("null", None)], "id string, prediction double").withColumn("s", F.lit(1))
    found = sampling.zone_picks(df, ["s"], 20).collect()
    assert sorted(r["zone"] for r in found) == [0] * 8 + [1] * 8 + [2] * 4
    assert sampling.zone_picks(df, ["s"], 2).count() == 2
    assert sampling.zone_picks(df, ["s"], 0).count() == 0


def test_regression_reaches_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8))
    y = x[:, 0] + 0.5 * rng.standard_normal(120) > 0.6
    df = spark.createDataFrame([(i, [float(v) for v in r], bool(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, embedding array<double>, gt boolean")
    model = BalancedLogisticRegression(c=2.0).fit(df)
    w, b = model.model.coefficients.toArray(), model.model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    weight = np.where(y, 120 / (2 * y.sum()), 120 / (2 * (~y).sum()))
    assert np.abs(2.0 * x.T @ (weight * (p - y)) + w).max() < 1e-4
    assert abs((weight * (p - y)).sum()) < 1e-4
    got = model.predict(df).orderBy("id").collect()
    assert np.allclose([r["prediction"] for r in got], p, atol=1e-9)
    with pytest.raises(ValueError, match="both classes"):
        BalancedLogisticRegression().fit(df.where("gt"))


def vectors(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4))
    return x, spark.createDataFrame([(f"{i:03}", "a" if i % 3 else "b", [float(v) for v in r]) for i, r in enumerate(x)], "id string, type string, embedding array<double>")


@pytest.mark.parametrize("score", ["l2", "cosine"])
def test_search_against_brute_force(spark, score):
    x, docs = vectors(spark)
    queries = docs.where("id < '010'").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    found = top_k(docs.repartition(5), queries, 7, score, 4).collect()
    for q in range(10):
        s = 1 / (1 + ((x[q] - x) ** 2).sum(1)) if score == "l2" else (1 + x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])) / 2
        want = [f"{i:03}" for i in np.lexsort((np.arange(60), -np.round(s, 9)))[:7]]
        assert [r["id"] for r in sorted((r for r in found if r["query"] == f"{q:03}"), key=lambda r: r["rank"])] == want


def test_search_modes(spark):
    x, docs = vectors(spark)
    query = docs.where("id = '001'").select(F.lit(0).alias("query"), F.col("embedding").alias("vector"))
    padded = search(docs, query, 10, ["b"], dimension=4).collect()
    assert len(padded) == 10 and sum(r["score"] == 0 for r in padded) >= 1
    inside = search(docs, query, 10, ["b"], mode="pre_filter", dimension=4).collect()
    assert all(r["score"] > 0 for r in inside) and all(int(r["id"]) % 3 == 0 for r in inside)
    assert search(docs, query.limit(0), 5, dimension=4).count() == 0
    with pytest.raises(ValueError, match="mode"):
        search(docs, query, 5, mode="other")


def test_search_ties_and_unusable_vectors(spark):
    docs = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("z", [0.0, 0.0]), ("n", None), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    query = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query int, vector array<double>")
    assert [(r["query"], r["id"]) for r in top_k(docs, query, 2, dimension=2).orderBy("rank").collect()] == [(1, "a"), (1, "b")]


def test_hot_groups_are_ranked_in_parts(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", i, (i * 37) % 101 / 7, 2 + i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, i long, x double, n int").withColumn("n", F.when(F.col("g") == "hot", 5).otherwise(F.lit(2)))
    order = [F.desc("x"), F.col("i")]
    want = {}
    for g, i, x, _ in sorted(rows, key=lambda r: (-r[2], r[1])):
        want.setdefault(g, []).append(i)
    found = {(r["g"], r["rank"]): r["i"] for r in ranking.first_rows(df, ["g"], order, F.col("n")).collect()}
    assert found == {(g, k + 1): i for g, ids in want.items() for k, i in enumerate(ids[: 5 if g == "hot" else 2])}
    ranked = {(r["g"], r["rank"]): r["i"] for r in ranking.all_ranked(df, ["g"], order).collect()}
    assert ranked == {(g, k + 1): i for g, ids in want.items() for k, i in enumerate(ids)}
    assert ranking.all_ranked(df.limit(0), ["g"], order).count() == 0 and ranking.first_rows(df.limit(0), ["g"], order, F.col("n")).count() == 0


def test_only_repeated_wide_rows_move(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("a", 2, [2.0]), ("b", 1, None), (None, 1, [0.0])], "k string, o int, v array<double>")
    assert sorted(map(tuple, newest(df, ["k"], "o").collect())) == [("a", 2, [2.0]), ("b", 1, None)]
    assert newest(df.where("o = 9"), ["k"], "o").count() == 0


def test_newton_finds_the_optimum_that_spark_finds(spark, monkeypatch):
    from docsieve.operators import classifier

    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 5))
    y = x @ [1, -2, 0.5, 0, 3] + rng.standard_normal(80) > 1
    df = spark.createDataFrame([(i, v.tolist(), bool(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "i long, embedding array<double>, gt boolean")
    own = {r["i"]: r["prediction"] for r in BalancedLogisticRegression().fit(df).predict(df).collect()}
    monkeypatch.setattr(classifier, "SMALL", 0)
    theirs = {r["i"]: r["prediction"] for r in BalancedLogisticRegression().fit(df).predict(df).collect()}
    assert max(abs(own[i] - theirs[i]) for i in own) < 1e-6
