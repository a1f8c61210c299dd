import math

import pytest
from pyspark.sql import functions as F

from docsieve.functions import text as T
from docsieve.functions import vector as V
from docsieve.operators import sampling
from docsieve.operators.classifier import is_positive
from docsieve.providers import ExampleGenerator, HashEmbedder, create, parse_digits, parse_titles, register


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize(("p", "zone"), [(0.29, 2), (0.3, 1), (0.5, 1), (0.7, 1), (0.71, 0), (float("nan"), None), (None, None)])
def test_zone_edges(spark, p, zone):
    assert one(spark, p, "double", sampling.zone_of("x")) == zone


def test_threshold_is_strict_and_nan_is_not_positive(spark):
    rows = spark.createDataFrame([(0.5,), (0.51,), (float("nan"),)], "p double").select(is_positive(F.col("p")).alias("y")).collect()
    assert [r["y"] for r in rows] == [False, True, False]


@pytest.mark.parametrize(("n", "want"), [(20, [8, 8, 4]), (7, [2, 2, 1]), (1, [1, 1, 1]), (2, [1, 1, 1])])
def test_budgets(n, want):
    assert sampling.budgets(n) == want


@pytest.mark.parametrize(("reply", "want"), [("1 0\n1", [True, False, True]), ("10", None), ("1x0", None), ("", None)])
def test_digit_replies(spark, reply, want):
    assert one(spark, reply, "string", T.digit_verdicts("x", 3)) == want
    assert parse_digits(reply, 3) == want


@pytest.mark.parametrize(("reply", "want"), [("a\n b \n\nc", ["a", "b", "c"]), ("a\nb", ["a", "b"]), ("a\n\n", None)])
def test_title_lines(spark, reply, want):
    assert one(spark, reply, "string", T.title_lines("x", 3)) == want
    assert parse_titles(reply, 3) == want


def test_query_is_trimmed_before_it_is_cut(spark):
    got = one(spark, " \n\t" + "x" * 20_000 + "\n", "string", T.normalised_query("x"))
    assert got == "x" * 15_000


def test_texts(spark):
    assert one(spark, ["a", None], "array<string>", T.numbered("x")) == "0. a\n1. "
    assert one(spark, "t", "string", T.filled(F.lit("{topic} {other}"), "x")) == "t {other}"
    assert one(spark, "[true, false]", "string", T.json_verdicts("x", 2)) == [True, False]
    assert one(spark, "[true]", "string", T.json_verdicts("x", 2)) is None
    assert str(one(spark, "2025-01-02T03:04:05", "string", T.either_timestamp("x"))) == str(one(spark, "2025-01-02 03:04:05", "string", T.either_timestamp("x")))
    assert one(spark, "soon", "string", T.either_timestamp("x")) is None


@pytest.mark.parametrize(("v", "fine"), [([1.0, 0.0], True), ([0.0, 0.0], False), ([1.0], False), ([], False), (None, False), ([float("nan"), 1.0], False), ([None, 1.0], False)])
def test_usable_vectors(spark, v, fine):
    assert one(spark, v, "array<float>", V.is_usable("x", 2)) is fine


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], "array<float>", V.norm("x")) == 5
    assert one(spark, [3.0, 4.0], "array<float>", V.normalised("x")) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], "array<float>", V.normalised("x")) is None
    df = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "x array<float>")
    assert df.select(V.vector_mean("x").alias("m")).first()["m"] == [2.0, 4.0]


def test_hash_embedding(spark):
    rows = HashEmbedder(8).embed(spark.createDataFrame([("Ça va ça",), ("12",), (None,), ("",)], "t string"), "t").collect()
    assert math.isclose(sum(x * x for x in rows[0]["embedding"]), 1)
    assert [r["embedding"] for r in rows[1:]] == [None, None, None]


def test_registry():
    register("generator", "fixed", lambda **_: ExampleGenerator(("a", "b")))
    assert create("generator", "fixed").generate("t", 3) == ["a", "b", "a"]
    for kind, name in (("embedder", "nothing"), ("nothing", "x")):
        with pytest.raises(ValueError, match="unknown"):
            create(kind, name)
    with pytest.raises(ValueError, match="examples"):
        ExampleGenerator(()).generate("t", 1)
