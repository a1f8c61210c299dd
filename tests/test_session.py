import json

import pytest
from pyspark.sql import functions as F

from docsieve.plans.dataset import DatasetBuilder
from docsieve.plans.session import ActiveLearner, Settings
from docsieve.providers import ExampleGenerator, HashEmbedder, RuleEvaluator
from docsieve.streaming.replies import keep_labels, reply_stream, verdict_stream

NOUNS = ["arm", "gripper", "wheel", "leg", "joint", "sensor", "motor", "hand"]
FOODS = ["bread", "soup", "cheese", "apple", "onion", "salt", "butter", "pear"]


def corpus(spark, n=60):
    rows = []
    for i in range(n):
        words = NOUNS if i % 2 else FOODS
        rows.append((f"{i:03}", " ".join(words[(i * k + k) % 8] for k in range(1, 7)) + (" robot" if i % 2 else " kitchen")))
    return HashEmbedder().embed(spark.createDataFrame(rows, "id string, text string").withColumn("extra", F.lit(1)), "text")


def learner(spark, rule, docs=None, **settings):
    generator = ExampleGenerator(("robot arm gripper motor", "robot leg wheel sensor joint"))
    return ActiveLearner(corpus(spark) if docs is None else docs, generator, RuleEvaluator(rule), HashEmbedder(), Settings(**{"n_synthetic": 4, "n_nearest": 10, "n_per_iteration": 8, "n_iterations": 4} | settings))


def test_finds_the_topic_and_writes_its_files(spark, tmp_path):
    run = learner(spark, lambda _, t: "robot" in t).classify("  robotics ", str(tmp_path))
    rows = run.results.collect()
    assert run.trained and {int(r["id"]) % 2 for r in rows} == {1} and len(rows) >= 25
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert all(r["score"] > 0.5 for r in rows) and "extra" in rows[0].asDict()
    params = json.loads((tmp_path / run.params["session_id"] / "params.json").read_text())
    assert params["query"] == "robotics" and params["statistics"]["positive_items"] == len(rows)
    assert {p.name for p in (tmp_path / params["session_id"]).iterdir()} >= {"results.parquet", "model", "params.json", "run.log"}


def test_one_class_takes_the_furthest_as_negatives(spark):
    run = learner(spark, lambda *_: True, n_iterations=2).classify("robotics")
    assert run.trained and sum(not v for v in run.labels.values()) == 4 + 10


def test_nothing_left_of_one_class_gives_no_model(spark):
    run = learner(spark, lambda *_: True, docs=corpus(spark, 5), n_iterations=2).classify("robotics")
    assert not run.trained and run.results.count() == 0 and "score" in run.results.columns


def test_few_documents_end_after_the_first_iteration(spark):
    run = learner(spark, lambda _, t: "robot" in t, docs=corpus(spark, 6), n_nearest=40).classify("robotics")
    assert run.params["statistics"]["iterations_completed"] == 1 and len(run.labels) == 6


def test_no_examples_and_short_replies_are_refused(spark):
    with pytest.raises(ValueError, match="examples"):
        learner(spark, lambda *_: True, n_synthetic=0).classify("robotics")
    broken = learner(spark, lambda *_: True)
    object.__setattr__(broken.evaluator, "evaluate", lambda *_: [True])
    with pytest.raises(ValueError, match="verdicts"):
        broken.classify("robotics")


def test_datasets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "k long, text string")
    builder = DatasetBuilder(HashEmbedder(16))
    back, note = builder.read(spark, builder.build(docs, "text", str(tmp_path / "d")))
    assert back.count() == 3 and note["dataframe_info"]["shape"] == [3, 2] and "embeddings_shape" not in note
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "k long, embedding array<double>")
    _, note = builder.read(spark, builder.build_from_vectors(docs, vectors, "k", "text", str(tmp_path / "e")))
    assert note["embeddings_shape"] == [3, 1]
    with pytest.raises(ValueError, match="vectors of"):
        DatasetBuilder(HashEmbedder(8)).read(spark, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="column"):
        builder.build(docs, "none", str(tmp_path / "f"))


def test_reply_stream_counts_repetitions_once(spark, tmp_path):
    rows = [(1, "s", 1, ["a", "b"], "1 0", "2025-01-01 00:00:00"), (1, "s", 1, ["a", "b"], "1 0", "2025-01-01 00:00:01"), (2, "s", 1, ["c"], "x", "2025-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "eval_id long, session_id string, iteration int, record_ids array<string>, raw_reply string, replied_at string").withColumn("replied_at", F.col("replied_at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    query = keep_labels(verdict_stream(reply_stream(spark, str(tmp_path / "in"), df.schema)), lambda batch, _: seen.extend(batch.collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert sorted((r["id"], r["verdict"]) for r in seen) == [("a", True), ("b", False)]


def test_rows_with_odd_vectors_are_left_out_and_counted(spark):
    good = corpus(spark)
    odd = [("x1", [float("nan")] * 64), ("x2", [float("inf")] + [0.0] * 63), ("x3", None), ("x4", [1.0]), ("x5", [None] + [1.0] * 63), ("x6", [0.0] * 64)]
    bad = spark.createDataFrame(odd, "id string, embedding array<double>").withColumn("text", F.lit("x")).withColumn("extra", F.lit(1)).select(*good.columns)
    run = learner(spark, lambda *_: True, docs=good.unionByName(bad), n_iterations=3).classify("robotics")
    assert run.trained and run.params["statistics"]["unusable_items"] == 5 and run.params["statistics"]["total_items"] == 61
    assert not {"x1", "x2", "x3", "x4", "x5"} & set(run.labels)
