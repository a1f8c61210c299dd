"""The learning loop: examples, nearest rows, labels, classifier, next rows, until predictions settle."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field
from uuid import uuid4

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import QUERY_CHARS
from docsieve.functions.vector import distance, doubles, is_finite
from docsieve.operators.classifier import BalancedLogisticRegression, Classifier, is_positive
from docsieve.operators.metrics import flip_rates
from docsieve.operators.ranking import centroids, furthest, nearest
from docsieve.operators.sampling import stratified_diverse
from docsieve.plans.durable import durable, write_text
from docsieve.providers import Embedder, Evaluator, Generator, evaluate_documents, generate_documents

#: Share of changed positives below which a run stops.
SETTLED = 0.02


@dataclass
class Settings:
    # The defaults of a run
    n_synthetic: int = 10
    n_nearest: int = 40
    n_iterations: int = 15
    n_per_iteration: int = 20
    c: float = 1.0
    settled: float = SETTLED
    tol: float = 1e-9
    seed: int = 42
    trust_labels: bool = False


@dataclass
class Run:
    """What a run gives back: positives with their score, where its files are, and its parameters."""

    results: DataFrame
    folder: str | None
    params: dict
    trained: bool
    labels: dict[str, bool] = field(repr=False, default_factory=dict)


class ActiveLearner:
    """Finds every document of a corpus about a topic.

    The corpus is a frame of ``id, text, embedding`` and any further columns. It is scanned, never collected: the driver
    holds the labelled rows (a few hundred), the examples and the model. Predictions are a function of corpus and model, so that
    the plan of an iteration does not grow with those before and no predictions are kept. Rows with a null id, or whose vector is null, of another
    length than the examples' or not finite, take no part and are counted as ``unusable_items``; a vector of zeros is scored like the rest.
    """

    def __init__(self, corpus: DataFrame, generator: Generator, evaluator: Evaluator, embedder: Embedder, settings: Settings | None = None, index_name: str = "", document_type: str | None = None):
        self.corpus, self.generator, self.evaluator, self.embedder = corpus, generator, evaluator, embedder
        self.settings, self.index_name, self.document_type = settings or Settings(), index_name, document_type

    def classify(self, query: str, output_dir: str | None = None) -> Run:
        """One run for one topic. With ``output_dir``, results, model, parameters and log go to a folder of the run's own below it, on any file system Spark can write to."""
        began, session = time.time(), str(uuid4())
        folder = f"{output_dir.rstrip('/')}/{session}" if output_dir else None
        lines: list[str] = []

        def say(message: str) -> None:
            lines.append(f"{time.strftime('%Y-%m-%d %H:%M:%S')}\t{message}\n")
            if folder:
                write_text(self.corpus.sparkSession, f"{folder}/run.log", "".join(lines))

        return self._run(query.strip()[:QUERY_CHARS], session, folder, began, say)

    def _run(self, query: str, session: str, folder: str | None, began: float, say) -> Run:
        s, spark = self.settings, self.corpus.sparkSession
        texts = generate_documents(self.generator, query, s.n_synthetic, self.document_type)
        say(f"{len(texts)} examples generated")
        rows = [(f"syn-{i}", t) for i, t in enumerate(texts)]
        examples = self.embedder.embed(spark.createDataFrame(rows, "id string, text string"), "text").select(doubles("embedding").alias("embedding")).persist(StorageLevel.MEMORY_AND_DISK)
        known = self.corpus.where(F.col("id").isNotNull())
        dimension = examples.agg(F.max(F.size("embedding"))).first()[0]
        centre = centroids(examples.withColumn("one", F.lit(1)), ["one"], dimension=dimension).first()
        held = [r["embedding"] for r in examples.where(is_finite("embedding", dimension)).collect()]
        examples.unpersist()
        if centre is None or centre["centroid"] is None:
            raise ValueError("the examples have no direction in common")
        gap = F.round(distance("embedding", F.array(*[F.lit(x) for x in centre["centroid"]])), 12)  # so that equal distances tie
        cores = spark.sparkContext.defaultParallelism
        if known.rdd.getNumPartitions() < cores:  # a few small files are spread over all cores, as every iteration reads them
            known = known.repartition(cores)
        marked = known.withColumn("__fits", is_finite("embedding", dimension)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            corpus = marked.where("__fits").drop("__fits").withColumn("distance_to_centroid", gap)
            return self._loop(query, session, folder, began, say, corpus, marked, held)
        finally:
            marked.unpersist()

    def _loop(self, query, session, folder, began, say, corpus: DataFrame, marked: DataFrame, examples: list) -> Run:
        s, spark = self.settings, self.corpus.sparkSession
        labels: dict[str, bool] = {}
        vectors: dict[str, list[float]] = {}
        model: Classifier | None = None
        done = 0

        def label_frame() -> DataFrame:
            return F.broadcast(spark.createDataFrame(pa.table({"id": pa.array(list(labels), pa.string()), "gt": pa.array(list(labels.values()), pa.bool_())})))  # as many rows as were evaluated

        def open_rows(rows: DataFrame) -> DataFrame:
            return rows.join(label_frame(), "id", "left_anti") if labels else rows

        wanted = ("id", "text", doubles("embedding").alias("embedding"))
        batch = nearest(corpus, s.n_nearest, "distance_to_centroid").select(*wanted).collect()
        for iteration in range(1, s.n_iterations + 1):
            done = iteration
            new = [r for r in batch if r["id"] not in labels]  # the same rows again cost no second evaluation
            if new:
                verdicts = evaluate_documents(self.evaluator, query, [r["id"] for r in new], [r["text"] or "" for r in new])
                labels |= {r["id"]: bool(v) for r, v in zip(new, verdicts, strict=True)}
                vectors |= {r["id"]: r["embedding"] for r in new}
            yes = sum(labels[r["id"]] for r in batch)
            say(f"iteration {iteration}: {len(batch)} evaluated, {yes} yes, {len(batch) - yes} no")
            if all(labels.values()):  # examples are positive, so that only negatives can be missing
                count = max(1, s.n_synthetic + sum(labels.values()))
                far = furthest(open_rows(corpus), count, "distance_to_centroid").select(*wanted).collect()
                labels |= {r["id"]: False for r in far}
                vectors |= {r["id"]: r["embedding"] for r in far}
                say(f"iteration {iteration}: {len(far)} furthest rows taken as negatives")
            if all(labels.values()):
                say(f"iteration {iteration}: only one class, skipped")
                continue
            training = spark.createDataFrame(pa.table({"embedding": pa.array([vectors[i] for i in labels] + examples, pa.list_(pa.float64())), "gt": pa.array([*labels.values(), *[True] * len(examples)], pa.bool_())}))
            before, model = model, self.classifier().fit(training)
            if before is not None:  # both models on the same rows: no set is kept, and nothing is joined
                both = model.predict(before.predict(corpus.select("id", "embedding")).withColumnRenamed("prediction", "before"))
                rate = flip_rates(both, [], is_positive(F.col("before")), is_positive(F.col("prediction"))).first()["flip_rate"]
                say(f"iteration {iteration}: flip rate {rate:.4f}")
                if rate < s.settled:
                    break
            if iteration == s.n_iterations:
                break
            rest = open_rows(model.predict(corpus.select(*wanted)))
            batch = stratified_diverse(rest, s.n_per_iteration, seed=s.seed + iteration).orderBy("pick").select("id", "text", "embedding").collect()
            if not batch:
                say("nothing left to evaluate")
                break
        if model is None:
            found = corpus.withColumn("score", F.lit(None).cast("double")).limit(0)
        else:
            rows, chosen = model.predict(corpus), is_positive(F.col("prediction"))
            if s.trust_labels:
                rows = rows.join(label_frame(), "id", "left")
                chosen = F.coalesce("gt", chosen)
            found = rows.where(chosen).withColumnRenamed("prediction", "score")
        found = found.select(*self.corpus.columns, "score")
        if folder:
            found.orderBy(F.desc("score"), "id").write.parquet(f"{folder}/results.parquet")
            written = spark.read.schema(found.schema).parquet(f"{folder}/results.parquet")
            if isinstance(model, BalancedLogisticRegression):
                model.model.write().overwrite().save(f"{folder}/model")
        else:
            written = durable(found)
        results = written.orderBy(F.desc("score"), "id")  # files may be read in any order
        fits = {r["__fits"]: r["count"] for r in marked.groupBy("__fits").count().collect()}
        total, positive = fits.get(True, 0), written.count()
        # The keys and their order
        params = {
            "session_id": session, "index_name": self.index_name, "document_type": self.document_type, "query": query,
            "n_synthetic_documents": s.n_synthetic, "n_nearest_start": s.n_nearest, "n_iterations": s.n_iterations, "n_eval_per_iteration": s.n_per_iteration,
            "execution_times": {"total_seconds": time.time() - began},
            "statistics": {"total_items": total, "positive_items": positive, "negative_items": total - positive, "iterations_completed": done, "unusable_items": fits.get(False, 0)},
            "model_info": {"type": "LogisticRegression", "c_value": s.c}, "providers": {"generator": self.generator.describe(), "evaluator": self.evaluator.describe(), "embedder": self.embedder.describe()},
            "timestamp": time.strftime("%Y-%m-%dT%H:%M:%S"),
        }
        if folder:
            write_text(spark, f"{folder}/params.json", json.dumps(params, indent=2, ensure_ascii=False))
        return Run(results, folder, params, model is not None, labels)

    def classifier(self) -> Classifier:
        """A new classifier for each training; to be overridden for another kind."""
        return BalancedLogisticRegression(self.settings.c, tol=self.settings.tol)
