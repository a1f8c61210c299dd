"""The queries of the core operators, over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.catalog_sql import FRENCH, SECOND_WEIGHTS, SQL, WEIGHTS
from docsieve.functions import text as T
from docsieve.functions import vector as V
from docsieve.operators import labels as L
from docsieve.operators import metrics, ranking, sampling
from docsieve.operators.classifier import BalancedLogisticRegression, confidence, is_positive
from docsieve.operators.search import search, search_text, top_k
from docsieve.plans.dataset import DatasetBuilder
from docsieve.plans.durable import scratch_path
from docsieve.plans.session import ActiveLearner, Settings
from docsieve.providers import ExampleGenerator, HashEmbedder, RuleEvaluator
from docsieve.sources.files import attach_vectors
from docsieve.sources.index import Index, newest

NARROW = ("frame_id", "session_id", "iteration", "id", "is_synthetic", "gt", "prediction", "prediction_binary", "scored_at")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def index(spark: SparkSession, folder: str) -> Index:
    return Index(spark, f"{folder}/opensearch.parquet")


def frames(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """The newest version of every working row, with the narrow columns and ``more``."""
    return newest(table(spark, folder, "active_learner").select(*NARROW, *more), ["frame_id"], "scored_at")


def sessions(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "sessions").select("session_id", *columns)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    return newest(table(spark, folder, "evaluations"), ["eval_id"], "replied_at", wide=False)


# --- sources -------------------------------------------------------------------------------------------------------


def scan_terms_filter(spark, folder):
    return index(spark, folder).scan(["publication", "patent"], ("id", "type", "name"))


def scan_match_all(spark, folder):
    return index(spark, folder).scan(None, ("id", "type", "text")).select("id", "type", F.length("text").alias("n_chars"))


def index_count(spark, folder):
    return index(spark, folder).frame().agg(F.count(F.lit(1)).alias("documents"))


def scan_keyset_page(spark, folder):
    return index(spark, folder).page("gra-", 500, ["grant", "publication"], ("id", "type"))


def newest_documents(spark, folder):
    docs = table(spark, folder, "opensearch").select("id", "type", "name", "lab_id", "updated_at", "indexed_at")
    return newest(docs, ["id"], "indexed_at").select("id", "type", "name", "lab_id", "updated_at")


def session_parameters(spark, folder):
    s = table(spark, folder, "sessions")
    return s.select("session_id", T.normalised_query("query").alias("query"), T.either_timestamp("timestamp_text").cast("timestamp_ntz").alias("finished_at"), F.col("execution_times.total_seconds").alias("total_seconds"), F.col("model_info.c_value").alias("c_value"))


# --- labels --------------------------------------------------------------------------------------------------------


def parse_digit_reply(spark, folder):
    return replies(spark, folder).select("eval_id", T.digit_verdicts("raw_reply", F.size("record_ids")).alias("v")).select("eval_id", F.col("v").isNotNull().alias("readable"), F.size(F.filter("v", lambda x: x)).alias("n"), F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), "").alias("digits")).select("eval_id", "readable", F.when(F.col("readable"), F.col("n")).alias("yes"), "digits")


def json_verdict_lists(spark, folder):
    """Verdicts written as JSON lists and read back, where there is one for each record."""
    rows = replies(spark, folder)
    return rows.select("eval_id", T.json_verdicts(F.to_json("verdicts"), F.size("record_ids")).alias("v")).select("eval_id", F.col("v").isNotNull().alias("readable"), F.when(F.col("v").isNotNull(), F.size(F.filter("v", lambda x: x))).alias("yes"))


def parse_title_lines(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.title_lines("text", 3).alias("lines")).select("doc_id", F.when(F.col("lines").isNotNull(), F.size("lines")).alias("lines"), F.element_at("lines", 1).alias("first_line"))


def batch_yes_no(spark, folder):
    return L.yes_no(L.verdict_rows(replies(spark, folder), key=("session_id", "iteration")), ["session_id", "iteration"])


def label_merge(spark, folder):
    rows = frames(spark, folder).select("frame_id", "session_id", "id", "gt")
    return L.merge_labels(rows, L.latest_labels(replies(spark, folder)), ["session_id", "id"]).select("frame_id", "gt")


def unlabeled_antijoin(spark, folder):
    return L.unlabelled(frames(spark, folder), L.latest_labels(replies(spark, folder)), ["session_id", "id"]).select("frame_id", "session_id", "id")


def labeled_only(spark, folder):
    return L.labelled(frames(spark, folder)).select("frame_id", "session_id", "gt")


def label_histogram(spark, folder):
    return L.histogram(frames(spark, folder), ["session_id"], "gt")


def prediction_histogram(spark, folder):
    return L.histogram(frames(spark, folder).where("not is_synthetic"), ["session_id"], "prediction_binary")


def distinct_classes(spark, folder):
    rows = L.labelled(frames(spark, folder)).groupBy("session_id").agg(F.countDistinct("gt").alias("classes"), L.negatives_wanted(F.col("gt")).alias("negatives_wanted"))
    return rows.withColumn("one_class", F.col("classes") < 2)


def class_weights(spark, folder):
    return L.class_weights(frames(spark, folder), ["session_id"]).select("session_id", "gt", "rows", F.round("weight", 9).alias("weight"))


# --- vectors -------------------------------------------------------------------------------------------------------


def vector_norm(spark, folder):
    docs = table(spark, folder, "opensearch").where(V.is_usable("embedding", 128)).select("id", "embedding")
    return docs.select("id", F.round(V.norm("embedding"), 6).alias("norm")).distinct()


def _vectors(spark, folder):
    rows = table(spark, folder, "active_learner").select("frame_id", "session_id", "id", "is_synthetic", "gt", "embedding", "scored_at")
    return newest(rows, ["frame_id"], "scored_at")


def _centres(rows):
    return ranking.centroids(rows.where("is_synthetic"), ["session_id"])


def _distances(spark, folder):
    rows = _vectors(spark, folder)
    own = rows.where("not is_synthetic").select("frame_id", "session_id", "gt", "embedding")
    return ranking.with_distance(own, _centres(rows), ["session_id"]).drop("embedding").withColumn("distance", F.round("distance", 9))


def centroid(spark, folder):
    return _centres(_vectors(spark, folder)).select("session_id", F.posexplode("centroid").alias("pos", "value")).select("session_id", "pos", F.round("value", 6).alias("value"))


def distance_to_centroid(spark, folder):
    return _distances(spark, folder).select("frame_id", F.round("distance", 6).alias("distance"))


def nearest_start(spark, folder):
    rows = _distances(spark, folder).join(sessions(spark, folder, "n_nearest_start").distinct(), "session_id")
    found = ranking.first_rows(rows, ["session_id"], [F.col("distance"), F.col("frame_id")], F.col("n_nearest_start"))
    return found.select("session_id", "frame_id", "rank", F.round("distance", 6).alias("distance"))


def farthest_negatives(spark, folder):
    wanted = frames(spark, folder).groupBy("session_id").agg(L.negatives_wanted(F.col("gt")).alias("wanted"))
    rows = _distances(spark, folder).where("gt is null").join(wanted, "session_id")
    return ranking.first_rows(rows, ["session_id"], [F.desc("distance"), F.col("frame_id")], F.col("wanted")).select("session_id", "frame_id", "rank")


def union_synthetic(spark, folder):
    rows = table(spark, folder, "active_learner").select("frame_id", "session_id", "id", "text", "is_synthetic", "scored_at")
    rows = newest(rows, ["frame_id"], "scored_at")
    made = rows.where("is_synthetic").select("session_id", "id", "text", F.lit(True).alias("is_synthetic"), F.lit(True).alias("gt"))
    found = rows.where("not is_synthetic").select("session_id", "id", F.lit(False).alias("is_synthetic"), F.lit(None).cast("boolean").alias("gt"))
    return made.unionByName(found, allowMissingColumns=True).select("session_id", "id", F.length("text").alias("n_chars"), "is_synthetic", "gt")


def attach_embeddings_checked(spark, folder):
    docs = newest(table(spark, folder, "opensearch").select("id", "type", "embedding", "indexed_at"), ["id"], "indexed_at")
    return attach_vectors(docs.select("id", "type"), docs.select("id", "embedding"), "id").select("id", "type", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))


def linear_score(spark, folder):
    docs = table(spark, folder, "embeddings").select("vec_id", V.linear_score("embedding", WEIGHTS).alias("p"))
    return docs.select("vec_id", F.round("p", 6).alias("prediction"), is_positive(F.col("p")).alias("prediction_binary"), F.round(confidence(F.col("p")), 6).alias("confidence"))


def threshold_confidence(spark, folder):
    p = F.col("prediction")
    return frames(spark, folder).where(p.isNotNull() & ~F.isnan(p)).select("frame_id", is_positive(p).alias("positive"), F.round(confidence(p), 9).alias("confidence"))


# --- choosing rows -------------------------------------------------------------------------------------------------


def zones(spark, folder):
    return frames(spark, folder).where("not is_synthetic").select("session_id", sampling.zone_of("prediction").alias("zone")).groupBy("session_id", "zone").agg(F.count(F.lit(1)).alias("rows"))


def zone_budget_pick(spark, folder):
    rows = frames(spark, folder).where("not is_synthetic and gt is null").join(sessions(spark, folder, "n_eval_per_iteration").distinct(), "session_id")
    return sampling.zone_picks(rows, ["session_id"], F.col("n_eval_per_iteration"), id_col="frame_id").select("session_id", "frame_id", "zone", "pick")


def _seeds(spark, folder):
    return [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in table(spark, folder, "embeddings").orderBy("vec_id").limit(8).collect()]


def kmeans_assign(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", sampling.nearest_seed("embedding", _seeds(spark, folder)).alias("cluster"))


def kmeans_update(spark, folder):
    rows = table(spark, folder, "embeddings").select("embedding", sampling.nearest_seed("embedding", _seeds(spark, folder)).alias("cluster"))
    means = rows.groupBy("cluster").agg(V.vector_mean("embedding").alias("mean"), F.count(F.lit(1)).alias("size"))
    return means.select("cluster", "size", F.posexplode("mean").alias("pos", "value")).select("cluster", "size", "pos", F.round("value", 6).alias("value"))


def cluster_representative(spark, folder):
    return sampling.representatives(table(spark, folder, "embeddings").select("vec_id", "label"), ["label"], "vec_id")


def flip_rate(spark, folder):
    rows = table(spark, folder, "embeddings").select(V.linear_score("embedding", WEIGHTS).alias("p"), V.linear_score("embedding", SECOND_WEIGHTS).alias("q"))
    rates = metrics.flip_rates(rows.withColumn("one", F.lit(1)), ["one"], is_positive(F.col("p")), is_positive(F.col("q")))
    return rates.select("flipped", "total", F.round("flip_rate", 9).alias("flip_rate"))


def session_flip_rate(spark, folder):
    rates = metrics.flip_rates(frames(spark, folder).where("not is_synthetic"), ["session_id"], F.col("gt"), is_positive(F.col("prediction")))
    return rates.select("session_id", "flipped", "total", F.round("flip_rate", 9).alias("flip_rate"))


# --- search --------------------------------------------------------------------------------------------------------


def _queries(spark, folder):
    """Every vector whose id is divisible by 20, held against all."""
    return table(spark, folder, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def search_each(spark, folder):
    found = top_k(table(spark, folder, "embeddings"), _queries(spark, folder), 10, id_col="vec_id")
    return found.select("query", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def search_single(spark, folder):
    one = table(spark, folder, "embeddings").agg(V.vector_mean("embedding").alias("vector")).select(F.lit(0).alias("query"), "vector")
    return search(table(spark, folder, "embeddings"), one, 10, id_col="vec_id", score="cosine").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def search_fused(spark, folder):
    return search(table(spark, folder, "embeddings"), _queries(spark, folder), 150, id_col="vec_id").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def search_filtered_padded(spark, folder):
    return search(table(spark, folder, "embeddings"), _queries(spark, folder), 10, [3], type_col="label", id_col="vec_id").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def search_prefiltered(spark, folder):
    return search(table(spark, folder, "embeddings"), _queries(spark, folder), 10, [3, 4], mode="pre_filter", type_col="label", id_col="vec_id").select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def search_by_text(spark, folder):
    """The texts of every document whose id is divisible by 20, as queries against all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    texts = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")
    found = search_text(HashEmbedder().embed(docs, "text"), texts, HashEmbedder(), 200, id_col="doc_id")
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


# --- texts ---------------------------------------------------------------------------------------------------------


def hash_embed(spark, folder):
    docs = HashEmbedder().embed(table(spark, folder, "documents").select("doc_id", "text"), "text")
    return docs.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").select("doc_id", "bucket", F.round("value", 6).alias("value"))


def format_documents(spark, folder):
    docs = newest(table(spark, folder, "opensearch").select("id", "name", "text", "indexed_at"), ["id"], "indexed_at")
    whole = T.document_text("name", "text")
    return docs.select("id", F.md5(whole).alias("digest"), F.length(whole).alias("n_chars"))


def number_texts(spark, folder):
    texts = table(spark, folder, "eval_items").groupBy("suite", "lang").agg(F.array_sort(F.collect_list(F.struct("item_id", "text"))).alias("items"))
    return texts.select("suite", "lang", F.md5(T.numbered(F.transform("items", lambda x: x["text"]))).alias("digest"))


def normalize_query(spark, folder):
    docs = table(spark, folder, "documents")
    query = T.normalised_query("text")
    return docs.select("doc_id", F.length(query).alias("n_chars"), F.md5(query).alias("digest"))


def preview(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.preview("text").alias("preview"))


def fill_prompt(spark, folder):
    return table(spark, folder, "sessions").select("session_id", T.filled(F.lit("Is each text about {topic}? {\"reply\": [0, 1]}"), T.normalised_query("query")).alias("prompt"))


# --- results -------------------------------------------------------------------------------------------------------


def _results(spark, folder):
    return table(spark, folder, "results").groupBy("session_id", "id").agg(F.max("score").alias("score"))


def results_sorted(spark, folder):
    found = ranking.all_ranked(_results(spark, folder), ["session_id"], [F.desc("score"), F.col("id")])
    return found.select("session_id", "id", F.round("score", 9).alias("score"), "rank")


def results_head(spark, folder):
    found = ranking.head(_results(spark, folder), [F.desc("score"), F.col("session_id"), F.col("id")])
    return found.select("session_id", "id", F.round("score", 9).alias("score"))


def flip_rate_sets(spark, folder):
    """The positives by label and those by prediction, as two sets of rows."""
    rows = frames(spark, folder).where("not is_synthetic")
    rates = metrics.flip_rate_of_sets(rows.where("gt").select(F.col("frame_id").alias("id")), rows.where(is_positive(F.col("prediction"))).select(F.col("frame_id").alias("id")))
    return rates.select("flipped", "total", F.round("flip_rate", 9).alias("flip_rate"))


def run_statistics(spark, folder):
    return metrics.run_statistics(frames(spark, folder).where("not is_synthetic"), ["session_id"], is_positive(F.col("prediction")))


def result_documents(spark, folder):
    found = table(spark, folder, "results").groupBy("session_id", "id").agg(F.max("score").alias("score"))
    docs = newest(table(spark, folder, "opensearch").select("id", "type", "name", "indexed_at"), ["id"], "indexed_at")
    return found.join(docs, "id").select("session_id", "id", "type", "name", F.round("score", 9).alias("score"))


# --- learning ------------------------------------------------------------------------------------------------------


def _labelled_vectors(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", "embedding", (F.col("label") < 5).alias("gt"))


def lr_fit_predict(spark, folder):
    """A classifier for ``label < 5`` on all vectors, and its predictions."""
    rows = _labelled_vectors(spark, folder)
    return BalancedLogisticRegression().fit(rows).predict(rows).select("vec_id", "prediction")


def lr_gradient(spark, folder):
    """The gradient of the penalised balanced loss at the classifier found: zero everywhere, as there is one optimum."""
    rows = _labelled_vectors(spark, folder)
    fitted = BalancedLogisticRegression().fit(rows)
    weights = L.class_weights(rows, []).select("gt", "weight")
    off = fitted.predict(rows).join(F.broadcast(weights), "gt").select(((F.col("prediction") - F.col("gt").cast("double")) * F.col("weight")).alias("e"), V.doubles("embedding").alias("v"))
    slopes = off.select("e", F.posexplode(F.concat("v", F.array(F.lit(1.0)))).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("e") * F.col("x")).alias("slope"))
    penalty = F.array(*[F.lit(float(w)) for w in [*fitted.model.coefficients, 0.0]])
    return slopes.select("pos", F.abs(F.round(F.col("slope") + F.element_at(penalty, F.col("pos") + 1), 6)).alias("gradient"))


def select_stratified_diverse(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", V.linear_score("embedding", WEIGHTS).alias("prediction"))
    return sampling.stratified_diverse(rows, 20).select("id", "zone", "pick")


def select_within_zones(spark, folder):
    """For each zone: whether its picks are different rows of the zone and keep its budget."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", V.linear_score("embedding", WEIGHTS).alias("prediction"))
    found = sampling.stratified_diverse(rows, 20)
    return found.groupBy("zone").agg((F.countDistinct("id") == F.count(F.lit(1))).alias("different"), F.bool_and(sampling.zone_of("prediction") == F.col("zone")).alias("in_zone"), (F.count(F.lit(1)) <= F.max(sampling.budget_of(F.col("zone"), F.lit(20)))).alias("in_budget"))


def _learner(spark, folder, n_iterations=15):
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("type"), "text")
    embedder = HashEmbedder()
    none = F.array_repeat(F.lit(0.0), embedder.buckets)  # texts without tokens
    corpus = embedder.embed(docs, "text").withColumn("embedding", F.coalesce("embedding", none))
    examples = [r["text"] for r in docs.where("type = 'fr' and length(text) > 40").orderBy(F.col("id").cast("long")).limit(10).collect()]
    rule = RuleEvaluator(lambda _, text: sum(text.lower().split().count(w) for w in FRENCH) > 1)
    return ActiveLearner(corpus, ExampleGenerator(tuple(examples)), rule, embedder, Settings(n_iterations=n_iterations), "documents", "fr")


def active_learning_loop(spark, folder):
    """Every French document, found from ten examples."""
    return _learner(spark, folder).classify("documents in French").results.select("id", "type", F.round("score", 6).alias("score"))


def loop_first_labels(spark, folder):
    """The labels of the first iteration: the nearest documents by the rule and, where all are positive, the furthest as negatives."""
    run = _learner(spark, folder, 1).classify("documents in French")
    return spark.createDataFrame(list(run.labels.items()), "id string, gt boolean")


def loop_invariants(spark, folder):
    """What holds for every run: all rows are scored or counted as unusable, results are the rows above the threshold, best first."""
    run = _learner(spark, folder).classify("documents in French")
    told = run.params["statistics"]
    scores = [r["score"] for r in run.results.select("score").toLocalIterator()]
    row = (told["total_items"], told["unusable_items"], len(scores) == told["positive_items"] == told["total_items"] - told["negative_items"], all(x > 0.5 for x in scores), scores == sorted(scores, reverse=True))
    return spark.createDataFrame([row], "total_items long, unusable_items long, counts_agree boolean, all_above boolean, in_order boolean")


def dataset_round_trip(spark, folder):
    """The documents with vectors, written as a dataset and read back."""
    builder = DatasetBuilder(HashEmbedder())
    docs = table(spark, folder, "documents").select("doc_id", "text")
    read, _ = builder.read(spark, builder.build(docs, "text", scratch_path(spark)))
    return read.select("doc_id", F.length("text").alias("n_chars"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dimension"))


QUERIES = [
    scan_terms_filter, scan_match_all, index_count, scan_keyset_page, newest_documents, session_parameters,
    parse_digit_reply, json_verdict_lists, parse_title_lines, batch_yes_no, label_merge, unlabeled_antijoin, labeled_only, label_histogram, prediction_histogram, distinct_classes, class_weights,
    vector_norm, centroid, distance_to_centroid, nearest_start, farthest_negatives, union_synthetic, attach_embeddings_checked, linear_score, threshold_confidence,
    zones, zone_budget_pick, kmeans_assign, kmeans_update, cluster_representative, flip_rate, session_flip_rate,
    search_each, search_single, search_fused, search_filtered_padded, search_prefiltered, search_by_text,
    hash_embed, format_documents, number_texts, normalize_query, preview, fill_prompt,
    results_sorted, results_head, run_statistics, result_documents, flip_rate_sets,
    lr_fit_predict, lr_gradient, select_stratified_diverse, select_within_zones, active_learning_loop, loop_first_labels, loop_invariants, dataset_round_trip,
]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The learning loop, start to end."""
    return active_learning_loop(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
