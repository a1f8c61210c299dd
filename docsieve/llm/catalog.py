"""The queries of the operators in this package, over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm.copies import collapse_copies
from docsieve.llm.density import density_clusters, similar_groups
from docsieve.llm.leaks import leaks
from docsieve.llm.neardup import near_duplicates, record_pairs
from docsieve.llm.packing import packed_containers, token_counts
from docsieve.llm.spam import spam_pages, spam_share
from docsieve.llm.sql import SQL
from docsieve.llm.subset import varied_subset
from docsieve.llm.vectors import neighbour_pairs, neighbours
from docsieve.plans.durable import durable


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records that share at least 0.7 of their distinct words."""
    return record_pairs(*near_duplicates(table(spark, folder, "opensearch"), order_col="indexed_at"))


def p1_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records that share at least 0.7 of their words, repetitions counted."""
    return record_pairs(*near_duplicates(table(spark, folder, "opensearch"), order_col="indexed_at", multiset=True))


def p2_select(spark: SparkSession, folder: str) -> DataFrame:
    """As many varied rows of each session as it evaluates in an iteration."""
    found = varied_subset(table(spark, folder, "active_learner"), table(spark, folder, "sessions"))
    return found.select(F.col("grp").alias("session_id"), F.col("id").alias("frame_id"), "pick")


def p2_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many different rows were picked in each session, and the number of the last pick."""
    return p2_select(spark, folder).groupBy("session_id").agg(F.countDistinct("frame_id").alias("picked"), F.max("pick").alias("last_pick"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records of which at least one is among the ten most similar of the other."""
    return neighbour_pairs(neighbours(table(spark, folder, "opensearch"), order_col="indexed_at", k=10, least=0.7))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the largest sets of rows of a session all of whose pairs have similarity 0.85 or more."""
    found = similar_groups(table(spark, folder, "active_learner"), least=0.85)
    return found.where("id <> first_id").select(F.col("first_id").alias("first_frame_id"), F.col("id").alias("frame_id"))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Density clusters of each session with size, mean prediction and most typical rows."""
    found = density_clusters(table(spark, folder, "active_learner"))
    return found.select(F.col("grp").alias("session_id"), F.col("cluster").alias("first_frame_id"), "size", F.round("mean_value", 9).alias("mean_prediction"), F.col("exemplars").alias("typical_frame_ids"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies that differ in writing or field order only, each with the record kept for it."""
    _, members = collapse_copies(table(spark, folder, "opensearch"), order_col="indexed_at")
    return members.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    sizes = {r["size_id"]: r["capacity_tokens"] for r in table(spark, folder, "context_sizes").select("size_id", "capacity_tokens").collect()}
    return packed_containers(durable(token_counts(table(spark, folder, "documents"))), sizes)


def p6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each capacity, by tokens of a public tokenizer."""
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def p6_sound(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: the documents packed, and whether every container holds it, all but one are nine tenths full on average, every document is whole and only those above it are split."""
    found = durable(_packed(spark, folder))
    capacity = F.broadcast(table(spark, folder, "context_sizes").select("size_id", "capacity_tokens"))
    full = found.groupBy("size_id", "container").agg(F.sum("tokens").alias("load")).join(capacity, "size_id").groupBy("size_id").agg(F.bool_and(F.col("load") <= F.col("capacity_tokens")).alias("fits"), (F.sum("load") > 0.9 * (F.count(F.lit(1)) - 1) * F.max("capacity_tokens")).alias("full"))
    each = found.groupBy("size_id", "id").agg(F.count(F.lit(1)).alias("parts"), F.sum("tokens").alias("tokens"), F.max(F.col("token_from") + F.col("tokens")).alias("end")).join(capacity, "size_id")
    least = F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    whole = each.groupBy("size_id").agg(F.count(F.lit(1)).alias("documents"), F.bool_and((F.col("end") == F.col("tokens")) & (F.col("parts") == least)).alias("whole"))
    return whole.join(full, "size_id").select("size_id", "documents", "whole", "fits", "full")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), edits=1)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 12 consecutive words of an evaluation passage: of those with up to one edit, the ones that hold a run word for word."""
    return _leaks(spark, folder).where("whole").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p7_edited(spark: SparkSession, folder: str) -> DataFrame:
    """The same with one character of the twelve words inserted, deleted or replaced at most."""
    return _leaks(spark, folder).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "edits")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which more than half is keywords, links, menus or product tags."""
    return spam_pages(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"))


def p8_share(spark: SparkSession, folder: str) -> DataFrame:
    """By language found: documents, and those with any and with mostly spam."""
    share = spam_share(table(spark, folder, "documents"))
    return share.groupBy("language").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("share") > 0).alias("with_spam"), F.count_if(F.col("share") > 0.5).alias("mostly_spam"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
