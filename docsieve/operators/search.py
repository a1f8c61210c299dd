"""Vector search: each query's k best documents, fused over queries, with a type filter beside or before the search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.vector import is_usable
from docsieve.providers import Embedder
from docsieve.sources.index import as_list

#: Queries that are broadcast at once; more are searched for block by block.
QUERIES_AT_ONCE = 4_096
#: Decimals to which scores are compared, so that equal vectors tie in every engine.
DECIMALS = 9


def scores(q: np.ndarray, d: np.ndarray, score: str) -> np.ndarray:
    """Scores of documents (columns) for queries (rows)."""
    product = q @ d.T
    if score == "l2":
        gap = (q * q).sum(1)[:, None] + (d * d).sum(1)[None] - 2 * product
        return 1 / (1 + np.maximum(gap, 0))
    return (1 + product / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(d, axis=1)[None])) / 2


def best_of(score: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row of scores with their names, best first; ties go to the smaller name. Only what reaches the k-th is sorted."""
    n, width = score.shape
    k = min(k, width)
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1] if k else np.zeros(n)
    row, column = np.nonzero(score >= kth[:, None])
    s, i = score[row, column], name[row, column]
    _, place = np.unique(i, return_inverse=True)
    order = np.lexsort((place.ravel(), -s, row))
    starts = np.searchsorted(row, np.arange(n))
    pick = order[(starts[:, None] + np.arange(k)[None]).ravel()]
    return s[pick].reshape(n, k), i[pick].reshape(n, k)


def top_k(docs: DataFrame, queries: DataFrame, k: int, score: str = "l2", dimension: int = 64, id_col: str = "id", vector_col: str = "embedding", query_col: str = "query", query_vector_col: str = "vector") -> DataFrame:
    """``(query, id, score, rank)``: for every query the ``k`` documents with the largest score.

    Exact: a stated set of queries is held against all documents, in blocks of queries. Every partition keeps its own
    k best for each query, so that the shuffle carries queries * k * partitions narrow rows. Ties go to
    the smaller id. Unusable vectors take no part. ``score`` is ``l2`` = 1 / (1 + d²) or ``cosine`` = (1 + cos) / 2.
    """
    if score not in ("l2", "cosine"):
        raise ValueError(f"unknown score {score!r}")
    spark = docs.sparkSession
    kinds, query_kind = dict(docs.dtypes), dict(queries.dtypes)[query_col]
    source = docs.where(F.col(id_col).isNotNull() & is_usable(vector_col, dimension)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col(query_col).isNotNull() & is_usable(query_vector_col, dimension)).select(F.col(query_col).alias("query"), F.col(query_vector_col).cast("array<double>").alias("v"))
    number = asked.count()
    blocks = max(1, -(-number // QUERIES_AT_ONCE))
    schema = f"query {query_kind}, id {kinds[id_col]}, score double"
    parts = []
    for block in range(blocks):
        rows = (asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block) if blocks > 1 else asked).toArrow()
        if not rows.num_rows:
            continue
        names = rows.column("query").combine_chunks()
        shared = spark.sparkContext.broadcast((names, rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimension)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            held_score, held_id, kind = np.zeros((len(q), 0)), np.zeros((len(q), 0), object), None
            for batch in batches:
                if not batch.num_rows:
                    continue
                kind = batch.schema.field("id").type
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                order = np.argsort(ids, kind="stable")
                d = batch.column("v").flatten().to_numpy().reshape(-1, dimension)[order]
                new = np.round(scores(q, d, score), DECIMALS)
                if new.shape[1] > k:  # all that reach the k-th best, ties included
                    kth = -np.partition(-new, k - 1, axis=1)[:, k - 1 : k]
                    keep = (new >= kth).any(axis=0)
                    new, order = new[:, keep], order[keep]
                both = np.hstack([held_score, new])
                names_ = np.hstack([held_id, np.broadcast_to(ids[order].astype(object), new.shape)])
                held_score, held_id = best_of(both, names_, k)
            if kind is not None:
                n = held_score.shape[1]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(q)), n))), pa.array(held_id.ravel().tolist(), kind), pa.array(held_score.ravel())], names=["query", "id", "score"])

        parts.append(source.mapInArrow(best, schema))
    if not parts:
        parts = [spark.createDataFrame([], schema)]
    found = reduce(DataFrame.unionByName, parts).dropDuplicates(["query", "id"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, size: int = 10, types: list[str] | None = None, mode: str = "post_filter", type_col: str = "type", id_col: str = "id", **options) -> DataFrame:
    """``(id, score)``: the ``size`` documents with the best score over all queries, best first.

    A document found by several queries counts once, with its best score. With ``types`` and ``post_filter``, the k best are taken
    before the filter, and documents of these types that no query found fill up at score 0;
    ``pre_filter`` searches among the documents of these types only.
    """
    if mode not in ("post_filter", "pre_filter"):
        raise ValueError(f"unknown mode {mode!r}")
    right_type = docs.where(F.col(type_col).isin(types)) if types else docs
    searched = right_type if mode == "pre_filter" else docs
    fused = top_k(searched, queries, size, id_col=id_col, **options).groupBy("id").agg(F.max("score").alias("score"))
    if types and mode == "post_filter":
        ids = right_type.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
        fused = ids.join(fused, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(size)


def search_text(docs: DataFrame, texts: str | list[str] | DataFrame, embedder: Embedder, size: int = 10, types: str | list[str] | None = None, **options) -> DataFrame:
    """``search`` for one text, several texts, or the texts of a frame ``(query, text)``, which ``embedder`` turns into vectors.

    The vectors of the documents must be of the same embedder. Texts without a usable vector find nothing.
    """
    if not isinstance(texts, DataFrame):
        rows = list(enumerate(as_list(texts)))
        texts = docs.sparkSession.createDataFrame(rows, "query int, text string")
    queries = embedder.embed(texts.select("query", "text"), "text", "vector")
    return search(docs, queries, size, as_list(types), **options)
