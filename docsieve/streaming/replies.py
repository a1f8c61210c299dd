"""Evaluator replies as a stream: each reply once, verdicts of the readable ones, for a label table to be kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docsieve.operators.labels import verdict_rows


def reply_stream(spark: SparkSession, folder: str, schema, files_at_once: int = 100) -> DataFrame:
    """Files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def verdict_stream(replies: DataFrame, late: str = "1 day", key: str = "eval_id", order_col: str = "replied_at") -> DataFrame:
    """``(session_id, iteration, id, verdict, order)`` of replies that arrive at most ``late`` behind the newest; repetitions of a reply within that time count once."""
    timed = replies.withColumn(order_col, replies[order_col].cast("timestamp")).withWatermark(order_col, late)
    return verdict_rows(timed.dropDuplicatesWithinWatermark([key]), key=("session_id", "iteration"), order_col=order_col)


def keep_labels(verdicts: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``merge(batch, number)`` on every micro-batch; ``trigger`` as for ``DataStreamWriter.trigger``."""
    return verdicts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
