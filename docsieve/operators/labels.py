"""Labels: merging verdicts, what is labelled and what is not, and the counts a loop reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import digit_verdicts
from docsieve.sources.index import newest


def verdict_rows(replies: DataFrame, reply_col: str = "raw_reply", ids_col: str = "record_ids", key: tuple[str, ...] = ("session_id",), order_col: str = "replied_at") -> DataFrame:
    """``(*key, id, verdict, order)``: a row for each verdict of the readable replies; unreadable and short replies give none."""
    read = replies.withColumn("__v", digit_verdicts(reply_col, F.size(ids_col))).where("__v is not null")
    pairs = F.explode(F.arrays_zip(F.col(ids_col).alias("id"), F.col("__v").alias("verdict"))).alias("p")
    return read.select(*key, order_col, pairs).select(*key, F.col("p.id").alias("id"), F.col("p.verdict").alias("verdict"), F.col(order_col).alias("order"))


def latest_labels(replies: DataFrame, key: tuple[str, ...] = ("session_id",), **columns) -> DataFrame:
    """``(*key, id, verdict)``: the newest verdict of each record; of verdicts at the same time the positive one."""
    rows = verdict_rows(replies, key=key, **columns)
    return newest(rows.select(*key, "id", "order", "verdict"), [*key, "id"], "order").drop("order")


def merge_labels(rows: DataFrame, labels: DataFrame, on: list[str], label_col: str = "gt", new_col: str = "verdict") -> DataFrame:
    """``rows`` with the labels of ``labels`` written over their own; rows without a new label keep theirs."""
    found = rows.join(labels.select(*on, F.col(new_col).alias("__new")), on, "left")
    return found.withColumn(label_col, F.coalesce("__new", label_col)).drop("__new")


def unlabelled(rows: DataFrame, labels: DataFrame, on: list[str], synthetic_col: str = "is_synthetic") -> DataFrame:
    """Rows of the corpus without a label."""
    return rows.where(~F.col(synthetic_col)).join(labels.where("verdict is not null").select(*on), on, "left_anti")


def labelled(rows: DataFrame, label_col: str = "gt") -> DataFrame:
    return rows.where(F.col(label_col).isNotNull())


def yes_no(rows: DataFrame, by: list[str], label_col: str = "verdict") -> DataFrame:
    """``(*by, yes, no)``: positive and negative labels; nulls count in neither."""
    return rows.groupBy(*by).agg(F.count_if(F.col(label_col)).alias("yes"), F.count_if(~F.col(label_col)).alias("no"))


def histogram(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """``(*by, column, rows)`` without nulls."""
    return rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("rows"))


def class_weights(rows: DataFrame, by: list[str], label_col: str = "gt") -> DataFrame:
    """``(*by, label, rows, weight)``: balanced weights n / (2 * n of the class) over labelled rows."""
    counts = histogram(rows, by, label_col)
    totals = counts.groupBy(*by).agg(F.sum("rows").alias("__total")) if by else counts.agg(F.sum("rows").alias("__total"))
    joined = counts.join(totals, by) if by else counts.join(F.broadcast(totals))
    return joined.select(*by, label_col, "rows", (F.col("__total") / (2 * F.col("rows"))).alias("weight"))


def negatives_wanted(label: Column) -> Column:
    """How many far rows are labelled negative when only one class is there: as many as there are positives, at least one."""
    return F.greatest(F.lit(1), F.count_if(label))
