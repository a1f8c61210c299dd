"""What changed between two predictions, and what a run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flip_rates(rows: DataFrame, by: list[str], before: Column, after: Column) -> DataFrame:
    """``(*by, flipped, total, flip_rate)`` of two sets given as conditions on the same rows; 0 for two empty sets."""
    in_before, in_after = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return _rate(rows.groupBy(*by).agg(F.count_if(in_before != in_after).alias("flipped"), F.count_if(in_before | in_after).alias("total")), by)


def flip_rate_of_sets(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """``(flipped, total, flip_rate)`` of two sets given as frames of keys."""
    b = before.select(key).distinct().withColumn("b", F.lit(1))
    a = after.select(key).distinct().withColumn("a", F.lit(1))
    both = b.join(a, key, "full")
    return _rate(both.agg(F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("flipped"), F.count(F.lit(1)).alias("total")), [])


def _rate(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.select(*by, "flipped", "total", F.when(F.col("total") > 0, F.col("flipped") / F.col("total")).otherwise(0.0).alias("flip_rate"))


def run_statistics(rows: DataFrame, by: list[str], positive: Column, iteration_col: str = "iteration") -> DataFrame:
    """``(*by, total_items, positive_items, negative_items, iterations_completed)`` in one aggregation."""
    yes = F.count_if(F.coalesce(positive, F.lit(False)))
    total = F.count(F.lit(1))
    return rows.groupBy(*by).agg(total.alias("total_items"), yes.alias("positive_items"), (total - yes).alias("negative_items"), F.max(iteration_col).alias("iterations_completed"))
