"""Distances to a centroid and the rows nearest to it or furthest from it, within groups of any number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsieve.functions.vector import distance, is_usable, normalised, vector_mean
from docsieve.plans.durable import durable

#: Centroids that are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Parts of a group that are ranked before the whole.
SALTS = 32


def centroids(rows: DataFrame, by: list[str], vector_col: str = "embedding", dimension: int = 128) -> DataFrame:
    """``(*by, centroid)``: the mean of the usable vectors of a group, at unit length (null if it is zero)."""
    return rows.where(is_usable(vector_col, dimension)).groupBy(*by).agg(vector_mean(vector_col).alias("__mean")).select(*by, normalised("__mean").alias("centroid"))


def with_distance(rows: DataFrame, centres: DataFrame, by: list[str], vector_col: str = "embedding", dimension: int = 128, name: str = "distance") -> DataFrame:
    """``rows`` with a usable vector and their Euclidean distance to the centroid of their group; the vectors are not normalised."""
    centres = durable(centres)
    centres = F.broadcast(centres) if centres.count() <= BROADCAST_GROUPS else centres
    return rows.where(is_usable(vector_col, dimension)).join(centres, by).withColumn(name, distance(vector_col, "centroid")).drop("centroid")


def first_rows(rows: DataFrame, by: list[str], order: list[Column], n: Column | int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``. ``order`` must be total.

    A number is pushed below the shuffle as a limit of each partition's groups. A column cannot be, so that groups are ranked in ``SALTS`` parts
    first, and only the first ``n`` of each part meet: a hot group is never sorted by one task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    if isinstance(n, int):
        return rows.withColumn("rank", rank).where(F.col("rank") <= n)
    salt = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(SALTS)).cast("int")
    place = F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))
    part = rows.withColumn("__salt", salt).withColumn("__place", place).where(F.col("__place") <= n).drop("__salt", "__place")
    return part.withColumn("rank", rank).where(F.col("rank") <= n)


def all_ranked(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Every row with its ``rank`` in its group. ``order`` must be total.

    Rows are sorted in ranges of group and order, which cut a hot group into several tasks; a row's rank is its place in its range and the
    number of rows that its group has in the ranges before.
    """
    ranged = durable(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "__range").count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    return ranged.withColumn("__place", place).join(sizes, [*by, "__range"]).withColumn("rank", F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def head(rows: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows."""
    return rows.orderBy(*order).limit(n)


def nearest(rows: DataFrame, n: int, distance_col: str = "distance", id_col: str = "id") -> DataFrame:
    """The ``n`` nearest rows; ties go to the smaller id; fewer rows than ``n`` give all."""
    return rows.orderBy(distance_col, id_col).limit(n)


def furthest(rows: DataFrame, n: int, distance_col: str = "distance", id_col: str = "id") -> DataFrame:
    """The ``n`` furthest rows; ties go to the smaller id."""
    return rows.orderBy(F.desc(distance_col), id_col).limit(n)
