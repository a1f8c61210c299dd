"""A document index: scans with pushed type filters and columns, counts, and pages by key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.plans.durable import durable

# Fixed value: the fields of an indexed document.
COLUMNS = ("id", "type", "name", "text", "embedding")


def as_list(value: str | list[str] | None) -> list[str]:
    """No value gives an empty list, a string a list of itself."""
    if not value:
        return []
    return [value] if isinstance(value, str) else list(value)


@dataclass(frozen=True)
class Index:
    """Documents in a table of files. Filters and columns reach the scan; nothing is read at construction."""

    spark: SparkSession
    path: str
    id_col: str = "id"
    type_col: str = "type"

    def frame(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        """Rows of the whole index, whatever their type; read from the files' footers."""
        return self.frame().count()

    def scan(self, types: str | list[str] | None = None, columns: tuple[str, ...] | None = COLUMNS) -> DataFrame:
        """Rows of any of ``types`` (all rows without), with ``columns`` only."""
        df = self.frame()
        wanted = as_list(types)
        if wanted:
            df = df.where(F.col(self.type_col).isin(wanted))
        return df.select(*columns) if columns else df

    def page(self, after: str | None, size: int, types: str | list[str] | None = None, columns: tuple[str, ...] | None = COLUMNS) -> DataFrame:
        """The ``size`` rows that follow the key ``after``, in the order of keys as strings."""
        df = self.scan(types, columns)
        key = F.col(self.id_col).cast("string")
        df = df.where(key.isNotNull() if after is None else key > after)
        return df.orderBy(key).limit(size)

    def pages(self, size: int = 10_000, types: str | list[str] | None = None) -> Iterator[DataFrame]:
        """Pages until one is short. For export to a consumer that takes rows page by page; queries use ``scan``."""
        after: str | None = None
        while True:
            page = self.page(after, size, types).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                got = page.agg(F.count(F.lit(1)).alias("n"), F.max(F.col(self.id_col).cast("string")).alias("last")).first()
                if not got["n"]:
                    return
                yield page
                if got["n"] < size:
                    return
                after = got["last"]
            finally:
                page.unpersist()

    @contextmanager
    def snapshot(self, types: str | list[str] | None = None, columns: tuple[str, ...] | None = COLUMNS) -> Iterator[DataFrame]:
        """One view of the index for several jobs, released at the end in any case."""
        df = self.scan(types, columns).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield df
        finally:
            df.unpersist()


#: Repeated keys up to which they are broadcast.
BROADCAST_KEYS = 100_000


def newest(df: DataFrame, key: list[str], order: str, wide: bool | None = None) -> DataFrame:
    """One row for each key: the one with the largest ``order``, and among equals the largest row. Rows with a null key are dropped.

    Of ``wide`` rows (without it: rows with an array), only those whose key is repeated are shuffled: the keys are counted first, from their
    own columns alone, and rows of a key of its own stay where they are. With more repeated keys than may be broadcast all rows are.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.max(F.struct(F.col(order).alias("__order"), *rest)).alias("__row")
    rows = df.where(" and ".join(f"`{k}` is not null" for k in key))

    def collapsed(part: DataFrame) -> DataFrame:
        return part.groupBy(*key).agg(best).select(*[F.col(c) if c in key else F.col(f"__row.{c}").alias(c) for c in df.columns])

    if not (any(kind.startswith("array") for _, kind in df.dtypes) if wide is None else wide):
        return collapsed(rows)
    repeated = durable(rows.groupBy(*key).count().where("count > 1").select(*key))
    number = repeated.count()
    if number > BROADCAST_KEYS:
        return collapsed(rows)
    repeated = F.broadcast(repeated)
    return rows.join(repeated, key, "left_anti").unionByName(collapsed(rows.join(repeated, key, "left_semi"))) if number else rows
