"""Files that data and settings come from."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, quoted fields and line breaks inside of quotes."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_vectors(spark: SparkSession, path: str, first: int = 0, rows_at_once: int = 65_536) -> DataFrame:
    """``(row, embedding)`` of a dense array file with a vector a row; rows count from ``first``.

    The file is mapped, not loaded, and read in parts by as many tasks, so that it must be where all executors see it.
    """
    array = np.load(path, mmap_mode="r", allow_pickle=False)
    if array.ndim != 2:
        raise ValueError(f"expected a matrix, got {array.ndim} dimensions")
    n, width = array.shape

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = np.load(path, mmap_mode="r", allow_pickle=False)
        for batch in batches:
            for at in batch.column("id").to_pylist():
                part = np.ascontiguousarray(array[at : at + rows_at_once], dtype=np.float64)
                offsets = pa.array(np.arange(0, part.size + 1, width, dtype=np.int32) if width else np.zeros(len(part) + 1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first + at, first + at + len(part))), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], names=["row", "embedding"])

    parts = max(1, -(-n // rows_at_once))
    return spark.range(0, n, rows_at_once, parts).mapInArrow(load, "row long, embedding array<double>")


def write_vectors(df: DataFrame, path: str, order: str, vector_col: str = "embedding", dtype: str = "float32") -> tuple[int, int]:
    """The vectors of ``df``, in the order of ``order``, as a dense array file on the driver; its shape is returned.

    Partitions pass through the driver one after another. ``ValueError`` unless all vectors have the same length.
    """
    shape = df.agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.size(vector_col), F.lit(-1))).alias("low"), F.max(F.size(vector_col)).alias("high")).first()
    if shape["n"] and shape["low"] != shape["high"]:
        raise ValueError("vectors differ in length")
    out = np.lib.format.open_memmap(path, mode="w+", dtype=dtype, shape=(shape["n"], shape["high"] or 0))
    for i, row in enumerate(df.orderBy(order).select(vector_col).toLocalIterator()):
        out[i] = row[0]
    out.flush()
    return out.shape


def attach_vectors(df: DataFrame, vectors: DataFrame, key: str, vector_col: str = "embedding") -> DataFrame:
    """``df`` with the vector of each key. Raises ``ValueError`` unless every key has exactly one vector and every vector a row."""
    right = vectors.select(key, vector_col)
    keys = df.select(key, F.lit(1).alias("left"), F.lit(0).alias("right")).unionByName(right.select(key, F.lit(0).alias("left"), F.lit(1).alias("right")))
    per_key = keys.groupBy(key).agg(F.sum("left").alias("left"), F.sum("right").alias("right"))
    bad = per_key.where("left <> 1 or right <> 1").limit(1).count()
    if bad:
        raise ValueError("rows and vectors do not match one to one")
    return df.join(right, key)


def settings(path: str | os.PathLike | None = None) -> dict[str, str]:
    """``KEY=value`` lines of a settings file; the environment wins over the file."""
    found: dict[str, str] = {}
    if path and Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, mark, value = line.partition("=")
            if mark and name.strip() and not name.lstrip().startswith("#"):
                found[name.strip()] = value.strip().strip("'\"")
    return found | {k: os.environ[k] for k in found if k in os.environ}
