"""Datasets: a table with its vectors in one place, and a note of how they were made."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.plans.durable import write_text
from docsieve.providers import Embedder
from docsieve.sources.files import attach_vectors

TABLE, NOTE = "data.parquet", "metadata.json"


class DatasetBuilder:
    """Writes datasets with the vectors of one embedder and reads them back."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder

    def build(self, df: DataFrame, text_col: str, path: str, vector_col: str = "embedding") -> str:
        """Embeds ``text_col`` where the data is and writes table and note to ``path``, which it returns."""
        if text_col not in df.columns:
            raise ValueError(f"no column {text_col!r}")
        return self._write(self.embedder.embed(df, text_col, vector_col), df.columns, text_col, path, vector_col, False)

    def build_from_vectors(self, df: DataFrame, vectors: DataFrame, key: str, text_col: str, path: str, vector_col: str = "embedding") -> str:
        """The same with vectors made before; rows and vectors must match one to one."""
        return self._write(attach_vectors(df, vectors, key, vector_col), df.columns, text_col, path, vector_col, True)

    def _write(self, df: DataFrame, columns: list[str], text_col: str, path: str, vector_col: str, shape: bool) -> str:
        df.write.mode("overwrite").parquet(f"{path}/{TABLE}")
        written = df.sparkSession.read.parquet(f"{path}/{TABLE}")
        got = written.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector_col)).alias("d")).first()
        note = {  # Fixed values: the keys of the note
            "embedding_service": self.embedder.describe(),
            "dataframe_info": {"shape": [got["n"], len(columns)], "columns": columns, "text_column": text_col},
            **({"embeddings_shape": [got["n"], got["d"]]} if shape else {}),
            "created_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S"),
        }
        write_text(df.sparkSession, f"{path}/{NOTE}", json.dumps(note, indent=2, ensure_ascii=False))
        return path

    def read(self, spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
        """Table and note; ``ValueError`` if the vectors are of another model than this builder's."""
        note = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{NOTE}", wholetext=True).collect()))
        made, own = note["embedding_service"], self.embedder.describe()
        if made != own:
            raise ValueError(f"the dataset has vectors of {made}, not of {own}")
        return spark.read.parquet(f"{path}/{TABLE}"), note
