"""A search index behind HTTP: a snapshot of it, read page by page in slices by as many tasks."""

from __future__ import annotations

import base64
import json
import ssl
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docsieve.sources.index import COLUMNS, as_list

#: Documents of one request.
PAGE = 10_000


@dataclass(frozen=True)
class HttpIndex:
    """An index that speaks the usual point-in-time and search-after protocol. Nothing is connected before the first call."""

    url: str
    index: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    verify: bool = True
    timeout: float = 120.0
    keep_alive: str = "5m"

    def call(self, method: str, path: str, body: dict | None = None) -> dict:
        head = {"Content-Type": "application/json"}
        if self.user is not None:
            head["Authorization"] = "Basic " + base64.b64encode(f"{self.user}:{self.password or ''}".encode()).decode()
        context = None
        if self.url.startswith("https"):
            context = ssl.create_default_context()
            if not self.verify:
                context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", json.dumps(body).encode() if body is not None else None, head, method=method)
        with urllib.request.urlopen(request, timeout=self.timeout, context=context) as reply:
            return json.load(reply)

    def count(self) -> int:
        """Documents of the whole index, whatever their type."""
        return self.call("GET", f"{self.index}/_count")["count"]

    def pages(self, pit: str, types: list[str], columns: tuple[str, ...], slice_: int = 0, slices: int = 1, size: int = PAGE) -> Iterator[list[dict]]:
        """The documents of one slice of a snapshot, page by page in the order of ids; ends with a short page."""
        after = None
        while True:
            body: dict = {"size": size, "_source": {"includes": list(columns)}, "sort": [{"_id": "asc"}], "pit": {"id": pit, "keep_alive": self.keep_alive}, "query": {"terms": {"type": types}} if types else {"match_all": {}}}
            if slices > 1:
                body["slice"] = {"id": slice_, "max": slices}
            if after is not None:
                body["search_after"] = after
            reply = self.call("POST", "_search", body)
            hits, pit = reply["hits"]["hits"], reply.get("pit_id", pit)
            if hits:
                yield [h["_source"] for h in hits]
                after = hits[-1]["sort"]
            if len(hits) < size:
                return

    def scan(self, spark: SparkSession, to: str, types: str | list[str] | None = None, columns: tuple[str, ...] = COLUMNS, slices: int = 8, size: int = PAGE) -> DataFrame:
        """The documents of any of ``types``, written to ``to`` and read from there; the snapshot is closed in any case.

        Each slice is read by one task, page by page; only a page is held at once. Fields a document lacks are null.
        """
        wanted = as_list(types)
        kinds = {c: pa.list_(pa.float32()) if c == "embedding" else pa.string() for c in columns}
        pit = self.call("POST", f"{self.index}/_search/point_in_time?keep_alive={self.keep_alive}")["pit_id"]

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in batch.column("id").to_pylist():
                    for page in self.pages(pit, wanted, columns, s, slices, size):
                        yield pa.RecordBatch.from_arrays([pa.array([d.get(c) for d in page], kinds[c]) for c in columns], names=list(columns))

        schema = ", ".join(f"`{c}` {'array<float>' if c == 'embedding' else 'string'}" for c in columns)
        try:
            spark.range(0, slices, 1, slices).mapInArrow(fetch, schema).write.mode("overwrite").parquet(to)
        finally:
            self.call("DELETE", "_search/point_in_time", {"pit_id": [pit]})
        return spark.read.schema(schema).parquet(to)
