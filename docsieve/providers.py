"""External models behind small interfaces: embedding, generating examples, evaluating texts.

The offline providers are deterministic and need no network. The HTTP ones speak the usual chat and
embedding endpoints, open no connection before the first call, and verify certificates.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts of one embedding request, and attempts at a labelling reply.
REQUEST_TEXTS = 256
ATTEMPTS = 5


class Embedder(Protocol):
    def describe(self) -> dict[str, str]: ...

    def embed(self, df: DataFrame, text_col: str, vector_col: str = "embedding") -> DataFrame:
        """``df`` with the vector of each text."""


class Generator(Protocol):
    def describe(self) -> dict[str, str]: ...

    def generate(self, topic: str, n: int, document_type: str | None = None) -> list[str] | None:
        """Exactly ``n`` texts about a topic; a tolerant generator may give one fewer, or none at all."""


class Evaluator(Protocol):
    def describe(self) -> dict[str, str]: ...

    def evaluate(self, topic: str, ids: list[str], texts: list[str]) -> list[bool] | None:
        """A verdict for each text, in order; none if the model gave no readable reply."""


@dataclass(frozen=True)
class HashEmbedder:
    """Counts of hashed tokens at unit length, computed batch by batch where the texts are."""

    buckets: int = 64

    def describe(self) -> dict[str, str]:
        return {"provider": "local", "model": f"hashed-tokens-{self.buckets}"}

    def embed(self, df: DataFrame, text_col: str, vector_col: str = "embedding") -> DataFrame:
        """Null for texts without tokens."""
        buckets = self.buckets

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = TokenSlots(buckets)
            for batch in batches:
                flat: list[int] = []
                sizes = []
                for text in batch.column(text_col).to_pylist():
                    before = len(flat)
                    if text:
                        flat.extend(map(slots.__getitem__, TOKEN.findall(text.lower())))
                    sizes.append(len(flat) - before)
                n, size = len(sizes), np.array(sizes, np.int64)
                counts = np.bincount(np.repeat(np.arange(n), size) * buckets + np.array(flat, np.int64), minlength=n * buckets).reshape(n, buckets).astype(float)
                counts /= np.sqrt(np.maximum((counts * counts).sum(axis=1, keepdims=True), 1))
                offsets = pa.array(np.arange(0, n * buckets + 1, buckets, dtype=np.int32))
                yield batch.append_column(vector_col, pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()), mask=pa.array(size == 0)))

        return df.mapInArrow(count, with_vector(df, vector_col))


#: A token of the hashed embedding: Latin letters with and without marks.
TOKEN = re.compile("[a-zÀ-ɏ]+")
#: Tokens that a worker remembers.
MOST_TOKENS = 500_000


class TokenSlots(dict):
    """The bucket of each token: the first 32 bits of its MD5 modulo the number of buckets."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, token: str) -> int:
        if len(self) > MOST_TOKENS:
            self.clear()
        slot = self[token] = int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16) % self.buckets
        return slot


def with_vector(df: DataFrame, vector_col: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, f"`{vector_col}` array<double>"])


@dataclass(frozen=True)
class ExampleGenerator:
    """Gives back stored examples in turn."""

    examples: tuple[str, ...]

    def describe(self) -> dict[str, str]:
        return {"provider": "local", "model": "examples"}

    def generate(self, topic: str, n: int, document_type: str | None = None) -> list[str]:
        if not self.examples:
            raise ValueError("no examples to generate from")
        return [self.examples[i % len(self.examples)] for i in range(n)]


@dataclass(frozen=True)
class RuleEvaluator:
    """A verdict by a rule on the id and the text."""

    rule: Callable[[str, str], bool]

    def describe(self) -> dict[str, str]:
        return {"provider": "local", "model": "rule"}

    def evaluate(self, topic: str, ids: list[str], texts: list[str]) -> list[bool]:
        return [bool(self.rule(i, t)) for i, t in zip(ids, texts, strict=True)]


@dataclass(frozen=True)
class Endpoint:
    """Where requests go. The key is taken from the argument or else from the environment, at the first call."""

    url: str
    model: str
    key: str | None = field(default=None, repr=False)
    key_name: str = "OPENAI_API_KEY"
    timeout: float = 120.0

    def secret(self) -> str:
        key = self.key or os.environ.get(self.key_name)
        if not key:
            raise ValueError(f"no API key: pass one or set {self.key_name}")
        return key

    def post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.secret()}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def chat(self, prompt: str, schema: dict | None = None) -> str:
        body: dict = {"model": self.model, "messages": [{"role": "user", "content": prompt}]}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": "reply", "schema": schema, "strict": True}}
        return self.post("chat/completions", body)["choices"][0]["message"]["content"].strip()

    def ask(self, prompt: str) -> str:
        """The reply of the newer responses endpoint; where a server lacks it, that of the chat endpoint."""
        try:
            reply = self.post("responses", {"model": self.model, "input": prompt})
        except urllib.error.HTTPError as error:
            if error.code not in (404, 405, 501):
                raise
            return self.chat(prompt)
        return "".join(part.get("text", "") for item in reply["output"] for part in item.get("content") or []).strip()


@dataclass(frozen=True)
class HttpEmbedder:
    endpoint: Endpoint
    texts_at_once: int = REQUEST_TEXTS

    def describe(self) -> dict[str, str]:
        return {"provider": "http", "model": self.endpoint.model}

    def embed(self, df: DataFrame, text_col: str, vector_col: str = "embedding") -> DataFrame:
        def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, self.texts_at_once):
                    part = batch.slice(at, self.texts_at_once)
                    texts = [t or "" for t in part.column(text_col).to_pylist()]
                    data = sorted(self.endpoint.post("embeddings", {"model": self.endpoint.model, "input": texts})["data"], key=lambda x: x["index"])
                    if len(data) != len(texts):
                        raise ValueError(f"{len(data)} vectors for {len(texts)} texts")
                    yield part.append_column(vector_col, pa.array([x["embedding"] for x in data], pa.list_(pa.float64())))

        return df.mapInArrow(request, with_vector(df, vector_col))


@dataclass(frozen=True)
class HttpGenerator:
    endpoint: Endpoint

    def describe(self) -> dict[str, str]:
        return {"provider": "http", "model": self.endpoint.model}

    def generate(self, topic: str, n: int, document_type: str | None = None) -> list[str]:
        kind = document_type or "document"
        item = {"type": "object", "properties": {"name": {"type": "string"}, "description": {"type": "string"}}, "required": ["name", "description"], "additionalProperties": False}
        reply = json.loads(self.endpoint.chat(f"Write {n} different examples of a {kind} on the topic “{topic}”, each with a name and a short typical text. Reply with a JSON list.", {"type": "array", "items": item, "minItems": n, "maxItems": n}))
        if len(reply) != n:
            raise ValueError(f"{len(reply)} examples instead of {n}")
        return [f"{x['name']}\n{x['description']}" for x in reply]


@dataclass(frozen=True)
class HttpTitleGenerator:
    """Examples as titles, a line each. A reply that is one title short is taken; a shorter one gives none."""

    endpoint: Endpoint
    template: str = "Write {n} titles of texts on the topic “{topic}”, as different as possible. Reply with one title a line and nothing else."

    def describe(self) -> dict[str, str]:
        return {"provider": "http", "model": self.endpoint.model}

    def generate(self, topic: str, n: int, document_type: str | None = None) -> list[str] | None:
        return parse_titles(self.endpoint.ask(self.template.replace("{n}", str(n)).replace("{topic}", topic)), n)


@dataclass(frozen=True)
class HttpEvaluator:
    """Labels a batch in one prompt, whose reply must be a JSON list of as many booleans; any other reply raises ``ValueError`` at once."""

    endpoint: Endpoint
    template: str = "Topic: {topic}\nFor each numbered text, in order, say whether it is about the topic. Reply with a JSON list of true and false."

    def describe(self) -> dict[str, str]:
        return {"provider": "http", "model": self.endpoint.model}

    def evaluate(self, topic: str, ids: list[str], texts: list[str]) -> list[bool]:
        n = len(texts)
        verdicts = json.loads(self.endpoint.chat(numbered_prompt(self.template, topic, texts), {"type": "array", "items": {"type": "boolean"}, "minItems": n, "maxItems": n}))
        if not isinstance(verdicts, list) or len(verdicts) != n or not all(isinstance(v, bool) for v in verdicts):
            raise ValueError(f"the reply is not a list of {n} booleans")
        return verdicts


@dataclass(frozen=True)
class HttpDigitEvaluator:
    """Labels a batch by one digit a text. An unreadable reply is asked for again; after ``attempts`` of them there are no verdicts."""

    endpoint: Endpoint
    attempts: int = ATTEMPTS
    template: str = "Topic: {topic}\nFor each numbered text, in order, say whether it is about the topic. Reply with one digit a text, 1 or 0, and nothing else."
    pause: float = 1.0

    def describe(self) -> dict[str, str]:
        return {"provider": "http", "model": self.endpoint.model}

    def evaluate(self, topic: str, ids: list[str], texts: list[str]) -> list[bool] | None:
        prompt = numbered_prompt(self.template, topic, texts)
        for attempt in range(self.attempts):
            time.sleep(self.pause * attempt)
            verdicts = parse_digits(self.endpoint.ask(prompt), len(texts))
            if verdicts is not None:
                return verdicts
        return None


def numbered_prompt(template: str, topic: str, texts: list[str]) -> str:
    return template.replace("{topic}", topic) + "\n\n" + "\n".join(f"{i}. {t}" for i, t in enumerate(texts))


def parse_digits(reply: str, n: int) -> list[bool] | None:
    """Verdicts of a reply of exactly ``n`` digits 0 or 1, white space aside; none for any other reply."""
    digits = "".join(reply.split())
    return [d == "1" for d in digits] if len(digits) == n and set(digits) <= {"0", "1"} else None


def parse_titles(reply: str, n: int) -> list[str] | None:
    """The lines that are not blank, trimmed; none if fewer than ``n - 1``."""
    lines = [line.strip() for line in reply.split("\n") if line.strip()]
    return lines if len(lines) >= n - 1 else None


_REGISTRY: dict[str, dict[str, Callable[..., object]]] = {
    "embedder": {"hashed-tokens": HashEmbedder, "http": HttpEmbedder},
    "generator": {"examples": ExampleGenerator, "http": HttpGenerator, "http-titles": HttpTitleGenerator},
    "evaluator": {"rule": RuleEvaluator, "http": HttpEvaluator, "http-digits": HttpDigitEvaluator},
}


def register(kind: str, name: str, factory: Callable[..., object]) -> None:
    """Adds a provider under a name of one's own."""
    _REGISTRY[kind][name] = factory


def create(kind: str, name: str, **options) -> object:
    """A registered provider; ``ValueError`` for an unknown one."""
    known = _REGISTRY.get(kind, {})
    if name not in known:
        raise ValueError(f"unknown {kind} {name!r}; known: {', '.join(sorted(known)) or 'none'}")
    return known[name](**options)


def embed(df: DataFrame, text_col: str = "text", embedder: Embedder | None = None, vector_col: str = "embedding") -> DataFrame:
    """``df`` with a vector for each text."""
    return (embedder or HashEmbedder()).embed(df, text_col, vector_col)


def generate_documents(generator: Generator, topic: str, n: int, document_type: str | None = None) -> list[str]:
    """``n`` texts about a topic; ``ValueError`` if the generator gave none."""
    texts = generator.generate(topic, n, document_type)
    if not texts:
        raise ValueError("no examples to start from")
    return texts


def evaluate_documents(evaluator: Evaluator, topic: str, ids: list[str], texts: list[str]) -> list[bool]:
    """A verdict for each text; ``ValueError`` if there are none or not as many."""
    verdicts = evaluator.evaluate(topic, ids, texts)
    if verdicts is None:
        raise ValueError("the evaluator gave no readable reply")
    if len(verdicts) != len(texts):
        raise ValueError(f"{len(verdicts)} verdicts for {len(texts)} texts")
    return verdicts
