"""Providers and the HTTP index against a server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from docsieve.providers import Endpoint, HttpDigitEvaluator, HttpEmbedder, HttpEvaluator, HttpGenerator, HttpTitleGenerator, create, evaluate_documents, generate_documents, register
from docsieve.sources.files import read_vectors, write_vectors
from docsieve.sources.http_index import HttpIndex

DOCS = [{"id": f"d{i:02}", "type": "a" if i % 3 else "b", "name": f"n{i}", "text": None if i == 4 else "t", "embedding": [float(i), 1.0]} for i in range(25)]


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def answer(self, body, code=200):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def handle_any(self):
        size = int(self.headers.get("Content-Length") or 0)
        body = json.loads(self.rfile.read(size)) if size else {}
        s = self.server
        s.seen.append((self.command, self.path, body, self.headers.get("Authorization")))
        if self.path == "/embeddings":
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
            return self.answer({"data": data[::-1][s.short :]})
        if self.path == "/responses":
            if s.old:
                return self.answer({}, 404)
            return self.answer({"output": [{"type": "reasoning"}, {"content": [{"text": s.replies.pop(0)}]}]})
        if self.path == "/chat/completions":
            return self.answer({"choices": [{"message": {"content": s.replies.pop(0)}}]})
        if self.path == "/docs/_count":
            return self.answer({"count": len(DOCS)})
        if self.path.startswith("/docs/_search/point_in_time"):
            return self.answer({"pit_id": "p0"})
        if self.path == "/_search/point_in_time":
            return self.answer({"pits": []})
        if self.path == "/_search":
            if s.broken:
                return self.answer({}, 500)
            part = body.get("slice", {"id": 0, "max": 1})
            types = body["query"].get("terms", {}).get("type")
            after = body.get("search_after", [""])[0]
            found = [d for i, d in enumerate(DOCS) if i % part["max"] == part["id"] and d["id"] > after and (not types or d["type"] in types)][: body["size"]]
            return self.answer({"pit_id": "p1", "hits": {"hits": [{"_source": {k: v for k, v in d.items() if v is not None}, "sort": [d["id"]]} for d in found]}})
        return self.answer({}, 400)

    do_GET = do_POST = do_DELETE = handle_any


@pytest.fixture
def server():
    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    made.seen, made.replies, made.old, made.short, made.broken = [], [], False, 0, False
    made.url = f"http://127.0.0.1:{made.server_port}"
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def test_texts_are_embedded_256_at_a_time_and_in_order(spark, server):
    df = spark.createDataFrame([(i, "x" * (i % 7) if i else None) for i in range(600)], "i long, t string").coalesce(1)
    found = HttpEmbedder(Endpoint(server.url, "m", "key")).embed(df, "t", "v").collect()
    assert all(r["v"] == [float(len(r["t"] or "")), 1.0] for r in found) and len(found) == 600
    sizes = [len(b["input"]) for _, _, b, _ in server.seen]
    assert sum(sizes) == 600 and max(sizes) <= 256 and {a for *_, a in server.seen} == {"Bearer key"}
    server.short = 1
    with pytest.raises(Exception, match="vectors for"):
        HttpEmbedder(Endpoint(server.url, "m", "key")).embed(df.limit(3), "t", "v").collect()


def test_examples_and_titles(server):
    end = Endpoint(server.url, "m", "key")
    server.replies = [json.dumps([{"name": "a", "description": "b"}] * 2), json.dumps([]), " one \n\n two\n", "one"]
    assert generate_documents(HttpGenerator(end), "t", 2) == ["a\nb"] * 2
    assert server.seen[0][2]["response_format"]["json_schema"]["schema"]["minItems"] == 2
    with pytest.raises(ValueError, match="instead of"):
        HttpGenerator(end).generate("t", 2)
    assert HttpTitleGenerator(end).generate("t", 3) == ["one", "two"]
    assert HttpTitleGenerator(end).generate("t", 3) is None


def test_an_older_server_is_asked_by_chat(server):
    server.old, server.replies = True, ["one\ntwo"]
    assert HttpTitleGenerator(Endpoint(server.url, "m", "key")).generate("t", 2) == ["one", "two"]
    assert [p for _, p, *_ in server.seen] == ["/responses", "/chat/completions"]


def test_json_verdicts_are_strict(server):
    end = HttpEvaluator(Endpoint(server.url, "m", "key"))
    server.replies = ["[true, false]", "[true]", "[1, 0]", "{}", "no"]
    assert evaluate_documents(end, "t", ["a", "b"], ["x", "y"]) == [True, False]
    for _ in range(4):
        with pytest.raises(ValueError):
            end.evaluate("t", ["a", "b"], ["x", "y"])
    assert not server.replies  # no reply was asked for twice


def test_digits_are_asked_for_again_and_given_up(server):
    end = HttpDigitEvaluator(Endpoint(server.url, "m", "key"), attempts=3, pause=0)
    server.replies = ["yes", "1", "1 0"]
    assert end.evaluate("t", ["a", "b"], ["x", "y"]) == [True, False] and "0. x\n1. y" in server.seen[0][2]["input"]
    server.replies = ["yes"] * 3
    assert end.evaluate("t", ["a", "b"], ["x", "y"]) is None
    server.replies = ["yes"] * 3
    with pytest.raises(ValueError, match="readable"):
        evaluate_documents(end, "t", ["a", "b"], ["x", "y"])


def test_keys_and_names(monkeypatch, server):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError, match="key"):
        Endpoint(server.url, "m").chat("x")
    monkeypatch.setenv("OPENAI_API_KEY", "env")
    server.replies = ["ok"]
    assert Endpoint(server.url, "m").chat("x") == "ok" and server.seen[-1][3] == "Bearer env"
    with pytest.raises(ValueError, match="unknown"):
        create("embedder", "none")
    register("embedder", "own", lambda: "made")
    assert create("embedder", "own") == "made" and create("embedder", "hashed-tokens", buckets=8).buckets == 8


def test_index_is_read_in_slices_and_closed(spark, server, tmp_path):
    index = HttpIndex(server.url, "docs", "u", "p")
    assert index.count() == 25
    rows = index.scan(spark, str(tmp_path / "all"), slices=3, size=4).orderBy("id").collect()
    assert [r["id"] for r in rows] == [d["id"] for d in DOCS] and rows[4]["text"] is None and rows[3]["embedding"] == [3.0, 1.0]
    assert [r["id"] for r in index.scan(spark, str(tmp_path / "b"), "b", ("id",), 2, 3).orderBy("id").collect()] == [d["id"] for d in DOCS if d["type"] == "b"]
    assert sum(m == "DELETE" for m, *_ in server.seen) == 2 and server.seen[0][3].startswith("Basic ")
    server.broken = True
    with pytest.raises(Exception):  # noqa: B017
        index.scan(spark, str(tmp_path / "c"))
    assert server.seen[-1][0] == "DELETE"


def test_vectors_to_a_file_and_back(spark, tmp_path):
    rows = [(i, [float(i), i / 2, -1.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, embedding array<double>").repartition(3)
    assert write_vectors(df, str(tmp_path / "v.npy"), "k") == (10, 3)
    assert np.load(tmp_path / "v.npy").shape == (10, 3)
    back = read_vectors(spark, str(tmp_path / "v.npy"), first=5, rows_at_once=4)
    assert [tuple(r) for r in back.orderBy("row").collect()] == [(i + 5, v) for i, v in rows]
    with pytest.raises(ValueError, match="length"):
        write_vectors(df.unionByName(spark.createDataFrame([(99, [1.0])], df.schema)), str(tmp_path / "w.npy"), "k")
    assert write_vectors(df.limit(0), str(tmp_path / "x.npy"), "k") == (0, 0)
