"""The embedding stage against a service of the test's own: order, limit, retries, texts asked for once."""

import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lodestack.errors import EmbeddingError
from lodestack.sources.embedding import HttpEmbedder, embedded, in_order


class Service:
    """Vectors are (length, first number) of a text; fails as told before it answers."""

    def __init__(self, failures=(), slow=0.0, shuffled=True):
        self.failures, self.slow, self.lock = list(failures), slow, threading.Lock()
        self.texts, self.sizes, self.now, self.most, self.times = Counter(), [], 0, 0, []
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
                with service.lock:
                    service.now += 1
                    service.most = max(service.most, service.now)
                    service.times.append(time.monotonic())
                    failure = service.failures.pop(0) if service.failures else None
                    if failure is None:
                        service.texts.update(asked)
                        service.sizes.append(len(asked))
                time.sleep(service.slow * (1 + len(asked[0]) % 3))
                data = [{"index": k, "embedding": [float(len(t)), float(t.split()[-1])]} for k, t in enumerate(asked)]
                body = json.dumps({"data": data[::-1] if shuffled else data}).encode()
                with service.lock:
                    service.now -= 1
                if failure == "hang up":
                    return self.close_connection
                self.send_response(failure[0] if failure else 200)
                for name, value in (failure[1] if failure else {}).items():
                    self.send_header(name, value)
                self.end_headers()
                self.wfile.write(b"no" if failure else body)

            def log_message(self, *about):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}"

    def __enter__(self):
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *about):
        self.server.shutdown()
        self.server.server_close()


def test_order_limit_and_no_text_twice(spark):
    texts = [f"text {'x' * (k % 7)} {k % 90}" for k in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    with Service(slow=0.02) as service:
        made = embedded(rows, HttpEmbedder(service.url, "m", in_flight=3), 2, batch=8).collect()
    assert [(r.chunk_id, *r.embedding) for r in made] == [(k, len(t), float(t.split()[-1])) for k, t in enumerate(texts)]
    assert set(service.texts) == set(texts) and set(service.texts.values()) == {1}
    assert 1 < service.most <= 3 and max(service.sizes) == 8


def test_one_after_the_other_unless_told(spark):
    rows = spark.createDataFrame([(k, f"t {k}") for k in range(50)] + [(50, None), (51, None)], "chunk_id long, text string").coalesce(1)
    made = embedded(rows, lambda texts: [[float(len(t or ""))] for t in texts], 1, batch=4).collect()
    assert [r.embedding[0] for r in made] == [3.0] * 10 + [4.0] * 40 + [0.0] * 2
    assert embedded(rows.limit(0), lambda texts: 1 / 0, 1).count() == 0


def test_retries():
    passing = [(429, {"Retry-After": "0.3"}), (503, {}), "hang up", (429, {"Retry-After": "Wed, 21 Oct 2015 07:28:00 GMT"})]
    with Service(failures=passing) as service:
        assert HttpEmbedder(service.url, "m", wait=0.01)(["a 1", "bc 2"]) == [[3.0, 1.0], [4.0, 2.0]]
    assert len(service.times) == 5 and service.times[1] - service.times[0] >= 0.3  # as long as the service asks for
    with Service(failures=[(503, {})] * 9) as service, pytest.raises(EmbeddingError, match="503: no"):
        HttpEmbedder(service.url, "m", wait=0.01, retries=2)(["a 1"])
    assert len(service.times) == 3
    with Service(failures=[(400, {})] * 9) as service, pytest.raises(EmbeddingError, match="400: no"):
        HttpEmbedder(service.url, "m", wait=0.01)(["a 1"])
    assert len(service.times) == 1  # final
    waits = [HttpEmbedder("u", "m").pause(k, None) for k in range(12)]
    assert 0.5 <= waits[0] <= 0.75 and 1.0 <= waits[1] <= 1.5 and 60 <= waits[11] <= 90


def test_first_error_ends_it():
    begun = []

    def ask(k):
        begun.append(k)
        if k == 2:
            raise EmbeddingError("down")
        return k

    got = []
    with pytest.raises(EmbeddingError):
        for x in in_order(iter(range(1000)), ask, 4):
            got.append(x)
    assert got == [0, 1] and len(begun) <= 7
    assert list(in_order(iter([]), ask, 2)) == []


def test_no_hash_vectors_for_other_models(spark, tmp_path, capsys):
    from lodestack.cli import main

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.md").write_text("alpha 1")
    base = ["--index-dir", str(tmp_path / "s"), "--master", "local[2]", "--dims", "2", "--model", "other"]
    assert main([*base, "index", "--root", str(tmp_path / "c")]) == 1 and "needs an embedding service" in capsys.readouterr().err
    with Service() as service:
        assert main([*base, "--gateway", service.url, "index", "--root", str(tmp_path / "c")]) == 0
        assert main([*base, "--gateway", service.url, "search", "--query", "alpha 1"]) == 0
    capsys.readouterr()
    assert main([*base, "--model", "word-hash", "search", "--query", "alpha 1"]) == 1  # the index was made by the other model
    assert "other needs an embedding service" in capsys.readouterr().err
    assert main([*base, "find", "alpha"]) == 0 and "passages skipped" in capsys.readouterr().out
