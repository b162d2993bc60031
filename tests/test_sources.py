"""URL sources against a local server, and what writes and names do with odd rows."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from loam.operators import lifecycle
from loam.sources import readers, web


class Pages(BaseHTTPRequestHandler):
    sent: dict = {}

    def do_GET(self):  # noqa: N802
        path = self.path
        if path.startswith("/away"):
            self.send_response(302)
            self.send_header("Location", {"/away": "/a.md", "/away/round": "/away/round", "/away/file": "file:///etc/hostname"}[path])
            self.end_headers()
        elif path == "/flood":  # says no length, and never ends on its own
            self.send_response(200)
            self.end_headers()
            try:
                while Pages.sent.setdefault(path, 0) < 500 << 20:
                    self.wfile.write(b"x" * 65536)
                    Pages.sent[path] += 65536
            except OSError:
                pass
        elif path == "/short":
            self.send_response(200)
            self.send_header("Content-Length", "100")
            self.end_headers()
            self.wfile.write(b"only this")
        elif path == "/slow":
            threading.Event().wait(3)
        elif path.startswith("/status"):
            self.send_error(int(path.rsplit("/", 1)[1]))
        else:
            body = b"# hi" if path.startswith("/a.md") else b"y" * 5000
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_urls(spark, site):
    want = {
        "/a.md?q=1": (200, b"# hi", ".md", None, None),
        "/away": (200, b"# hi", ".md", None, None),
        "/away/round": (302, None, None, "too many redirects", "fatal"),
        "/away/file": (302, None, None, "redirected to another scheme", "fatal"),
        "/big.html": (200, None, None, "too large: declared", "fatal"),
        "/flood": (200, None, None, "too large: while reading", "fatal"),
        "/short": (200, None, None, "the body ended early", "retryable"),
        "/slow": (None, None, None, "timed out", "timeout"),
        "/status/404": (404, None, None, "status 404", "fatal"),
        "/status/503": (503, None, None, "status 503", "retryable"),
        "/status/408": (408, None, None, "status 408", "timeout"),
    }
    urls = [site + p for p in want]
    spark.dataSource.register(web.WebSource)
    read = spark.read.format("web").option("urls", json.dumps(urls)).option("max_bytes", 1000).option("silent", 1).option("together", 3).load()
    assert read.rdd.getNumPartitions() == 4
    by_source = {r.url: r for r in read.collect()}
    by_column = {r.url: r for r in web.fetched(spark.createDataFrame([(u,) for u in urls], "url string"), max_bytes=1000, silent=1).collect()}
    for found in (by_source, by_column):
        got = {u.removeprefix(site): (r.status, bytes(r.content) if r.content is not None else None, r.extension, r.reason, r.error_kind) for u, r in found.items()}
        assert {k: v for k, v in got.items() if k != "/short"} == {k: v for k, v in want.items() if k != "/short"}
        assert got["/short"][1] is None and got["/short"][4] == "retryable"
        assert found[site + "/away"].final_url == site + "/a.md"
    assert Pages.sent["/flood"] < 100 << 20  # the ceiling held while the body came


def test_urls_that_are_none(spark):
    odd = [None, "", "ftp://x/y", "file:///etc/hostname", "http://", "http://[", "http://127.0.0.1:1/x", "C:\\docs"]
    rows = web.fetched(spark.createDataFrame([(u,) for u in odd], "url string"), silent=1).collect()
    assert [r.url for r in rows] == odd and all(r.content is None and r.reason for r in rows)
    assert [r.error_kind for r in rows][-2:] == ["retryable", "fatal"]
    spark.dataSource.register(web.WebSource)
    assert spark.read.format("web").load().count() == 0
    assert [web.extension_of(u) for u in ("http://x/a.tar.gz", "http://x/", "http://x/.md", "http://x/a.waytoolongsuffix", "http://x/a.b/c")] == [".gz", ".txt", ".txt", ".txt", ".txt"]


def test_names_with_an_underscore_are_refused_aloud(spark, tmp_path):
    for name in ("a.md", "_index.md", "_posts/x.md", "deep/_y.txt", ".git/_z", "node_modules/_w"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("text")
    found, refused = readers.files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.md"]
    assert {(r.path.split(f"{tmp_path}/")[1], r.reason) for r in refused.collect()} == {(n, "begins with an underscore") for n in ("_index.md", "_posts/x.md", "deep/_y.txt")}


def test_upserts_of_null_ids(spark):
    stored = spark.createDataFrame([(1, "a"), (None, "b")], "id int, v string")
    new = spark.createDataFrame([(None, "c"), (2, "d")], stored.schema)
    once = lifecycle.upserted(stored, new, "id")
    want = {(1, "a"), (None, "c"), (2, "d")}
    assert {tuple(r) for r in once.collect()} == want and once.count() == 3
    assert {tuple(r) for r in lifecycle.upserted(once, new, "id").collect()} == want and lifecycle.upserted(once, new, "id").count() == 3


def test_one_collection_and_one_target(spark):
    have = spark.createDataFrame([("old", 4, "dot", True)], "name string, dimensions int, distance string, sparse boolean")
    want = spark.createDataFrame([("n", 4, "dot", True, 2), ("n", 8, "dot", True, 1), ("n", 8, "dot", True, 3), ("old", 8, "dot", True, 1), ("old", 4, "dot", True, 2)], "name string, dimensions int, distance string, sparse boolean, seq int")
    got = sorted(tuple(r) for r in lifecycle.created(have, want).select("name", "dimensions", "verdict", "differs").collect())
    assert got == [("n", 4, "conflict", "dimensions"), ("n", 8, "created", ""), ("n", 8, "kept", ""), ("old", 4, "kept", ""), ("old", 8, "conflict", "dimensions")]
    assert sum(r.verdict == "created" for r in lifecycle.created(have, want.drop("seq")).collect()) == 1
    aliases = spark.createDataFrame([("x", "old")], "alias string, collection string")
    both = spark.createDataFrame([("a",), ("b",)], "name string")
    for changes, kept in (([("x", "a", 1), ("x", "b", 2)], {("x", "b")}), ([("x", "b", 2), ("x", None, 3)], set()), ([("x", "nowhere", 9), ("x", "a", 1)], {("x", "a")}), ([("x", "a", 1), ("x", "a", 1)], {("x", "a")})):
        after, judged = lifecycle.pointed(aliases, both, spark.createDataFrame(changes, "alias string, collection string, seq int"))
        assert {tuple(r) for r in after.collect()} == kept and after.count() == len(kept)
        assert sum(r.verdict in ("set", "deleted") for r in judged.collect()) == 1


def test_settings_flatten_whole(spark):
    deep = '{"a":' * 300 + "1" + "}" * 300
    texts = ['{"a":{"b":{"c":{"d":1}}},"s":"{x}","e":{},"n":null,"l":[1,{"x":2}],"t":true,"f":1.50,"a.b":7}', "{}", "[1]", "3", "not json", "", None, deep]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    from pyspark.sql import functions as F

    got = {r.i: r.m for r in rows.select("i", lifecycle.flattened(F.col("text")).alias("m")).collect()}
    assert got[0] == {"a.b.c.d": "1", "s": "{x}", "e": "{}", "n": None, "l": '["1",{"x":"2"}]', "t": "true", "f": "1.50", "a.b": "7"}
    assert all(got[i] == {} for i in range(1, 7)) and got[7] == {".".join("a" * 300): "1"}
