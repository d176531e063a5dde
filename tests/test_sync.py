"""Incremental syncs against a server on this machine that counts what it is asked for."""

from __future__ import annotations

import base64
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from evisieve.engine import Engine
from evisieve.schemas import DOC
from evisieve.sources import cache, remote, sync
from pyspark.sql import functions as F


class Server:
    """A code host, a wiki and a tracker in one; their contents can change between requests."""

    def __init__(self):
        self.files = {"src/a.py": ("s1", "a = 1"), "src/b.py": ("s2", "b = 2"), "img.py": ("s3", None)}
        self.issues = [{"number": n, "title": f"I{n}", "state": "open", "body": f"body {n}", "updated_at": "t1"} | ({"pull_request": {}} if n % 2 else {}) for n in range(1, 251)]
        self.pages = {"1": (1, ["2", "3"]), "2": (1, ["4"]), "3": (1, []), "4": (1, ["1"])}
        self.tickets = {f"K-{n}": "t1" for n in range(1, 121)}
        self.broken: set[str] = set()
        self.bulk_fails = False
        self.asked: list[str] = []
        self.total = 0

    def answer(self, path: str, params: dict, body: dict | None):
        self.total += 1
        self.asked.append(path + (" " + params["cql"] + " " + params["expand"] if "cql" in params else "") + (" " + body["jql"] + " " + ",".join(body["fields"]) if body else ""))
        if path.startswith("/repos/o/r"):
            return self.host(path.removeprefix("/repos/o/r"), params)
        if path == "/rest/api/3/search/jql":
            return self.tracker(body)
        return self.wiki(path, params)

    def host(self, path: str, params: dict):
        if path == "/commits/main":
            return {"sha": f"c{sorted(self.files.items())}"[:40], "commit": {"tree": {"sha": "t"}}}
        if path == "/git/trees/t":
            return {"tree": [{"type": "blob", "path": p, "sha": sha, "size": 5} for p, (sha, _) in self.files.items()]}
        if path.startswith("/git/blobs/"):
            text = next(t for sha, t in self.files.values() if sha == path.rsplit("/", 1)[1])
            return {"content": base64.b64encode(b"\xff\xfe" if text is None else text.encode()).decode()}
        rows = self.issues if path == "/issues" else [i for i in self.issues if "pull_request" in i]
        size, page = int(params["per_page"]), int(params["page"])
        return rows[(page - 1) * size : page * size]

    def page(self, i: str):
        return {"id": i, "title": f"T{i}", "version": {"number": self.pages[i][0]}, "body": {"storage": {"value": f"<p>v{self.pages[i][0]}</p>"}}, "_links": {"webui": f"/p/{i}"}}

    def wiki(self, path: str, params: dict):
        if path.endswith("/child/page"):
            return {"results": [{"id": c} for c in self.pages[path.split("/")[-3]][1] if c in self.pages]}
        if path.endswith("/search"):
            ids = params["cql"].removeprefix("id in (").rstrip(")").split(",")
            if self.bulk_fails:
                return None
            return {"results": [self.page(i) for i in ids if i in self.pages and i not in self.broken]}
        i = path.rsplit("/", 1)[1]
        return None if i in self.broken or i not in self.pages else self.page(i)

    def tracker(self, body: dict):
        keys = [k for k in self.tickets if k not in self.broken]
        jql = body["jql"]
        if "key in (" in jql:
            keys = [k for k in keys if k in jql.split("(")[1].rstrip(")").split(",")]
        elif "key = " in jql:
            keys = [k for k in keys if k == jql.split("= ")[1]]
        elif ">=" in jql:
            a, b = (int(x.split()[0].split("-")[1]) for x in (jql.split(">= ")[1], jql.split("<= ")[1]))
            keys = [k for k in keys if a <= int(k.split("-")[1]) <= b]
        at = int(body.get("nextPageToken", 0))
        issues = [{"key": k, "fields": {"summary": f"S{k}", "updated": self.tickets[k]}} for k in keys[at : at + body["maxResults"]]]
        return {"issues": issues, "nextPageToken": str(at + len(issues)) if at + len(issues) < len(keys) else None}


@pytest.fixture
def server():
    own = Server()

    class Handler(BaseHTTPRequestHandler):
        def reply(self, body: dict | None = None) -> None:
            u = urlsplit(self.path)
            got = own.answer(u.path, {k: v[0] for k, v in parse_qs(u.query).items()}, body)
            self.send_response(404 if got is None else 200)
            self.end_headers()
            self.wfile.write(json.dumps(got).encode())

        def do_GET(self) -> None:
            self.reply()

        def do_POST(self) -> None:
            self.reply(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

        def log_message(self, *args) -> None:
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    own.url = f"http://127.0.0.1:{httpd.server_port}"
    yield own
    httpd.shutdown()


def engine(spark, tmp_path, server, *kinds: str) -> Engine:
    sources = {
        "host": {"id": "host", "type": "github", "repo": "o/r", "api_base_url": server.url, "issues": {"enabled": True, "limit": 100}, "pulls": {"enabled": True, "limit": 7}},
        "wiki": {"id": "wiki", "type": "confluence", "base_url": server.url, "page_ids": [1], "include_descendants": True},
        "tracker": {"id": "tracker", "type": "jira", "base_url": server.url, "jql": "project = K", "limit": 1000},
    }
    return Engine(spark, f"file://{tmp_path}/w", {"sources": [sources[k] for k in kinds], "security": {"allow_hosts": ["127.0.0.1"], "network_mode": "allow"}})


def texts(e: Engine) -> dict[str, str]:
    return {r["doc_id"]: r["text"] for r in e.docs().collect()}


def test_a_second_sync_fetches_only_what_changed(spark, tmp_path, server):
    e = engine(spark, tmp_path, server, "host", "wiki", "tracker")
    state = e.sync()
    assert all(s["ok"] for s in state.values()), state
    got = texts(e)
    assert {k for k in got if k.startswith("host:src")} == {"host:src/a.py", "host:src/b.py"} and state["host"]["failures"] == {"not text": 1}
    # Issues that are pull requests don't count towards the limit of issues.
    assert sum(k.startswith("host:issues/") for k in got) == 100 and sum(k.startswith("host:pulls/") for k in got) == 7
    assert {k: v for k, v in got.items() if k.startswith("wiki")} == {f"wiki:{i}": f"# T{i}\n\nv1" for i in "1234"}
    assert sum(k.startswith("tracker:") for k in got) == 120

    server.asked.clear()
    again = e.sync()
    assert texts(e) == got
    assert {s: (again[s]["fetched"], again[s]["unchanged"], again[s]["gone"]) for s in again} == {"host": (0, 109, 0), "wiki": (0, 4, 0), "tracker": (0, 120, 0)}
    assert not [a for a in server.asked if ("/git/blobs/" in a and not a.endswith("s3")) or "body" in a or "description" in a]  # no text was asked for

    server.files |= {"src/a.py": ("s9", "a = 9")}
    del server.files["src/b.py"], server.tickets["K-5"]
    server.pages["2"] = (2, [])  # the page below it is no longer in the tree
    server.tickets["K-7"] = "t2"
    server.asked.clear()
    third = e.sync()
    assert {s: (third[s]["fetched"], third[s]["gone"]) for s in third} == {"host": (1, 1), "wiki": (1, 1), "tracker": (1, 1)}
    now = texts(e)
    assert now["host:src/a.py"] == "a = 9" and "host:src/b.py" not in now and "tracker:K-5" not in now
    assert now["wiki:2"] == "# T2\n\nv2" and "wiki:4" not in now
    # The log of requests has what the server was asked, once each, and its summaries add up.
    logged = [(r["source_id"], r["requests"]) for r in e.egress("source_id").collect()]
    assert sum(n for _, n in logged) > 0 and {s for s, _ in logged} == {"host", "wiki", "tracker"}
    assert e.egress().first()["requests"] == sum(n for _, n in logged) == server.total
    # What a document is cited by comes from the listing, although its text wasn't fetched.
    urls = {r["doc_id"]: r["url"] for r in e.docs().collect()}
    assert "/blob/c" in urls["host:src/a.py"] and urls["wiki:1"].endswith("/p/1")
    assert [a for a in server.asked if "/git/blobs/" in a and not a.endswith("s3")] == ["/repos/o/r/git/blobs/s9"]


def test_one_page_that_fails_costs_one_page(spark, tmp_path, server):
    e = engine(spark, tmp_path, server, "wiki")
    server.broken = {"3"}
    state = e.sync()["wiki"]
    assert state["ok"] and state["failed"] == 1 and set(texts(e)) == {"wiki:1", "wiki:2", "wiki:4"}
    server.broken, server.bulk_fails = set(), True  # every call for many pages fails: they are read one by one
    assert e.sync()["wiki"]["failed"] == 0 and len(texts(e)) == 4
    server.bulk_fails, server.broken = False, {"2"}
    server.pages["2"] = (5, ["4"])
    state = e.sync()["wiki"]  # a page that can't be read now keeps the text that the cache has
    assert state["failed"] == 1 and texts(e)["wiki:2"] == "# T2\n\nv1"
    server.broken = set()
    assert e.sync()["wiki"]["fetched"] == 1 and texts(e)["wiki:2"] == "# T2\n\nv5"


def test_an_emptied_or_unreachable_source(spark, tmp_path, server):
    e = engine(spark, tmp_path, server, "host", "tracker")
    e.sync()
    server.tickets = {}
    assert e.sync()["tracker"] | {"failures": 0} == {"ok": True, "skipped": {}, "listed": 0, "unchanged": 0, "fetched": 0, "failed": 0, "gone": 120, "failures": 0}
    assert not [k for k in texts(e) if k.startswith("tracker")]
    e.build_index()
    assert all(h["source_id"] == "host" for h in e.search("S body K"))
    before = texts(e)
    e.hosts = ()  # nothing may be reached: the cache stays
    assert not any(s["ok"] for s in e.sync().values()) and texts(e) == before


def test_tree_of_pages_is_walked_in_tasks(spark, server):
    n = 2000
    server.pages = {str(i): (1, [str(c) for c in (3 * i, 3 * i + 1, 3 * i + 2) if c <= n]) for i in range(1, n + 1)}
    source = {"id": "w", "type": "confluence", "base_url": server.url, "page_ids": [1], "include_descendants": True, "limit": 10**6}
    gate = sync.gate_of(("127.0.0.1",), None, False)
    found = sync.walked(spark, source, gate, [])
    assert len(found) == len(set(found)) and set(found) == {str(i) for i in range(1, n + 1)} - {"2"} - {str(i) for i in range(1, n + 1) if _under(i, 2)}
    assert found == sync.walked(spark, source, gate, [])
    assert sync.walked(spark, source | {"limit": 50}, gate, []) == found[:50]
    assert remote.Wiki(source | {"limit": 50}, gate)._below(["1"])[:50] == found[:50]


def _under(i: int, top: int) -> bool:
    while i > top:
        i //= 3
    return i == top


def test_tracker_ranges_are_parts(spark, server):
    source = {"id": "t", "type": "jira", "base_url": server.url, "jql": "project = K order by created", "ranges": [["K-1", "K-60"], ["K-61", "K-500"]], "limit": 1000}
    own = remote.Tracker(source, sync.gate_of(("127.0.0.1",), None, False))
    assert own.parts()[0]["jql"] == "(project = K) AND key >= K-1 AND key <= K-60 ORDER BY key"
    assert sync.listed(spark, source, own.fetch, []).count() == 120


def test_reconcile_without_etags_and_with_repeated_items(spark):
    item = lambda i, etag: (f"d{i}", etag, "t", "u2", "v2", str(i))
    listing = spark.createDataFrame([item(1, "e"), item(1, "e"), item(2, None), item(3, "")], sync.ITEM)
    old = spark.createDataFrame([(f"d{i}", "s", "x", f"p{i}", "t", "doc", "md", "u1", "v1", "h", {"etag": e} if e is not None else None, f"old {i}") for i, e in ((1, "e"), (2, None), (3, ""), (4, "e"))], DOC)
    fetch = lambda df: df.select("doc_id", *(F.lit(f"{c}").alias(c) for c in ("source_id", "source_type", "path", "title", "kind", "lang", "url", "version", "hash")), F.create_map().cast("map<string,string>").alias("meta"), F.lit("new").alias("text"), F.when(F.col("item") == "3", "gone").alias("error"))
    out = sync.reconcile(listing, old, fetch)
    assert {(r.doc_id, r.text, r.url) for r in out.docs.collect()} == {("d1", "old 1", "u2"), ("d2", "new", "url"), ("d3", "old 3", "u1")}
    assert out.counts == {"listed": 3, "unchanged": 1, "fetched": 1, "failed": 1, "gone": 1} and out.failed == {"gone": 1}


def test_cache_of_an_emptied_source(spark, tmp_path):
    row = lambda s, t: (f"{s}:1", s, "x", "1", "t", "doc", "md", None, None, "h", {}, t)
    docs = spark.createDataFrame([row("a", "1"), row("b/c=d", "2")], DOC)
    path = f"file://{tmp_path}/c"
    assert cache.read_cache(spark, path).count() == 0
    cache.write_cache(docs, path)
    cache.write_cache(docs.where("source_id = 'a'").where("false"), path, ["a"])
    assert [r.source_id for r in cache.read_cache(spark, path).collect()] == ["b/c=d"]
    cache.replace_source(docs.where("false"), path, "b/c=d")
    assert cache.read_cache(spark, path).count() == 0
    cache.replace_source(docs.where("source_id = 'a'"), path, "a")
    cache.replace_source(cache.read_cache(spark, path, ["a"]).withColumn("text", F.lit("3")), path, "a")  # read while it is replaced
    assert [r.text for r in cache.read_cache(spark, path, ["a"]).collect()] == ["3"]
