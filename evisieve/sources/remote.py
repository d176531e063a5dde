"""Remote sources: code hosts, wikis and trackers, behind one gate for all network traffic.

Connectors turn JSON that a `fetch` function returns into documents, so they run against recorded answers as
well as against servers. They read in two steps. `listing` yields an item for each document of one of a source's
`parts`: its path, what it is cited by, and an etag that changes with its text. `fetched` yields documents for items, or
why one couldn't be had; a page that fails costs that page. sources/sync.py runs both in tasks and fetches only what
the cache doesn't hold; RemoteDocs reads a whole source as a table.

`Gate` is the fetch function for servers: hosts must be allowed, only reading methods and the listed posts pass,
redirects stay on their origin, and every request is counted and logged without its query.
"""

from __future__ import annotations

import base64
import json
import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from hashlib import sha256
from typing import Any
from urllib.error import HTTPError
from urllib.parse import quote, urlencode, urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.html import VERSION, html_to_text, rich_text
from ..functions.paths import py_any_glob, py_is_sensitive, py_kind_and_lang
from ..functions.redact import redact
from ..schemas import DOC

Fetch = Callable[..., Any]
PAGE, IDS_A_CALL, MOST_REDIRECTS, MOST_DEPTH = 100, 50, 5, 10
#: What a clone or tree leaves out unless included.
DEFAULT_EXCLUDES = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/vendor/**", "**/*.min.js", "**/*.lock", "**/package-lock.json")


class EgressDenied(PermissionError):
    """A request that the settings don't allow."""


class RemoteError(RuntimeError):
    """An answer that can't be used; `retry` tells whether another try may help."""

    def __init__(self, message: str, retry: bool = True):
        super().__init__(redact(message)[0])
        self.retry = retry


def retried(call: Callable[[], Any], attempts: int = 4, base: float = 0.6, sleep: Callable[[float], None] = time.sleep) -> Any:
    """The result of `call`, tried again with growing pauses unless the error says not to."""
    for i in range(attempts):
        try:
            return call()
        except Exception as e:
            if i == attempts - 1 or not getattr(e, "retry", True) or isinstance(e, EgressDenied):
                raise
            sleep(base * 2**i + random.random() * 0.2)
    raise AssertionError


@dataclass
class Gate:
    """Fetches JSON, if the settings let it."""

    hosts: tuple[str, ...] = ()
    offline: bool = False
    headers: dict[str, str] = field(default_factory=dict)
    posts: tuple[str, ...] = ("/rest/api/3/search/jql",)
    log_path: str | None = None
    counters: dict[str, dict[str, int]] = field(default_factory=dict)
    notes: list[tuple] = field(default_factory=list)
    timeout: float = 60.0

    def check(self, url: str, method: str = "GET") -> None:
        u = urlsplit(url)
        if self.offline:
            raise EgressDenied("offline: no request leaves this machine")
        if u.scheme != "https" and u.hostname not in ("127.0.0.1", "localhost"):
            raise EgressDenied(f"only https: {u.scheme}")
        if u.hostname not in self.hosts:
            raise EgressDenied(f"{u.hostname} isn't among the allowed hosts")
        if method not in ("GET", "HEAD") and not (method == "POST" and u.path in self.posts):
            raise EgressDenied(f"{method} {u.path} isn't allowed")

    def __call__(self, url: str, params: dict | None = None, body: dict | None = None) -> Any:
        method = "POST" if body is not None else "GET"
        url = url + ("?" + urlencode(params) if params else "")
        return retried(lambda: self._once(url, method, body))

    def _once(self, url: str, method: str, body: dict | None) -> Any:
        data = json.dumps(body).encode() if body is not None else None
        for _ in range(MOST_REDIRECTS + 1):
            self.check(url, method)
            began, status = time.time(), 0
            try:
                with build_opener(_Stay()).open(Request(url, data, {"Accept": "application/json", **self.headers}, method=method), timeout=self.timeout) as answer:
                    status, text = answer.status, answer.read().decode("utf-8", "replace")
            except HTTPError as e:
                status = e.code
                if 300 <= status < 400 and (to := e.headers.get("Location")):
                    to = urljoin(url, to)
                    if urlsplit(to)[:2] != urlsplit(url)[:2]:
                        raise EgressDenied("a redirect to another origin") from e
                    url = to
                    continue
                raise RemoteError(f"HTTP {status} from {urlsplit(url).hostname}", retry=status in (429, 500, 502, 503, 504)) from e
            finally:
                self._note(url, method, len(data or b""), status, time.time() - began)
            try:
                return json.loads(text)
            except ValueError as e:
                raise RemoteError("the answer isn't JSON", retry=False) from e
        raise RemoteError("too many redirects", retry=False)

    def _note(self, url: str, method: str, sent: int, status: int, seconds: float) -> None:
        u = urlsplit(url)
        count = self.counters.setdefault(u.hostname or "", {"requests": 0, "bytes": 0})
        count["requests"] += 1
        count["bytes"] += sent
        self.notes.append((datetime.now(UTC), method, u.hostname or "", f"{u.scheme}://{u.netloc}{u.path}", sent, status, round(seconds * 1000)))
        if self.log_path:
            row = {"ts": datetime.now(UTC).isoformat(), "method": method, "url": f"{u.scheme}://{u.netloc}{u.path}", "bytes": sent, "status": status, "ms": round(seconds * 1000)}
            with open(self.log_path, "a") as log:
                log.write(json.dumps(row) + "\n")


    def drained(self) -> list[tuple]:
        """Rows of egress.REQUEST since the last call."""
        out, self.notes = self.notes, []
        return out


class _Stay(HTTPRedirectHandler):
    def redirect_request(self, *args: Any) -> None:
        return None


def doc(source_id: str, source_type: str, path: str, text: str, **more: Any) -> dict[str, Any]:
    """A row of schemas.DOC."""
    return {"doc_id": f"{source_id}:{path}", "source_id": source_id, "source_type": source_type, "path": path, "title": more.get("title") or path, "kind": more.get("kind") or "other", "lang": more.get("lang") or "txt", "url": more.get("url"), "version": more.get("version"), "hash": sha256(text.encode()).hexdigest(), "meta": {k: str(v) for k, v in (more.get("meta") or {}).items()}, "text": text}


def paged(fetch: Fetch, url: str, params: dict, most: int, accept: Callable[[dict], bool] = lambda row: True, size: int = PAGE) -> Iterator[dict]:
    """Accepted rows of a numbered listing, `most` of them; a short page ends it."""
    n, page = 0, 1
    while n < most:
        rows = fetch(url, {**params, "per_page": size, "page": page})
        for row in [r for r in rows if accept(r)][: most - n]:
            n += 1
            yield row
        page += 1
        if len(rows) < size:
            return


def followed(fetch: Fetch, url: str, params: dict | None = None) -> Iterator[dict]:
    """Pages of a listing that links to the next one; a link met before ends it."""
    seen = set()
    while url and url not in seen:
        seen.add(url)
        answer = fetch(url, params)
        yield answer
        params, nxt = None, (answer.get("_links") or {}).get("next")
        url = urljoin(url, (answer.get("_links") or {}).get("base", "") + nxt if nxt and nxt.startswith("/rest") else nxt) if nxt else ""


#: An item, and its document or what went wrong.
Fetched = tuple[dict, dict | None, str | None]


def attempt(item: dict, make: Callable[[], dict | None], missing: str = "no text") -> Fetched:
    """What `make` gives for an item; errors of one item are told, a denied request ends the reading."""
    try:
        made = make()
    except EgressDenied:
        raise
    except Exception as e:  # one document's failure isn't the source's
        return item, None, redact(str(e))[0].split("\n")[0] or type(e).__name__
    return item, made, None if made else missing


def item_of(path: str, etag: str | None, **more: Any) -> dict:
    """An item of a listing; `ref` is what its connector fetches it by. Without an etag it is always fetched."""
    return {"path": path, "etag": etag, "title": path, "kind": "other", "lang": "txt", "url": None, "version": None, "ref": {}} | more


@dataclass
class CodeHost:
    """Files, issues and pull requests of a repository by its API."""

    source: dict
    fetch: Fetch

    @property
    def api(self) -> str:
        return f"{self.source.get('api_base_url', 'https://api.github.com').rstrip('/')}/repos/{self.source['repo']}"

    def parts(self) -> list[dict]:
        """Files, unless they come from a clone, and the discussions that are enabled."""
        files = [] if self.source.get("mode") == "clone" else [{"part": "files"}]
        return [*files, *({"part": name} for name in ("issues", "pulls") if (self.source.get(name) or {}).get("enabled"))]

    def listing(self, part: dict) -> Iterator[dict]:
        return self.files() if part["part"] == "files" else self.discussions(part["part"])

    def files(self) -> Iterator[dict]:
        """Blobs of the tree that the source includes; a truncated tree is an error, not a smaller source."""
        commit = self.fetch(f"{self.api}/commits/{quote(self.source.get('ref', 'main'), safe='')}")
        tree = self.fetch(f"{self.api}/git/trees/{commit['commit']['tree']['sha']}", {"recursive": "1"})
        if tree.get("truncated"):
            raise RemoteError("the tree is cut: use a clone for this repository", retry=False)
        include, exclude = self.source.get("include", ()), (*DEFAULT_EXCLUDES, *self.source.get("exclude", ()))
        files = [t for t in tree["tree"] if t["type"] == "blob" and t.get("size", 0) <= self.source.get("max_bytes", 400_000)]
        files = [t for t in files if not py_any_glob(t["path"], exclude) and (not include or py_any_glob(t["path"], include)) and not py_is_sensitive(t["path"])]
        files = [t for t in files if self.source.get("include_unknown_types") or py_kind_and_lang(t["path"])[0] != "other"]
        for t in files[: self.source.get("max_files", 5000)]:
            kind, lang = py_kind_and_lang(t["path"])
            url = f"https://{self.source.get('host', 'github.com')}/{self.source['repo']}/blob/{commit['sha']}/{quote(t['path'])}"
            yield item_of(t["path"], t["sha"], kind=kind, lang=lang, version=commit["sha"], url=url, ref={"blob": t["sha"]})

    def discussions(self, name: str) -> Iterator[dict]:
        """Issues or pull requests up to their own limit; a listing holds their texts. Issues that are pull requests don't count."""
        own, kind = self.source[name], "issue" if name == "issues" else "pr"
        rows = paged(self.fetch, f"{self.api}/{name}", {"state": own.get("state", "all"), "sort": "updated"}, own.get("limit", 100), lambda r: kind == "pr" or "pull_request" not in r)
        for row in rows:
            labels = ", ".join(x["name"] if isinstance(x, dict) else str(x) for x in row.get("labels") or [])
            head = [f"# #{row['number']} {row['title']}", f"state: {row['state']}", f"labels: {labels}" if labels else None, f"author: {(row.get('user') or {}).get('login', '?')}", ""]
            text = "\n".join([*(h for h in head if h is not None), row.get("body") or ""])
            yield item_of(f"{name}/{row['number']}", row.get("updated_at"), kind=kind, lang="md", title=f"#{row['number']} {row['title']}", url=row.get("html_url"), version=row.get("updated_at"), ref={"text": text})

    def fetched(self, items: list[dict]) -> Iterator[Fetched]:
        for item in items:
            yield attempt(item, lambda item=item: self._doc(item), "not text")

    def _doc(self, item: dict) -> dict | None:
        text = item["ref"].get("text")
        if text is None:
            raw = base64.b64decode(self.fetch(f"{self.api}/git/blobs/{item['ref']['blob']}")["content"])
            try:
                text = raw.decode("utf-8").removeprefix("\ufeff")
            except UnicodeDecodeError:
                return None
            if b"\x00" in raw[:4096]:
                return None
        return doc(self.source["id"], "github", text=text, meta={"etag": item["etag"] or ""}, **{k: item[k] for k in ("path", "kind", "lang", "title", "url", "version")})


def cql(source: dict) -> str:
    """The query that a wiki source's settings describe."""
    quoted = lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    parts = ["type = page"]
    if source.get("space_key"):
        parts.append(f"space = {quoted(source['space_key'])}")
    parts += [f"label = {quoted(x)}" for x in source.get("labels", ())]
    if source.get("title"):
        parts.append(f"title ~ {quoted(source['title'])}")
    if source.get("updated_since"):
        parts.append(f"lastmodified >= {quoted(source['updated_since'])}")
    return " AND ".join(parts) + " ORDER BY lastmodified DESC"


def groups(values: list, size: int = IDS_A_CALL) -> list[list]:
    return [values[i : i + size] for i in range(0, len(values), size)]


@dataclass
class Wiki:
    """Pages by id with their descendants, else by query, else of a space; each page once, the first counts."""

    source: dict
    fetch: Fetch

    @property
    def base(self) -> str:
        return self.source["base_url"].rstrip("/")

    @property
    def most(self) -> int:
        return self.source.get("limit", 500)

    def roots(self) -> list[str]:
        return list(dict.fromkeys(map(str, self.source.get("page_ids") or ())))

    def children(self, parent: str) -> list[str]:
        """Ids of the pages right below one."""
        return [str(r["id"]) for page in followed(self.fetch, f"{self.base}/rest/api/content/{parent}/child/page", {"limit": PAGE}) for r in page["results"]]

    def parts(self, found: list[str] | None = None) -> list[dict]:
        """Groups of ids, or one query. found: ids of a walk that was made elsewhere (sync.walked)."""
        if not self.source.get("page_ids"):
            return [{"cql": self.source.get("cql") or cql(self.source)}]
        if found is None:
            found = self._below(self.roots()) if self.source.get("include_descendants") else self.roots()
        return [{"ids": g} for g in groups(list(dict.fromkeys(found))[: self.most])]

    def _below(self, roots: list[str]) -> list[str]:
        level, seen = roots, dict.fromkeys(roots)
        for _ in range(MOST_DEPTH):
            level = sorted({c for parent in level for c in self.children(parent)} - seen.keys())
            seen |= dict.fromkeys(level)
            if not level or len(seen) >= self.most:
                break
        return list(seen)

    def listing(self, part: dict) -> Iterator[dict]:
        """Versions of pages, without their texts. Pages by id that a call leaves out are listed without a version."""
        if "cql" in part:
            n, seen = 0, set()
            for page in followed(self.fetch, f"{self.base}/rest/api/content/search", {"cql": part["cql"], "expand": "version", "limit": PAGE}):
                for r in page["results"]:
                    if r["id"] not in seen and n < self.most:
                        seen.add(r["id"])
                        n += 1
                        yield self._item(str(r["id"]), r)
                if n >= self.most:
                    return
            return
        try:
            got = {str(r["id"]): r for r in self._by_ids(part["ids"], "version")}
        except EgressDenied:
            raise
        except Exception:  # the pages are fetched one by one then
            got = {}
        for i in part["ids"]:
            yield self._item(i, got.get(i, {}))

    def _by_ids(self, ids: list[str], expand: str) -> list[dict]:
        return self.fetch(f"{self.base}/rest/api/content/search", {"expand": expand, "cql": f"id in ({','.join(ids)})", "limit": len(ids)})["results"]

    def _item(self, page_id: str, row: dict) -> dict:
        version = str((row.get("version") or {}).get("number", ""))
        # A text depends on the page's version and on how HTML is turned into text.
        return item_of(page_id, f"{version}/{VERSION}" if version else None, kind="doc", lang="md", version=version, ref={"id": page_id})

    def fetched(self, items: list[dict]) -> Iterator[Fetched]:
        """A call for many ids, then one each for those it left out or if it failed."""
        want = "body.storage,version,metadata.labels,space"
        for group in groups(items):
            try:
                got = {str(p["id"]): p for p in self._by_ids([i["ref"]["id"] for i in group], want)}
            except EgressDenied:
                raise
            except Exception:
                got = {}
            for item in group:
                page_id = item["ref"]["id"]
                yield attempt(item, lambda i=page_id, own=got: self._doc(own[i] if i in own else self.fetch(f"{self.base}/rest/api/content/{i}", {"expand": want})))

    def _doc(self, page: dict) -> dict:
        item = self._item(str(page["id"]), page)
        title = page.get("title") or f"(untitled {page['id']})"
        labels = [x["name"] for x in ((page.get("metadata") or {}).get("labels") or {}).get("results", [])]
        text = f"# {title}\n\n{html_to_text(((page.get('body') or {}).get('storage') or {}).get('value'))}"
        return doc(self.source["id"], "confluence", item["path"], text, kind="doc", lang="md", title=title, url=f"{self.base}{(page.get('_links') or {}).get('webui', '')}", version=item["version"], meta={"labels": ",".join(labels), "text_version": VERSION, "etag": item["etag"] or ""})


@dataclass
class Tracker:
    """Tickets that a JQL query finds. A source may name `ranges` of keys, which are listed side by side."""

    source: dict
    fetch: Fetch

    def parts(self) -> list[dict]:
        """The whole query, or the query within each range: pairs of a first and a last key."""
        order = re.search(r"\border\s+by\b", self.source["jql"], re.IGNORECASE)
        own = self.source["jql"][: order.start()] if order else self.source["jql"]
        within = [f"({own.strip()}) AND key >= {a} AND key <= {b} ORDER BY key" if own.strip() else f"key >= {a} AND key <= {b} ORDER BY key" for a, b in self.source.get("ranges", ())]
        return [{"jql": q} for q in within or [self.source["jql"]]]

    def _search(self, jql: str, fields: list[str], most: int) -> Iterator[dict]:
        url, token, n = f"{self.source['base_url'].rstrip('/')}/rest/api/3/search/jql", None, 0
        while n < most:
            answer = self.fetch(url, None, {"jql": jql, "maxResults": min(PAGE, most - n), "fields": fields} | ({"nextPageToken": token} if token else {}))
            issues = answer.get("issues") or []
            yield from issues[: most - n]
            n, before, token = n + len(issues), token, answer.get("nextPageToken")
            if not token or token == before or not issues:
                return

    def listing(self, part: dict) -> Iterator[dict]:
        seen = set()
        for issue in self._search(part["jql"], ["updated"], self.source.get("limit", 200)):
            if issue["key"] not in seen:
                seen.add(issue["key"])
                updated = issue["fields"].get("updated")
                yield item_of(issue["key"], updated, kind="ticket", lang="md", version=updated, url=f"{self.source['base_url'].rstrip('/')}/browse/{issue['key']}", ref={"key": issue["key"]})

    def fetched(self, items: list[dict]) -> Iterator[Fetched]:
        """A search for many keys, then one each for those it left out or if it failed."""
        fields = ["summary", "description", "status", "issuetype", "labels", "updated"]
        one = lambda key: next(iter(self._search(f"key = {key}", fields, 1)), None)
        for group in groups(items):
            try:
                got = {i["key"]: i for i in self._search(f"key in ({','.join(i['ref']['key'] for i in group)})", fields, len(group))}
            except EgressDenied:
                raise
            except Exception:
                got = {}
            for item in group:
                key = item["ref"]["key"]
                yield attempt(item, lambda key=key, own=got: self._doc(own.get(key) or one(key)), "no such ticket")

    def _doc(self, issue: dict | None) -> dict | None:
        if issue is None:
            return None
        f = issue["fields"]
        named = lambda k: (f.get(k) or {}).get("name", "?")
        head = [f"# {issue['key']} {f.get('summary') or ''}", f"type: {named('issuetype')}", f"status: {named('status')}", f"labels: {', '.join(f.get('labels') or [])}", ""]
        return doc(self.source["id"], "jira", issue["key"], "\n".join(head) + "\n" + rich_text(f.get("description")), kind="ticket", lang="md", title=f"{issue['key']} {f.get('summary') or ''}", url=f"{self.source['base_url'].rstrip('/')}/browse/{issue['key']}", version=f.get("updated"), meta={"etag": f.get("updated") or ""})


CONNECTORS: dict[str, type] = {"github": CodeHost, "confluence": Wiki, "jira": Tracker}


def connector(source: dict, gate: Fetch) -> CodeHost | Wiki | Tracker:
    return CONNECTORS[source["type"]](source, gate)


@dataclass
class Part(InputPartition):
    part: dict


class RemoteReader(DataSourceReader):
    """A partition per part of the source: what it lists is fetched in the same task."""

    def __init__(self, own: Any):
        self.own = own

    def partitions(self) -> list[InputPartition]:
        return [Part(p) for p in self.own.parts()]

    def read(self, partition: Part) -> Iterator[tuple]:
        names = [f.split()[0] for f in DOC.split(", ")]
        for _, d, _ in self.own.fetched(list(self.own.listing(partition.part))):
            if d is not None:
                yield tuple(d[n] for n in names)


class RemoteDocs(DataSource):
    """`spark.read.format("remote_docs").option("source", json).option("hosts", "a,b")`."""

    @classmethod
    def name(cls) -> str:
        return "remote_docs"

    def schema(self) -> str:
        return DOC

    def reader(self, schema: Any) -> DataSourceReader:
        gate = Gate(tuple(self.options.get("hosts", "").split(",")), self.options.get("offline", "false") == "true", json.loads(self.options.get("headers", "{}")))
        return RemoteReader(connector(json.loads(self.options["source"]), gate))


def remote_docs(spark: SparkSession, source: dict, hosts: tuple[str, ...], headers: dict[str, str] | None = None, offline: bool = False) -> DataFrame:
    """Documents of a remote source; headers (credentials) come from the caller's environment, not from settings."""
    spark.dataSource.register(RemoteDocs)
    return spark.read.format("remote_docs").options(source=json.dumps(source), hosts=",".join(hosts), headers=json.dumps(headers or {}), offline=str(offline).lower()).load()
