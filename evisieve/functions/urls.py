"""URLs of code hosts, wikis and trackers as source settings. Nothing is fetched."""

from __future__ import annotations

import re
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(url: str) -> Any:
    try:
        parts = urlsplit(url.strip())
        return parts if parts.scheme and parts.netloc else None
    except ValueError:
        return None


def code_host_url(url: str, any_host: bool = False) -> dict[str, Any] | None:
    """host, repo, ref, sub_path, kind (repo, tree, file, pull, issue) and number."""
    u = _split(url)
    known = bool(u and "github" in u.netloc.lower())
    if not u or not (known or any_host) or (not known and u.netloc.lower().endswith("atlassian.net")):
        return None
    parts = u.path.strip("/").split("/")
    if len(parts) < 2:
        return None
    out = {"host": u.netloc, "repo": f"{parts[0]}/{parts[1].removesuffix('.git')}", "ref": None, "sub_path": None, "kind": "repo", "number": None}
    kind, rest = (parts[2] if len(parts) > 2 else None), parts[3:]
    if kind in ("tree", "blob"):
        out |= {"kind": "file" if kind == "blob" else "tree", "ref": unquote(rest[0]) if rest else None, "sub_path": "/".join(map(unquote, rest[1:])) or None}
    elif kind in ("pull", "issues"):
        out |= {"kind": "pull" if kind == "pull" else "issue", "number": int(rest[0]) if rest and rest[0].isdigit() else None}
    return out


def wiki_url(url: str) -> dict[str, Any] | None:
    """kind (page, space, shortlink), base_url, space_key, page_id and title."""
    u = _split(url)
    if not u:
        return None
    origin, full = f"{u.scheme}://{u.netloc}", u.path + (f"?{u.query}" if u.query else "")
    at = u.path.lower().find("/wiki/")
    out = {"kind": "page", "base_url": origin + (u.path[: at + 5] if at >= 0 else "/wiki"), "space_key": None, "page_id": None, "title": None}
    page = parse_qs(u.query).get("pageId", [""])[0]
    if page.isdigit():
        space = re.search("/(?:display|spaces)/([^/?]+)", full, re.I)
        return out | {"page_id": page, "space_key": unquote(space[1]) if space else None}
    if m := re.search(r"/spaces/([^/]+)/pages/(\d+)", full, re.I):
        after = full[m.end() :].removeprefix("/")
        return out | {"space_key": unquote(m[1]), "page_id": m[2], "title": unquote(re.split("[?#]", after)[0].replace("+", " ")) if after else None}
    if m := re.search("/(?:spaces|display)/([^/?#]+)", full, re.I):
        return out | {"kind": "space", "space_key": unquote(m[1])}
    return out | {"kind": "shortlink"} if "/wiki/x/" in u.path.lower() else None


def tracker_url(url: str) -> dict[str, Any] | None:
    """kind (issue, jql, project) with base_url and what it names."""
    u = _split(url)
    if not u:
        return None
    base = f"{u.scheme}://{u.netloc}"
    if m := re.search(r"/browse/([A-Z][A-Z0-9_]*)-(\d+)", u.path, re.I):
        return {"kind": "issue", "base_url": base, "project_key": m[1].upper(), "key": f"{m[1].upper()}-{m[2]}"}
    if jql := parse_qs(u.query).get("jql", [""])[0]:
        return {"kind": "jql", "base_url": base, "jql": jql}
    if m := re.search("/(?:projects|jira/software/(?:c/)?projects)/([A-Z][A-Z0-9_]*)", u.path, re.I):
        return {"kind": "project", "base_url": base, "project_key": m[1].upper()}
    return None


def url_to_source(url: str, source_id: str | None = None) -> dict[str, Any] | None:
    """Settings of the source that a URL names, or None where it names none (short links included)."""
    wiki, tracker = wiki_url(url), tracker_url(url)
    if wiki:
        if wiki["kind"] == "shortlink":
            return None
        own = {"id": source_id or ("wiki-" + wiki["space_key"].lower() if wiki["space_key"] else "wiki"), "type": "confluence", "base_url": wiki["base_url"]}
        if wiki["kind"] == "page":
            return own | {"page_ids": [wiki["page_id"]], "include_descendants": True, "limit": 200}
        return own | {"space_key": wiki["space_key"], "limit": 500}
    if tracker:
        key = tracker.get("project_key")
        own = {"id": source_id or (f"jira-{key.lower()}" if key else "jira"), "type": "jira", "base_url": tracker["base_url"]}
        if tracker["kind"] == "issue":
            return own | {"jql": f"key = {tracker['key']}", "limit": 1}
        if tracker["kind"] == "jql":
            return own | {"jql": tracker["jql"], "limit": 200}
        return own | {"jql": f"project = {key} AND updated >= -180d ORDER BY updated DESC", "limit": 300}
    host = code_host_url(url, any_host=True)
    if not host:
        return None
    sub = host["sub_path"]
    include = [sub if host["kind"] == "file" else f"{sub}/**"] if sub else ["src/**", "lib/**", "app/**", "docs/**", "*.md", "package.json"]
    own = {"id": source_id or re.sub(r"[^\w-]", "-", host["repo"].split("/")[1], flags=re.A), "type": "github", "repo": host["repo"], "ref": host["ref"] or "main", "mode": "clone", "include": include}
    return own if host["host"] == "github.com" else own | {"host": host["host"], "api_base_url": f"https://{host['host']}/api/v3"}


def url_parts(url: Column) -> dict[str, Column]:
    """Host, path, query and fragment of a URL column, without Python; null where there is none."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return {"host": part("HOST"), "path": part("PATH"), "query": part("QUERY"), "fragment": part("REF")}
