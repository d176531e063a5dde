"""Incremental reading of sources: list, compare with the cache, fetch what changed, drop what is gone.

A listing names every document of a source with an etag. Documents whose etag the cache holds are taken from it,
with what they are cited by from the listing; the others are fetched, spread over tasks; cached documents that the
listing doesn't name are gone. A document that can't be fetched keeps the text that the cache has, if any, and is
asked for again the next time, as its etag there is the old one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import kept
from ..schemas import DOC
from . import egress, remote

#: An item of a listing: `item` is JSON that the fetching step understands.
ITEM = "doc_id string, etag string, title string, url string, version string, item string"
#: A fetched document, or why there is none.
RESULT = f"{DOC}, error string"
#: What steps return besides: the requests they made, on rows without a doc_id.
_LOG = f"log array<struct<{', '.join(':'.join(f.split()) for f in egress.REQUEST.split(', '))}>>"
ITEMS_A_TASK = 500
_DOC = [f.split()[0] for f in DOC.split(", ")]


@dataclass
class Outcome:
    """A source's documents after a sync, and what became of its items."""

    docs: DataFrame
    counts: dict[str, int]
    failed: dict[str, int] = field(default_factory=dict)
    requests: list[DataFrame] = field(default_factory=list)


def reconcile(listing: DataFrame, cached: DataFrame | None, fetch: Callable[[DataFrame], DataFrame]) -> Outcome:
    """listing: rows of ITEM, each doc_id once; cached: rows of DOC, or None; fetch: rows of ITEM to rows of RESULT.

    `fetch` gets only items that the cache doesn't hold. A null etag is never held.
    """
    spark = listing.sparkSession
    listing = kept(listing.dropDuplicates(["doc_id"]), "listing")
    if cached is None:
        cached = spark.createDataFrame([], DOC)
    own_etag = F.col("meta")["etag"]
    held = cached.select("doc_id", own_etag.alias("etag")).where("etag is not null and etag <> ''")
    same = listing.join(held, ["doc_id", "etag"], "left_semi").select("doc_id", F.col("url").alias("new_url"), F.col("version").alias("new_version"))
    wanted = listing.join(held, ["doc_id", "etag"], "left_anti")
    fetched = kept(fetch(wanted), "fetched")
    newer = {c: F.coalesce(f"new_{c}", c) for c in ("url", "version")}
    unchanged = cached.join(same, "doc_id").select(*(newer.get(c, F.col(c)).alias(c) for c in _DOC))
    failed = fetched.where("error is not null")
    old = cached.join(failed.select("doc_id"), "doc_id", "left_semi").select(*_DOC)
    docs = kept(fetched.where("error is null").select(*_DOC).unionByName(unchanged).unionByName(old), "synced")
    n = lambda df: df.count()
    reasons = {r[0]: r[1] for r in failed.groupBy("error").count().orderBy(F.desc("count"), "error").limit(20).collect()}
    counts = {"listed": n(listing), "unchanged": n(same), "fetched": n(fetched.where("error is null")), "failed": n(failed), "gone": n(cached.join(listing, "doc_id", "left_anti"))}
    return Outcome(docs, counts, reasons)


def spread(spark: SparkSession, rows: DataFrame, per_task: int = ITEMS_A_TASK) -> DataFrame:
    """`rows` (counted) over as many tasks as they fill."""
    return rows.repartition(max(1, -(-rows.count() // per_task)))


_KINDS = {"string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
_REQUEST = pa.struct([("ts", pa.timestamp("us", tz="UTC")), ("method", pa.string()), ("host", pa.string()), ("url", pa.string()), ("bytes", pa.int64()), ("status", pa.int32()), ("ms", pa.int64())])


def _batch(rows: list[tuple], schema: str, gate: remote.Fetch) -> pa.RecordBatch:
    """Rows of `schema`, and one more with the requests that were made for them."""
    fields = [f.split() for f in schema.split(", ")]
    drained = getattr(gate, "drained", list)()
    notes = [dict(zip(_REQUEST.names, n, strict=True)) for n in drained] if drained else []
    columns = [pa.array([*(r[i] for r in rows), None], _KINDS[kind]) for i, (_, kind) in enumerate(fields)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([*[None] * len(rows), notes], pa.list_(_REQUEST))], names=[*(n for n, _ in fields), "log"])


def asked(spark: SparkSession, rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, log: list[DataFrame]) -> DataFrame:
    """What `run` gives for `rows`, stored; the requests that it made go to `log`."""
    first = schema.split()[0]
    out = kept(rows.mapInArrow(run, f"{schema}, {_LOG}"), "asked")
    log.append(out.where("log is not null").select(F.inline("log")))
    return out.where(F.col(first).isNotNull()).drop("log")


def walked(spark: SparkSession, source: dict, gate: remote.Fetch, log: list[DataFrame]) -> list[str]:
    """Ids of the pages at or below a wiki source's roots, level by level: a level's parents are asked for their children in tasks.

    At most the source's `limit` ids: upper levels first, within a level the smaller ids, whatever order servers and tasks answer in.
    """
    wiki = remote.Wiki(source, gate)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c,) for parent in batch.column(0).to_pylist() for c in wiki.children(parent)]
            yield _batch(found, "id string", gate)

    level = kept(spark.createDataFrame([(i,) for i in wiki.roots()], "id string"), "pages")
    seen, found = level, wiki.roots()[: wiki.most]
    for _ in range(remote.MOST_DEPTH):
        if len(found) >= wiki.most:
            break
        below_level = asked(spark, spread(spark, level, 20), below, "id string", log).distinct().join(seen, "id", "left_anti")
        level = kept(below_level, "pages")
        more = [r[0] for r in level.orderBy("id").limit(wiki.most - len(found)).collect()]  # the source's limit bounds them
        if not more:
            break
        found += more
        seen = seen.unionByName(level)
    return found


def listed(spark: SparkSession, source: dict, gate: remote.Fetch, log: list[DataFrame]) -> DataFrame:
    """Rows of ITEM of a remote source, a task per part of it."""
    own = remote.connector(source, gate)
    is_tree = source["type"] == "confluence" and source.get("page_ids") and source.get("include_descendants")
    parts = own.parts(walked(spark, source, gate, log)) if is_tree else own.parts()
    names = [f.split()[0] for f in ITEM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows = [{**i, "doc_id": f"{source['id']}:{i['path']}", "item": json.dumps(i)} for i in own.listing(json.loads(part))]
                yield _batch([tuple(r[n] for n in names) for r in rows], ITEM, gate)

    frame = spark.createDataFrame([(json.dumps(p),) for p in parts], "part string")
    return asked(spark, frame.repartition(max(1, len(parts))), run, ITEM, log)


def fetcher(source: dict, gate: remote.Fetch, log: list[DataFrame], per_task: int = ITEMS_A_TASK) -> Callable[[DataFrame], DataFrame]:
    """The fetching step of a remote source."""
    own = remote.connector(source, gate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for items in remote.groups(batch.column(0).to_pylist()):
                rows = []
                for item, made, error in own.fetched([json.loads(i) for i in items]):
                    made = made or dict.fromkeys(_DOC) | {"doc_id": f"{source['id']}:{item['path']}", "meta": {}}
                    rows.append((*(list(made[n].items()) if n == "meta" else made[n] for n in _DOC), error))
                yield _batch(rows, RESULT, gate)

    def fetch(wanted: DataFrame) -> DataFrame:
        wanted = kept(wanted, "wanted")
        return asked(wanted.sparkSession, spread(wanted.sparkSession, wanted.select("item"), per_task), run, RESULT, log)

    return fetch


def refreshed(spark: SparkSession, source: dict, gate: remote.Fetch, cached: DataFrame | None) -> Outcome:
    """A remote source after a sync. If nothing that was asked for could be had, and the cache helps with nothing, that is an error."""
    log: list[DataFrame] = []
    out = reconcile(listed(spark, source, gate, log), cached, fetcher(source, gate, log))
    out.requests = log
    if out.counts["failed"] and not out.counts["fetched"] and not out.counts["unchanged"]:
        raise remote.RemoteError(f"none of {out.counts['failed']} documents could be fetched: {next(iter(out.failed))}")
    return out


def gate_of(hosts: tuple[str, ...], headers: dict[str, str] | None, offline: bool, **more: Any) -> remote.Gate:
    return remote.Gate(hosts, offline, headers or {}, **more)
