"""An index in immutable segments: an update writes what changed, and counts are kept by addition.

A segment holds chunks, postings, lengths and maybe vectors of the documents that one update brought. Documents that
change or go leave their old rows where they are; a dead table per update names those rows by (segment, key), found by a join
of the documents with the segments' lengths alone. Readers leave dead rows out by an anti-join. Number and summed length of live
chunks are in the version's manifest, one pair a segment less one pair a dead table, so no update counts the corpus.

Segments of one size class, a power of FAN, are merged into one once there are FAN of them: live rows are written again,
once a class, so a chunk is rewritten as often as the index has classes. Dead rows vanish there, and so do dead
tables whose segments are gone. A version is visible once its manifest exists; leases keep old ones for readers.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Folder
from .index import FORMAT, KEPT, Superseded, arranged, stored_postings
from .leases import SECONDS, Leases
from .tables import kept

FAN = 4


def size_class(chunks: int, fan: int = FAN) -> int:
    """How often `fan` divides the number of chunks until one is left."""
    out = 0
    while chunks >= fan:
        chunks, out = chunks // fan, out + 1
    return out


class SegmentStore:
    """The index under one folder; `update` is for one writer at a time, a second one is told that it lost."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        self.versions, self.leases = Folder(spark, f"{self.path}/versions"), Leases(spark, self.path)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def generations(self) -> list[int]:
        return sorted(int(n[:8]) for n in self.versions.newest(".json"))

    def manifest(self, version: int) -> dict[str, Any]:
        return json.loads(self.versions.read(f"{version:08d}.json"))

    def newest(self) -> dict[str, Any]:
        numbers = self.generations()
        return self.manifest(numbers[-1]) if numbers else {"version": 0, "segments": {}, "dead": {}, "dims": None}

    # Reading

    def _table(self, segments: list[str], name: str) -> DataFrame | None:
        frames = [self.spark.read.parquet(f"{self.path}/segment-{s}/{name}").withColumn("segment", F.lit(s)) for s in segments]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _dead(self, own: dict[str, Any]) -> DataFrame | None:
        """Dead rows of a version's segments."""
        folders = [f"{self.path}/dead-{d}" for d in own["dead"]]
        return self.spark.read.parquet(*folders).where(F.col("segment").isin(*own["segments"])) if folders else None

    def live(self, own: dict[str, Any], name: str, segments: list[str] | None = None) -> DataFrame | None:
        """A table's live rows, of all or some segments, with `segment`."""
        rows = self._table(list(own["segments"]) if segments is None else segments, name)
        dead = self._dead(own)
        return rows if rows is None or dead is None else rows.join(dead, ["segment", "key"], "left_anti")

    def documents(self) -> DataFrame:
        """doc_id and hash of what is indexed; a document without a hash has null."""
        rows = self.live(self.newest(), "lengths")
        return self.spark.createDataFrame([], "doc_id string, hash string") if rows is None else rows.select("doc_id", F.col("doc_hash").alias("hash")).distinct()

    def open(self, lease: float | None = None, attempts: int = 3) -> SegmentSnapshot:
        """The newest version, held by a lease of so many seconds if one is asked for."""
        for attempt in range(attempts):
            numbers = self.generations()
            if not numbers:
                raise FileNotFoundError(f"no index at {self.path}: build one first")
            held = self.leases.take(numbers[-1], lease) if lease else None
            try:
                return SegmentSnapshot(self, self.manifest(numbers[-1]), held)
            except Exception:
                if held:
                    held.release()
                if attempt == attempts - 1 or self.generations()[-1:] == numbers[-1:]:
                    raise
        raise AssertionError

    # Writing

    def _write(self, name: str, chunks: DataFrame, postings: DataFrame, lengths: DataFrame, vectors: DataFrame | None) -> dict[str, int]:
        folder = f"{self.path}/segment-{name}"
        chunks.write.parquet(f"{folder}/chunks")
        arranged(postings).write.parquet(f"{folder}/postings")
        lengths.write.parquet(f"{folder}/lengths")
        if vectors is not None:
            vectors.select("key", "embedding").write.parquet(f"{folder}/vectors")
        n, dl = self.spark.read.parquet(f"{folder}/lengths").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return {"n": n, "dl": dl, "vectors": int(vectors is not None)}

    def update(self, chunks: DataFrame, gone: DataFrame | None = None, index_key: str = "", project: str = "", vectors: DataFrame | None = None) -> int:
        """Indexes chunks of new and changed documents, and takes out those in `gone` (doc_id).

        chunks: key, doc_id, title, path, text and others, maybe doc_hash; all chunks of their documents. vectors: key and
        embedding. Returns the version. An update with nothing to do makes none.
        """
        own, name = self.newest(), uuid.uuid4().hex[:12]
        hashed = chunks if "doc_hash" in chunks.columns else chunks.withColumn("doc_hash", F.lit(None).cast("string"))
        new = kept(hashed, "segment")
        named = new.select("doc_id").distinct() if gone is None else new.select("doc_id").unionByName(gone.select("doc_id")).distinct()
        dead, lost = self._buried(own, kept(named, "named"), name)
        if not lost and new.isEmpty():
            return own["version"]
        segments, tombs = dict(own["segments"]), dict(own["dead"]) | ({name: lost} if lost else {})
        dims = own["dims"]
        if not new.isEmpty():
            if vectors is not None:
                vectors, dims = self._checked(vectors, dims)
            postings, lengths = stored_postings(new)
            lengths = lengths.join(new.select("key", "doc_id", "doc_hash"), "key")
            segments[name] = self._write(name, new, postings, lengths, vectors)
        own = {"segments": segments, "dead": tombs, "dims": dims}
        own = self._merged(own)
        version = {"version": (self.generations() or [0])[-1] + 1, "format": FORMAT, "built_at": datetime.now(UTC).isoformat(), "index_key": index_key, "project": project, **own, **self._sums(own)}
        try:
            self.versions.write(f"{version['version']:08d}.json", json.dumps(version))
        except Exception as e:
            raise Superseded(f"version {version['version']} is published already") from e
        self.prune()
        return version["version"]

    def _checked(self, vectors: DataFrame, dims: int | None) -> tuple[DataFrame, int | None]:
        dims = dims or vectors.select(F.max(F.size("embedding"))).first()[0]
        same = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<float>"))
        return vectors.select("key", same.alias("embedding")), dims

    def _buried(self, own: dict[str, Any], documents: DataFrame, name: str) -> tuple[DataFrame | None, dict[str, list[int]]]:
        """Writes the live rows of `documents` as a dead table; the number and summed length of rows by segment."""
        rows = self.live(own, "lengths")
        if rows is None:
            return None, {}
        found = kept(rows.join(documents, "doc_id", "left_semi").select("segment", "key", "dl"), "dead")
        counts = {r[0]: [r[1], r[2]] for r in found.groupBy("segment").agg(F.count("*"), F.sum("dl")).collect()}  # a row a segment
        if counts:
            found.select("segment", "key").write.parquet(f"{self.path}/dead-{name}")
        return found, counts

    def _left(self, own: dict[str, Any], segment: str) -> tuple[int, int]:
        """Live chunks of a segment and their summed length, by subtraction."""
        lost = [by[segment] for by in own["dead"].values() if segment in by]
        return own["segments"][segment]["n"] - sum(x[0] for x in lost), own["segments"][segment]["dl"] - sum(x[1] for x in lost)

    def _sums(self, own: dict[str, Any]) -> dict[str, Any]:
        left = [self._left(own, s) for s in own["segments"]]
        n, dl = sum(x[0] for x in left), sum(x[1] for x in left)
        return {"n": n, "dl": dl, "avgdl": dl / n if n else 1.0}

    def _merged(self, own: dict[str, Any]) -> dict[str, Any]:
        """`own` with full size classes merged, smallest first; segments without live rows go."""
        own = own | {"segments": {s: v for s, v in own["segments"].items() if self._left(own, s)[0]}}
        while True:
            classes: dict[int, list[str]] = {}
            for s in own["segments"]:
                classes.setdefault(size_class(self._left(own, s)[0], self.fan), []).append(s)
            full = next((v for _, v in sorted(classes.items()) if len(v) >= self.fan), None)
            if full is None:
                break
            name = uuid.uuid4().hex[:12]
            take = {t: self.live(own, t, full).drop("segment") for t in ("chunks", "postings", "lengths")}
            vectors = [s for s in full if own["segments"][s]["vectors"]]
            made = self._write(name, *take.values(), self.live(own, "vectors", vectors) if vectors else None)
            own = own | {"segments": {s: v for s, v in own["segments"].items() if s not in full} | {name: made}}
        dead = {d: {s: x for s, x in by.items() if s in own["segments"]} for d, by in own["dead"].items()}
        return own | {"dead": {d: by for d, by in dead.items() if by}}

    def prune(self) -> None:
        """Deletes versions past the last KEPT that no lease holds, and folders that no version is left for."""
        numbers, held = self.generations(), self.leases.held()
        stay = [n for n in numbers if n in numbers[-KEPT:] or n in held]
        for n in set(numbers) - set(stay):
            self.versions.delete(f"{n:08d}.json")
        alive = {name for n in stay for own in (self.manifest(n),) for name in (*(f"segment-{s}" for s in own["segments"]), *(f"dead-{d}" for d in own["dead"]))}
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith(("segment-", "dead-")) and name not in alive:
                self._fs.delete(status.getPath(), True)


class SegmentSnapshot:
    """One version, pinned: live rows of all its segments as whole tables, and the totals that ranking needs."""

    def __init__(self, store: SegmentStore, manifest: dict[str, Any], lease=None):
        if manifest["format"] != FORMAT:
            raise ValueError("the index has another format: build it again")
        self.manifest, self.number, self.lease = manifest, manifest["version"], lease
        empty = {"chunks": "key string, doc_id string, source_id string, path string, title string, kind string, text string", "postings": "term string, key string, tf int", "lengths": "key string, dl int"}
        for name, schema in empty.items():
            rows = store.live(manifest, name)
            setattr(self, name, store.spark.createDataFrame([], schema) if rows is None else rows.drop("segment"))
        own = [s for s, v in manifest["segments"].items() if v["vectors"]]
        self.vectors = store.live(manifest, "vectors", own).drop("segment") if own else None
        self.totals = (manifest["n"], manifest["avgdl"])

    def is_stale(self, index_key: str) -> bool:
        return bool(index_key and self.manifest["index_key"] and index_key != self.manifest["index_key"])


def changes(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents to index and documents to take out: docs (doc_id, hash and others) against what is indexed (doc_id, hash)."""
    same = known.select("doc_id", "hash").where("hash is not null")
    return docs.join(same, ["doc_id", "hash"], "left_anti"), known.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


__all__ = ["FAN", "SECONDS", "SegmentSnapshot", "SegmentStore", "changes", "size_class"]
