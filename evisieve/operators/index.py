"""The inverted index: postings, lengths and statistics, published in generations."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import give_back, ranges
from ..functions.text import count_terms, tokens
from .leases import SECONDS, Lease, Leases
from .tables import bucketed, kept

FORMAT, HEAD_WEIGHT, KEPT, LEASE_SECONDS = 2, 3, 2, SECONDS
#: So many terms of a batch of queries are broadcast; more are joined by shuffle.
MOST_WANTED = 200_000


#: Stands for a chunk as a whole among its postings; no token is empty.
WHOLE = ""


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of counted(), those of a part of a batch by term, so that sorting them later merges runs."""
    for batch in batches:
        for at, n in ranges(batch.columns):
            part, terms, tf, sizes = batch.slice(at, n), [], [], []
            for body, head in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                counts: dict[str, int] = {}
                dl = count_terms(counts, body)
                count_terms(counts, head, HEAD_WEIGHT)
                terms += counts
                tf += counts.values()
                terms.append(WHOLE)
                tf.append(dl)
                sizes.append(len(counts) + 1)
            found = pa.array(terms, pa.string()).dictionary_encode()
            places = np.empty(len(found.dictionary), np.int32)  # sorted as numbers: a part holds most terms many times
            places[pc.array_sort_indices(found.dictionary).to_numpy()] = np.arange(len(places), dtype=np.int32)
            order = np.argsort(places[found.indices.to_numpy()], kind="stable")
            rows = pa.array(np.repeat(np.arange(n), sizes)[order])
            yield pa.RecordBatch.from_arrays([part.column(0).take(rows), found.dictionary.take(found.indices.take(pa.array(order))), pa.array(np.array(tf, np.int32)[order])], names=["key", "term", "tf"])
    give_back()


def counted(chunks: DataFrame, key: str = "key", head: Column | None = None) -> DataFrame:
    """key, term, tf: a body token counts 1, a token of title and path HEAD_WEIGHT; and a row with term WHOLE of each chunk, its tf the number of body tokens.

    One pass: a chunk's tokens are counted in the task that reads it, so occurrences are never rows.
    """
    rows = chunks.select(F.col(key).alias("key"), F.col("text").alias("body"), (F.concat_ws(" ", "title", "path") if head is None else head).alias("head"))
    return rows.mapInArrow(_count, f"key {rows.schema['key'].dataType.simpleString()}, term string, tf int")


def _summed(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per (key, term): nothing to do unless chunks share a key."""
    if keys.groupBy("key").count().where("count > 1").isEmpty():
        return postings.select("term", "key", "tf")
    return postings.groupBy("key", "term").agg(F.sum("tf").cast("int").alias("tf")).select("term", "key", "tf")


def postings_of(chunks: DataFrame, key: str = "key", head: Column | None = None) -> DataFrame:
    """term, key, tf of counted(), without rows of whole chunks; chunks of one key are summed."""
    return _summed(counted(chunks, key, head).where(F.col("term") != WHOLE), chunks.select(F.col(key).alias("key")))


def stored_postings(chunks: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """postings_of() and lengths_of() by one pass over the texts of a stored table, stored."""
    rows = kept(counted(chunks, key), "counted")
    return _summed(postings_in(rows), chunks.select(F.col(key).alias("key"))), lengths_in(rows)


def written_postings(chunks: DataFrame, path: str) -> DataFrame:
    """counted() of a stored table's chunks as rows of an index, written once, a file's by term; chunks of one key are summed, but not their rows of WHOLE."""
    if chunks.groupBy("key").count().where("count > 1").isEmpty():
        rows = by_term(counted(chunks).select("term", "key", "tf"))
    else:
        rows = kept(counted(chunks), "counted")
        rows = arranged(_summed(postings_in(rows), chunks.select("key")).unionByName(rows.where(F.col("term") == WHOLE)))
    rows.write.mode("overwrite").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def postings_in(rows: DataFrame) -> DataFrame:
    """Postings among the rows of an index or of counted(); older indexes have no others."""
    return rows.where(F.col("term") != WHOLE)


def lengths_in(rows: DataFrame) -> DataFrame:
    """lengths_of() from such rows."""
    return rows.where(F.col("term") == WHOLE).select("key", F.greatest("tf", F.lit(1)).alias("dl"))


def totals_of(chunks: DataFrame, key: str = "key") -> DataFrame:
    """n, avgdl (null without chunks) and number of distinct terms, by one pass over the texts."""
    by_term = counted(chunks, key).groupBy("term").agg(F.count("*").alias("n"), F.sum(F.greatest("tf", F.lit(1))).alias("sum"))
    whole = lambda c: F.max(F.when(F.col("term") == WHOLE, F.col(c)))
    return by_term.agg(F.coalesce(whole("n"), F.lit(0)).alias("n"), (whole("sum") / whole("n")).alias("avgdl"), F.count_if(F.col("term") != WHOLE).alias("terms"))


#: Chunks a bucket of scoring_postings() holds.
PER_BUCKET = 8192


def scoring_postings(chunks: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """key, term, tf and dl of the `wanted` terms (term, a batch's distinct ones), and a row with term WHOLE of each chunk.

    For a batch of queries over a table that has no index: chunks are tokenised once, other words end in the task that reads them, and
    what is left is shuffled once, into a table bucketed by key. Scores of a chunk are summed in its bucket then, without
    another shuffle. A bucket has PER_BUCKET chunks or so, whatever the size. Chunks without a key are counted, under null.
    """
    spark = chunks.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chunks.count() // PER_BUCKET))
    rows = chunks.select(F.col(key).alias("key"), tokens(F.col("text")).alias("body"), tokens(F.concat_ws(" ", "title", "path")).alias("head"))
    rows = rows.select("key", F.size("body").alias("n"), F.posexplode(F.concat("body", "head", F.array(F.lit(WHOLE)))).alias("at", "term"))
    marked = kept(wanted.select("term").union(spark.range(1).select(F.lit(WHOLE))), "wanted")
    rows = rows.join(F.broadcast(marked) if marked.count() <= MOST_WANTED else marked, "term", "left_semi")
    rows = rows.select("key", "term", F.when(F.col("at") < F.col("n"), 1).otherwise(HEAD_WEIGHT).alias("w"), "n").repartition(buckets, "key")
    sums = rows.groupBy("key", "term").agg(F.sum("w").cast("int").alias("tf"), F.greatest(F.max("n"), F.lit(1)).alias("dl"))
    return bucketed(sums, "postings", buckets, "key")


def by_term(postings: DataFrame) -> DataFrame:
    """Postings of a task by term, for rows that are by chunk already, as those of counted()."""
    return postings.sortWithinPartitions("term", "key")


def arranged(postings: DataFrame) -> DataFrame:
    """Postings by chunk, those of a file by term: a word that every chunk holds is in all files, in each a range of rows of its own."""
    return by_term(postings.repartition("key"))


def lengths_of(chunks: DataFrame, key: str = "key") -> DataFrame:
    """key and dl: the number of body tokens, 1 at least."""
    return chunks.select(F.col(key).alias("key"), F.greatest(F.size(tokens(F.col("text"))), F.lit(1)).alias("dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    """term, df (chunks that hold it) and cf (weighted occurrences)."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def source_stats(chunks: DataFrame) -> DataFrame:
    """source_id, chunks, documents and a map of chunks by kind."""
    kinds = chunks.groupBy("source_id", "kind").agg(F.count("*").alias("n"))
    by_kind = kinds.groupBy("source_id").agg(F.sum("n").alias("chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    return by_kind.join(chunks.groupBy("source_id").agg(F.countDistinct("doc_id").alias("documents")), "source_id")


class Superseded(RuntimeError):
    """Another build published a newer generation meanwhile."""


class IndexStore:
    """Generations of an index under one folder that any Hadoop file system may hold.

    A generation is visible once its manifest exists; readers pin one, so a new build never changes what they
    see. Builders claim a number by creating its folder exclusively.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.leases = Leases(spark, self.path)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        root = self._path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []

    def generations(self) -> list[int]:
        """Published ones, ascending."""
        return sorted(int(n[9:13]) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def build(self, chunks: DataFrame, index_key: str = "", project: str = "", vectors: DataFrame | None = None) -> int:
        """Writes and publishes the next generation; older ones than the last KEPT go, but for those that leases hold."""
        claimed = [int(n[4:]) for n in self._names() if n.startswith("gen=")]
        number = max([0, *claimed, *self.generations()]) + 1
        while not self._fs.createNewFile(self._path(f"{self.path}/gen={number:04d}/_claim")):
            number += 1
        folder = f"{self.path}/gen={number:04d}"
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
        chunks = self.spark.read.parquet(f"{folder}/chunks")
        rows = written_postings(chunks, f"{folder}/postings")
        lengths_in(rows).write.mode("overwrite").parquet(f"{folder}/lengths")
        dims = None
        if vectors is not None:
            dims = vectors.select(F.max(F.size("embedding"))).first()[0]
            vectors.select("key", F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<float>")).alias("embedding")).write.mode("overwrite").parquet(f"{folder}/vectors")
        n, avgdl = self.spark.read.parquet(f"{folder}/lengths").agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(1.0))).first()
        terms = postings_in(rows).select("term").distinct().count()
        by_source = {r["source_id"]: {"chunks": r["chunks"], "documents": r["documents"]} for r in source_stats(chunks).collect()} if "source_id" in chunks.columns else {}
        if any(g > number for g in self.generations()):
            raise Superseded(f"generation {number} is older than a published one")
        manifest = {"format": FORMAT, "built_at": datetime.now(UTC).isoformat(), "n": n, "avgdl": avgdl, "terms": terms, "dims": dims, "index_key": index_key, "project": project, "sources": by_source}
        part, final = self._path(f"{self.path}/manifest-{number:04d}.part"), self._path(f"{self.path}/manifest-{number:04d}.json")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(part, final):
            raise Superseded(f"generation {number} is published already")
        held = self.leases.held()
        for old in [g for g in self.generations()[:-KEPT] if g not in held]:
            self._fs.delete(self._path(f"{self.path}/manifest-{old:04d}.json"), False)
            self._fs.delete(self._path(f"{self.path}/gen={old:04d}"), True)
        return number

    def open(self, lease: float | None = None, attempts: int = 3) -> Snapshot:
        """The newest generation, held by a lease of so many seconds if asked for; tried again if it was pruned meanwhile."""
        for attempt in range(attempts):
            numbers = self.generations()
            if not numbers:
                raise FileNotFoundError(f"no index at {self.path}: build one first")
            held = self.leases.take(numbers[-1], lease) if lease else None
            try:
                return Snapshot(self.spark, self.path, numbers[-1], held)
            except Exception:
                if held:
                    held.release()
                if attempt == attempts - 1 or self.generations()[-1:] == numbers[-1:]:
                    raise
        raise AssertionError


class Snapshot:
    """One generation, pinned."""

    def __init__(self, spark: SparkSession, path: str, number: int, lease: Lease | None = None):
        folder = f"{path}/gen={number:04d}"
        self.number, self.lease = number, lease
        self.manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest-{number:04d}.json").collect()))
        if self.manifest["format"] != FORMAT:
            raise ValueError("the index has another format: build it again")
        self.chunks, self.postings, self.lengths = (spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "postings", "lengths"))
        self.postings = postings_in(self.postings)
        self.vectors = spark.read.parquet(f"{folder}/vectors") if self.manifest["dims"] else None
        self.totals = (self.manifest["n"], self.manifest["avgdl"])

    def is_stale(self, index_key: str) -> bool:
        return bool(index_key and self.manifest["index_key"] and index_key != self.manifest["index_key"])
