"""Vectors of chunks by a function that the caller provides: masked, cut, batched, cached and normalised."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redact import redact

MOST_CHARS, BATCH = 8000, 96
Embed = Callable[..., list[list[float]]]


def cache_key(provider: str, model: str, dims: int, text_hash: str) -> str:
    """Vectors are kept by what made them and by the text's hash."""
    return sha256(f"{provider}|{model}|{dims}|{text_hash}".encode()).hexdigest()


def normalised(vectors: list[list[float]], dims: int) -> np.ndarray:
    out = np.array(vectors, dtype=np.float64)
    if out.ndim != 2 or out.shape[1] != dims:
        raise ValueError(f"vectors must have {dims} numbers")
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def embed_chunks(chunks: DataFrame, embed: Embed, dims: int, allowed: bool, cache: DataFrame | None = None) -> DataFrame:
    """key, hash and embedding of chunks (key, hash, text). Texts leave the cluster only if `allowed`.

    Of equal texts one is embedded; cached ones (hash, embedding) aren't.
    """
    if not allowed:
        raise PermissionError("security.allow_embedding_upload is off")
    todo = chunks.select("hash", "text").dropDuplicates(["hash"])
    if cache is not None:
        todo = todo.join(cache.select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, texts = (c.to_pylist() for c in batch.columns)
            for i in range(0, len(texts), BATCH):
                part = [(redact(t)[0] or "")[:MOST_CHARS] for t in texts[i : i + BATCH]]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[i : i + BATCH]), pa.array(list(normalised(embed(part), dims)), pa.list_(pa.float32()))], names=["hash", "embedding"])

    made = todo.mapInArrow(run, "hash string, embedding array<float>")
    known = made if cache is None else made.unionByName(cache.select("hash", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["hash"]))
    return chunks.select("key", "hash").join(known, "hash")


BUCKETS = 64


class VectorCache:
    """Vectors by hash, in a folder that is a bucketed table: joins with it shuffle the other side alone, into its buckets.

    The number of buckets is part of the folder's name, as a table can't change it; the larger the cache is meant to grow, the
    more. Each append adds a file a bucket at most.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, f"{path.rstrip('/')}/buckets-{buckets}"
        self.buckets = buckets
        self.name = f"evisieve_vectors_{sha256(self.path.encode()).hexdigest()[:16]}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (hash STRING, embedding ARRAY<FLOAT>) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Adds hashes that the cache doesn't hold; of equal ones one."""
        new = rows.select("hash", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["hash"])
        new = new.join(self.read().select("hash"), "hash", "left_anti")
        new.repartition(self.buckets, "hash").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
