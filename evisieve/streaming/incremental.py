"""Streaming extension: documents that arrive are chunked and indexed as they come.

Document counts and the mean length change with every batch, so postings and lengths are only appended, each
under its batch, and read as of the last batch when a query runs. A batch that is run again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import Limits, chunk_documents
from ..operators.index import lengths_of, postings_of


def windowed(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """start, event_type, n and total by tumbling windows; `late`: how long to wait for late events in a stream."""
    if late:
        events = events.withWatermark("ts", late)
    sums = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, start, end and n of runs of events that are less than `gap` apart."""
    if late:
        events = events.withWatermark("ts", late)
    runs = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return runs.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def index_batch(docs: DataFrame, batch: int, path: str, limits: Limits = Limits()) -> None:
    """Chunks, postings and lengths of one batch, under its number."""
    chunks = f"{path}/chunks/batch={batch}"
    chunk_documents(docs, limits).withColumn("key", F.concat_ws("#", "doc_id", "chunk_no")).write.mode("overwrite").parquet(chunks)
    own = docs.sparkSession.read.parquet(chunks)
    postings_of(own).write.mode("overwrite").parquet(f"{path}/postings/batch={batch}")
    lengths_of(own).write.mode("overwrite").parquet(f"{path}/lengths/batch={batch}")


def follow(docs: DataFrame, path: str, checkpoint: str, limits: Limits = Limits()):
    """Indexes a stream of documents; returns the writer, which the caller triggers and starts."""
    return docs.writeStream.foreachBatch(lambda df, n: index_batch(df, n, path, limits)).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chunks, postings and lengths so far: of documents that came again, only the last batch counts."""
    chunks, postings, lengths = (spark.read.parquet(f"{path}/{t}") for t in ("chunks", "postings", "lengths"))
    last = chunks.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    keys = chunks.join(last, ["doc_id", "batch"], "left_semi").select("key", "batch")
    live = lambda df: df.join(keys, ["key", "batch"], "left_semi").drop("batch")
    return live(chunks), live(postings), live(lengths)
