"""The audit log of requests: rows that tasks return with their results, and counters that add up.

A Gate notes each request; whoever runs it in a task drains the notes into the rows it returns, so the log of a job is
written once, with the job's output, however often tasks were tried. Summaries of two logs merge to that of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One request: never its query, headers or body.
REQUEST = "ts timestamp, method string, host string, url string, bytes long, status int, ms long"
SUMMARY = ("requests", "failed", "bytes", "ms", "slowest", "first", "last")


def failed(status: Column) -> Column:
    """Requests without an answer (0) or refused by the server."""
    return (status == 0) | (status >= 400)


def summarised(log: DataFrame, *by: str) -> DataFrame:
    """A row per host (and other columns in `by`): number, failures, bytes sent, time taken, and when."""
    status = F.coalesce("status", F.lit(0))
    parts = log.select(
        "host", *by, F.lit(1).cast("long").alias("requests"), failed(status).cast("long").alias("failed"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"),
        F.coalesce("ms", F.lit(0)).cast("long").alias("ms"), F.coalesce("ms", F.lit(0)).cast("long").alias("slowest"), F.col("ts").alias("first"), F.col("ts").alias("last"),
    )
    return merged(parts, *by)


def merged(summaries: DataFrame, *by: str) -> DataFrame:
    """One summary of several (unioned): sums, maxima and ends. Single requests are summaries too."""
    sums = [F.sum(c).alias(c) for c in ("requests", "failed", "bytes", "ms")]
    return summaries.groupBy("host", *by).agg(*sums, F.max("slowest").alias("slowest"), F.min("first").alias("first"), F.max("last").alias("last"))
