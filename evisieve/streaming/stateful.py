"""Streams with state: rows that come twice, sessions with their paths, and term counts that grow with the stream.

Each of them gives, over a stream that is complete and not late, what a batch query gives over the table. State is kept by
key in Spark's state store and restored from the query's checkpoint; the watermark bounds how long it is kept. Rows that come
after the watermark are left out and counted (`late_rows`).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.index import lengths_of, postings_of

PATH = "user_id bigint, start timestamp, end timestamp, n bigint, total double, path string"


def once(rows: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """The first of rows with one key that come within `late` of each other; a batch table keeps one of each."""
    if not rows.isStreaming:
        return rows.dropDuplicates([key])
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def session_rows(events: list[tuple[int, int, str, float]], gap: int) -> Iterator[list[tuple[int, int, str, float]]]:
    """Events of one user in order of (time, id), cut where `gap` microseconds or more lie between two."""
    own: list[tuple[int, int, str, float]] = []
    for event in sorted(events):
        if own and event[0] - own[-1][0] >= gap:
            yield own
            own = []
        own.append(event)
    if own:
        yield own


def _stamp(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def _told(user: int, own: list[tuple[int, int, str, float]], gap: int) -> tuple:
    return user, _stamp(own[0][0]), _stamp(own[-1][0] + gap), len(own), round(sum(e[3] for e in own), 4), ">".join(e[2] for e in own)


def paths(events: DataFrame, gap_minutes: int, late: str | None = None) -> DataFrame:
    """Rows of PATH: a user's sessions with the types of their events in order, which windows can't tell as they don't order.

    events: event_id, ts (timestamp), user_id, event_type, value. A session ends `gap_minutes` after its last event. In a stream it is
    given once the watermark has passed that end, so late events still join or bridge sessions until then; a user's state is
    their open sessions. `late`: the watermark, unless the stream has one already. Null users, times and ids are left out, a
    null type is empty, a null value 0.
    """
    gap = gap_minutes * 60_000_000
    rows = events.where("user_id is not null and ts is not null and event_id is not null").select(F.col("user_id").cast("long").alias("user_id"), "ts", F.col("event_id").cast("long").alias("event_id"), F.coalesce("event_type", F.lit("")).alias("event_type"), F.coalesce("value", F.lit(0.0)).cast("double").alias("value"))
    rows = rows.withColumn("us", F.unix_micros("ts"))
    names = ["us", "event_id", "event_type", "value"]
    columns = [f.split()[0] for f in PATH.split(", ")]
    listed = lambda frame: list(zip(*(frame[n].tolist() for n in names)))
    if not events.isStreaming:

        def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_told(key[0], own, gap) for own in session_rows(listed(frame), gap)], columns=columns)

        return rows.select("user_id", *names).groupBy("user_id").applyInPandas(whole, PATH)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        held = [(us, i, kind, value) for us, i, kind, value in held]
        for frame in frames:
            held += listed(frame)
        passed = state.getCurrentWatermarkMs() * 1000
        done, left = [], []
        for own in session_rows(held, gap):
            (done if own[-1][0] + gap <= passed else left).append(own)
        if left:
            state.update(tuple(map(list, zip(*(e for own in left for e in own)))))
            # The next end of a session; one that has passed already is met by the next batch.
            state.setTimeoutTimestamp(max(min(own[-1][0] + gap for own in left) // 1000 + 1, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame([_told(key[0], own, gap) for own in done], columns=columns)

    kept = "us array<bigint>, event_id array<bigint>, event_type array<string>, value array<double>"
    return (rows.withWatermark("ts", late) if late else rows).groupBy("user_id").applyInPandasWithState(step, PATH, kept, "append", GroupStateTimeout.EventTimeTimeout)


def term_counts(chunks: DataFrame) -> DataFrame:
    """term, df and cf of chunks (key, title, path, text), as they grow: in a stream each batch gives the terms it changed."""
    return postings_of(chunks).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")) if not chunks.isStreaming else _streamed(chunks)


def _streamed(chunks: DataFrame) -> DataFrame:
    """The same with one stateful sum: a chunk's own counts are made within its row, so state is kept by term alone."""
    from ..functions.text import tokens
    from ..operators.index import HEAD_WEIGHT

    rows = chunks.select(tokens(F.col("text")).alias("body"), tokens(F.concat_ws(" ", "title", "path")).alias("head"))
    part = lambda terms, weight, new: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"), F.lit(new).alias("new")))
    # Each token with its weight, and each distinct one once more to count the chunk.
    every = F.concat(part(F.col("body"), 1, 0), part(F.col("head"), HEAD_WEIGHT, 0), part(F.array_distinct(F.concat("body", "head")), 0, 1))
    return rows.select(F.inline(every)).groupBy("term").agg(F.sum("new").alias("df"), F.sum("w").alias("cf"))


def length_totals(chunks: DataFrame) -> DataFrame:
    """n and dl: number of chunks and summed length so far; sums of each batch are combined before they meet the state."""
    return lengths_of(chunks).agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))


def keep_latest(rows: DataFrame, path: str, checkpoint: str) -> Any:
    """Writes each batch's changed rows under its number; a batch that is run again replaces itself. The caller triggers and starts it."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """Of rows with one key those of the last batch that changed it; without a key the last row."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(*(F.max_by(c, "batch").alias(c) for c in values))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark, over the batches that the query reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
