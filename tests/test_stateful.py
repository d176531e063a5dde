"""Streams with state: what comes late, twice or after a restart."""

from __future__ import annotations

import datetime as dt

from evisieve.streaming import stateful
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def at(minute: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run(spark, folder, out, checkpoint, batches: list[list[tuple]]) -> int:
    """Feeds batches one by one, each with a new query on the same checkpoint; returns the number of late rows."""
    late = 0
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(folder)
        stream = stateful.once(spark.readStream.schema(EVENT).parquet(folder), "event_id", "ts", "10 minutes")
        query = stateful.paths(stream, 5).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        late += stateful.late_rows(query)
    return late


def test_sessions_wait_for_the_watermark_and_bridge(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "c"))
    first = [(1, at(0), 7, "a", 1.0), (2, at(8), 7, "c", 1.0), (3, at(1), 8, None, None), (4, None, 7, "x", 1.0), (5, at(0), None, "x", 1.0)]
    bridge = [(6, at(4), 7, "b", 0.5), (1, at(0), 7, "a", 1.0)]  # joins the two sessions of user 7; event 1 comes again
    late = run(spark, folder, out, checkpoint, [first, bridge, [(10, at(40), 9, "z", 0.0)], [(11, at(2), 7, "late", 0.0)], [(12, at(90), 9, "y", 0.0)], [(13, at(200), 9, "y", 0.0)]])
    got = {(r.user_id, r.start, r.end, r.n, r.total, r.path) for r in spark.read.parquet(out).collect()}
    assert {g for g in got if g[0] != 9} == {(7, at(0), at(13), 3, 2.5, "a>b>c"), (8, at(1), at(6), 1, 0.0, "")}
    assert (9, at(40), at(45), 1, 0.0, "z") in got and late >= 1
    batch = stateful.paths(stateful.once(spark.createDataFrame([*first, *bridge], EVENT), "event_id", "ts", "1 day"), 5)
    assert {(r.user_id, r.n, r.path) for r in batch.collect()} == {(7, 3, "a>b>c"), (8, 1, "")}


def test_counts_of_a_stream_survive_a_restart(spark, tmp_path):
    folder, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    schema = "key string, title string, path string, text string"
    rows = [("k1", "T", "p/x.py", "alpha beta alpha fooBar"), ("k2", "T2", "p/y.py", "beta"), ("k3", None, None, None), ("k4", "alpha", "q", "")]
    for i, own in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        stateful.keep_latest(stateful.term_counts(stream), f"{out}/t", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        stateful.keep_latest(stateful.length_totals(stream), f"{out}/l", f"file://{tmp_path}/d").trigger(availableNow=True).start().awaitTermination()
        table = spark.createDataFrame(rows[: 2 + 2 * i], schema)
        assert sorted(map(tuple, stateful.latest(spark, f"{out}/t", "term").select("term", "df", "cf").collect())) == sorted(map(tuple, stateful.term_counts(table).select("term", "df", "cf").collect()))
        assert tuple(stateful.latest(spark, f"{out}/l").select("n", "dl").first()) == tuple(stateful.length_totals(table).first())
    assert stateful.latest(spark, f"{out}/t", "term").where(F.col("term") == "alpha").first()["df"] == 2


def test_documents_arrive_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Each of the three batches has as many files as its documents ask for, so no task reads a third of the table."""
    from evisieve.plans import forms

    spark.range(600).selectExpr("id as doc_id", "concat('word ', id) as text", "'en' as lang", "'s' as source").write.parquet(f"{tmp_path}/documents.parquet")
    made, workspace = [], forms.workspace
    monkeypatch.setattr(forms, "workspace", lambda s, name: (made.append((name, workspace(s, name))), made[-1][1])[1])
    monkeypatch.setattr(forms, "_PER_FILE", 50)
    got = {r["term"]: (r["df"], r["cf"]) for r in forms.streamed_counts(spark, str(tmp_path)).collect()}
    assert got["word"] == (600, 600) and got[None][0] == 600
    files = spark.read.parquet(dict(made)["replay"]).selectExpr("_metadata.file_path as f").groupBy("f").count().collect()
    assert len(files) >= 12 and max(r["count"] for r in files) < 120
