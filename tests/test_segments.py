"""Segments of an index against one that is built whole, and leases of its readers."""

from __future__ import annotations

import random

import pytest
from evisieve.engine import Engine
from evisieve.operators import index, leases, ranking, segments
from pyspark.sql import functions as F

CHUNK = "key string, doc_id string, source_id string, path string, title string, kind string, text string"
WORDS = [f"w{i}" for i in range(40)]


def chunks(spark, docs: dict[str, list[str]]):
    rows = [(f"{d}#{i:03d}", d, "s", f"p{d}", "t", "doc", text) for d, texts in docs.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)


def prose(rng: random.Random) -> list[str]:
    return [" ".join(["common", *rng.choices(WORDS, k=rng.randrange(1, 40))]) for _ in range(rng.randrange(1, 4))]


def found(spark, now) -> list[tuple]:
    terms = spark.createDataFrame([("q1", "w1", 1.0), ("q1", "w2", 2.0), ("q2", "common", 1.0), ("q2", "w7", 1.0)], "query_id string, term string, weight double")
    return sorted(map(tuple, ranking.bm25(now.postings, now.lengths, terms, None, 1000, now.totals).collect()))


def test_updates_equal_a_whole_build(spark, tmp_path):
    rng = random.Random(2)
    store = segments.SegmentStore(spark, f"file://{tmp_path}/i", fan=3)
    with pytest.raises(FileNotFoundError):
        store.open()
    docs = {f"d{i}": prose(rng) for i in range(40)}
    assert store.update(chunks(spark, docs)) == 1
    for step in range(7):
        changed = {f"d{rng.randrange(60)}": prose(rng) for _ in range(4)}
        gone = [d for d in rng.sample(sorted(docs), 2) if d not in changed]
        docs = {d: t for d, t in (docs | changed).items() if d not in gone}
        assert store.update(chunks(spark, changed), spark.createDataFrame([(g,) for g in [*gone, "never there"]], "doc_id string")) == step + 2
        now = store.open()
        assert now.manifest["n"] == sum(map(len, docs.values())) == now.chunks.count()
        assert now.manifest["dl"] == now.lengths.agg(F.sum("dl")).first()[0]
        classes = [segments.size_class(store._left(now.manifest, s)[0], 3) for s in now.manifest["segments"]]
        assert max(map(classes.count, classes)) < 3
    whole = index.IndexStore(spark, f"file://{tmp_path}/w")
    whole.build(chunks(spark, docs))
    assert found(spark, store.open()) == found(spark, whole.open()) == found(spark, store.open())
    assert sorted(map(tuple, store.open().chunks.select("key", "text").collect())) == sorted(map(tuple, chunks(spark, docs).select("key", "text").collect()))
    # What no version names is deleted.
    names = {p.name for p in (tmp_path / "i").iterdir()}
    kept = [store.manifest(n) for n in store.generations()]
    assert len(kept) == index.KEPT and {n for n in names if n.startswith(("segment-", "dead-"))} == {x for m in kept for x in (*(f"segment-{s}" for s in m["segments"]), *(f"dead-{d}" for d in m["dead"]))}
    assert store.update(chunks(spark, {})) == 8  # nothing to do, no version
    store.update(chunks(spark, {}), spark.createDataFrame([(d,) for d in docs], "doc_id string"))
    assert store.open().manifest["n"] == 0 == store.open().chunks.count() and found(spark, store.open()) == []


def test_an_update_of_one_hundredth_writes_one_hundredth(spark, tmp_path):
    rng = random.Random(3)
    store = segments.SegmentStore(spark, f"file://{tmp_path}/i")
    store.update(chunks(spark, {f"d{i}": prose(rng) for i in range(1000)}))
    first = store.newest()["segments"]
    store.update(chunks(spark, {f"d{i}": prose(rng) for i in range(0, 1000, 100)}))
    now = store.newest()
    added = set(now["segments"]) - set(first)
    assert set(first) <= set(now["segments"]) and len(added) == 1 and sum(now["segments"][s]["n"] for s in added) <= 30


def test_a_word_of_every_chunk_spreads(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        rows = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.explode(F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id") % 4000))).alias("term"), F.lit(1).alias("tf"))
        sizes = [r[1] for r in index.arranged(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 15 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("kind", ["generations", "segments"])
def test_a_reader_finishes_while_others_build(spark, tmp_path, kind):
    rng = random.Random(4)
    store = (index.IndexStore if kind == "generations" else segments.SegmentStore)(spark, f"file://{tmp_path}/i")
    build = lambda: (store.build if kind == "generations" else store.update)(chunks(spark, {f"d{i}": prose(rng) for i in range(5)}))
    build()
    reader, before = store.open(60), None
    before = found(spark, reader)
    for _ in range(3):
        build()
    assert store.generations() == [1, 3, 4] and found(spark, reader) == before
    reader.lease.release()
    build()
    assert store.generations() == [4, 5]


def test_leases_end_and_are_renewed(spark, tmp_path):
    own = leases.Leases(spark, f"file://{tmp_path}/i")
    assert own.held() == set()
    a, b = own.take(3, 60), own.take(4, -1)
    assert own.held() == {3} and own.held() == {3}
    name = a.name
    a.keep()
    assert a.name == name
    a.seconds = 1000
    a.keep()
    assert a.name != name and own.held() == {3}
    a.release()
    a.release()
    b.release()
    assert own.held() == set()


def test_engine_indexes_what_changed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(6):
        (src / f"f{i}.py").write_text(f"def refund{i}():\n    return 'retry {i}'\n")
    make = lambda w, inc: Engine(spark, f"file://{tmp_path}/{w}", {"sources": [{"id": "r", "type": "local", "path": str(src)}], "retrieval": {"incremental": inc}})
    parts, whole = make("a", True), make("b", False)

    def both(query: str) -> list:
        for e in (parts, whole):
            e.sync()
            e.build_index()
        a, b = ([(h["path"], h["start"], h["text"], h["score"]) for h in e.search(query)] for e in (parts, whole))
        assert a == b
        return [x[0] for x in a]

    assert "f3.py" in both("refund3 retry")
    (src / "f3.py").write_text("x = 'nothing of it'\n")
    (src / "f4.py").unlink()
    (src / "g.py").write_text("def refund9():\n    return 'retry'\n")
    assert set(both("refund3 refund4 refund9 retry")) == {"f0.py", "f1.py", "f2.py", "f5.py", "g.py"}
    version = parts.build_index()
    assert parts.build_index() == version and parts.status()["n"] == whole.status()["n"]
    (src / "f5.py").write_text("\n")  # a document without a chunk leaves the index
    assert "f5.py" not in both("retry")
