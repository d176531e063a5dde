"""Glossary and hybrid search over frames against one query at a time."""

from __future__ import annotations

import random

import duckdb
from evisieve.engine import Engine
from evisieve.functions import glossary
from evisieve.operators import ranking
from evisieve.plans import queries
from pyspark.sql import functions as F


def test_bridge_of_frames_equals_that_of_texts(spark):
    rng = random.Random(8)
    parts = [*glossary.PAIRS, *(w for ws in glossary.PAIRS.values() for w in ws), " ", ".", "_", "x", "LOGIN", "の", "1", "İ", "\n", "lo", "コ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 9))) for _ in range(700)] + [None, "", " ", "あ"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    got: dict = {}
    for r in ranking.query_terms(frame, "id", "q", bridge=True).collect():
        got.setdefault(r.query_id, {})[r.term] = r.weight
    for i, t in enumerate(texts):
        assert got.get(i, {}) == {k: float(w) for k, w in glossary.weighted_terms(t or "").items()}, t


def test_queries_are_weighed_where_they_are_read_and_those_of_one_id_are_added_up(spark):
    texts = ["refund refund 返金 v1.2 fooBar", "login Login. the_log", "ログイン api, 仕様", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    one = ranking.query_terms(frame, "id", "q", bridge=True)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and plan.count("MapInArrow") == 1  # no shuffle, and no row per occurrence
    got = {(r.query_id, r.term): r.weight for r in one.collect()}
    assert got[0, "refund"] == 2.0 and got[0, "v1"] == 1.0 and got[0, "foobar"] == 1.0 and got[0, "reverse"] == 0.55 and got[1, "login"] == 2.0 and got[2, "login"] == 0.55
    more = spark.createDataFrame([(7, "refund"), (7, "refund 返金"), (7, "返"), (None, "api"), (None, "api")], "id int, q string")
    both = {(r.query_id, r.term): r.weight for r in ranking.query_terms(more, "id", "q", bridge=True).collect()}
    assert both[7, "refund"] == 2.0 and both[7, "cancel"] == 0.55 and both[7, "返金"] == 1.0 and both[None, "api"] == 2.0 and both[None, "エンドポイント"] == 0.55
    assert ranking.query_terms(more, "id", "q", bridge=True).count() == len(both)


def test_search_of_many_needs_equals_one_at_a_time(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    rng = random.Random(1)
    words = "refund retry login token cache queue order invoice limit error".split()
    for i in range(30):
        (src / f"{rng.choice(words)}{i}.py").write_text("\n".join(" ".join(rng.choices(words, k=6)) for _ in range(rng.randrange(1, 40))))
    vector = lambda texts, purpose=None: [[float(len(t) % 7), float(t.count("e")), 1.0, float(t.count("r"))] for t in texts]
    e = Engine(spark, f"file://{tmp_path}/w", {"sources": [{"id": "r", "type": "local", "path": str(src)}], "security": {"allow_embedding_upload": True}, "retrieval": {"embedding": {"provider": "test", "model": "m", "dimensions": 4}}}, embed=vector)
    e.sync()
    e.build_index()
    needs = {"a": ["login token"], "b": ["refund retry", "返金"], "c": ["nothing of that"]}
    frame = spark.createDataFrame([(n, str(i), q) for n, qs in needs.items() for i, q in enumerate(qs)], "need_id string, list_no string, text string")
    asked = spark.createDataFrame([(n, i, v) for n, qs in needs.items() for i, v in e._query_vectors({str(i): q for i, q in enumerate(qs)})], "need_id string, list_no string, embedding array<float>")
    every = e.search_all(frame, 5, asked).orderBy("need_id", "rank").collect()
    for n, qs in needs.items():
        alone = [(h["key"], h["score"], h["rank"]) for h in e.search(qs, 5)]
        assert [(r.key, r.score, r["rank"]) for r in every if r.need_id == n] == alone and alone
    assert e.search_all(frame.where("false"), 5, asked.where(F.lit(False))).count() == 0


def long_texts(spark, folder) -> str:
    """Tables of one item and three documents of over 900 tokens; two of them differ only after their first 1,000."""
    same, tails = " ".join(f"w{i}" for i in range(1000)), [" ".join(f"{c}{i}" for i in range(2000)) for c in "xyz"]
    texts = [f"needle needle {same} {tails[0]}", f"needle needle {same} {tails[1]}", f"needle {' '.join(f'v{i}' for i in range(1000))} {tails[2]}"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(7, "needle")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_sql(name: str, folder: str) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.sql(queries.oracle_sql()[name]).fetchall())


def test_hybrid_search_compares_whole_texts(spark, tmp_path):
    folder = long_texts(spark, tmp_path)
    got = queries.queries()["hybrid_search"](spark, folder).orderBy("rank").collect()
    assert [r.key for r in got] == [0, 1, 2]  # by its first 900 tokens the second is a copy of the first, and comes last
    assert sorted((r.need_id, r.key, r.score, r["rank"]) for r in got) == by_sql("hybrid_search", folder)


def test_jaccard_pairs_compare_whole_texts(spark, tmp_path):
    folder = long_texts(spark, tmp_path)
    got = sorted(map(tuple, queries.queries()["jaccard_pairs"](spark, folder).select("query_id", "a", "b", "similarity").collect()))
    assert got == [(7, 0, 1, round(1001 / 5001, 6))] == by_sql("jaccard_pairs", folder)  # by their first 900 tokens, copies of each other
