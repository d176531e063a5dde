"""Registered queries against their SQL and contracts, and the pipeline against plain Python, on the smallest tables."""

from __future__ import annotations

import numbers
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


def rows_of(frame) -> list[str]:
    import pandas as pd

    cell = lambda v: None if pd.isna(v) else float(round(v, 6)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)
    return sorted(str(tuple(map(cell, r))) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", ["op6_near_duplicates", "op7_substrings", "op8_quality", "op9_decontamination", "op10_warc", "op11_earlier_words", "op12_prefix_trie", "op13_manifest"])
def test_query_equals_its_sql(spark, name):
    import duckdb
    from evisieve.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, str(DATA)).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", ["op1_secrets", "op2_toxicity", "op3_language", "op4_sharding", "op5_bpe"])
def test_query_has_a_row_per_document(spark, name):
    from evisieve.llm import queries

    got = queries.queries()[name](spark, str(DATA))
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


def test_toxic_labels_are_found(spark):
    from evisieve.llm import queries

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    joined = queries.op2_toxicity(spark, str(DATA)).join(labels, "doc_id").toPandas()
    assert (joined["toxic_x" if "toxic_x" in joined else "toxic"].iloc[:, 0].astype(int) == joined["toxic"].iloc[:, 1]).mean() > 0.95


def test_languages_of_held_out_documents(spark):
    from evisieve.llm import queries

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    held = queries.op3_language(spark, str(DATA)).where("held_out").join(docs, "doc_id").where("lang is not null").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95


def test_pipeline_stages_equal_plain_python(spark):
    import corpus_pipeline
    from evisieve.llm import langid, queries, secrets

    from test_llm_operators import brute_components, brute_hits

    docs = queries.table(spark, str(DATA), "documents")
    columns = docs.columns
    bench = [(r[0], r[1]) for r in queries.table(spark, str(DATA), "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, str(DATA)), "test")
        after = {r["doc_id"]: r for r in docs.collect()}
        ids = sorted(before)
        if name == "language_id":
            und = {i for i in ids if not any(map(str.isalpha, before[i]["text"] or ""))}
            assert set(after) <= set(ids) - und and len(after) >= 0.97 * (len(ids) - len(und))
            assert langid.UNKNOWN not in after
        elif name == "near_dedup":
            want = brute_components([before[i]["text"] for i in ids], 5, 80, 100)
            assert set(after) == {i for k, (i, (_, c)) in enumerate(zip(ids, want)) if c == k}
        elif name == "decontamination":
            want = brute_hits([before[i]["text"] for i in ids], bench, 13)
            assert set(after) == {i for i, w in zip(ids, want) if not w[3] and w[4] < 13}
        elif name == "secret_scan":
            assert set(after) == set(ids)
            for i in ids:
                spans = secrets.find_secrets(before[i]["text"])
                assert after[i]["text"] == (secrets.redact(before[i]["text"], spans) if spans else before[i]["text"])
        if name != "bpe":
            assert docs.columns == columns
            assert name == "secret_scan" or all(after[i] == before[i] for i in after)
    assert set(after) == set(before) and "n_tokens" in docs.columns
    assert corpus_pipeline.run(spark, str(DATA)).count() == len(after)


def test_a_passage_in_a_long_document_is_found(spark):
    import corpus_pipeline

    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    passage = max((r["text"] for r in bench), key=len)
    filler = " ".join(f"filler{i}" for i in range(30_000))
    rows = [(1, f"{filler} {passage} {filler}"), (2, filler), (3, f"{filler} {' '.join(passage.split()[:9])} {filler}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in corpus_pipeline.drop_contaminated(spark, docs, str(DATA)).collect()] == [2, 3] or len(passage.split()) < 13


def test_rows_that_share_an_id_keep_their_texts(spark):
    import corpus_pipeline

    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, one), (1, other), (1, one), (2, one), (3, " ".join(f"c{i}" for i in range(40)))], "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(DATA)).collect()]
    assert sorted(got) == sorted([(1, one), (1, other), (3, " ".join(f"c{i}" for i in range(40)))])


def test_stages_take_nulls_extra_columns_and_nothing(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, id string, kept boolean, redacted string"
    words = "the quick brown fox jumps over the lazy dog and then some more words follow here".split()
    text = " ".join(words * 3)
    rows = [(i, f"{text} {i}", "en", "s", 1, 0.5, "x", "y", False, "z") for i in range(8)]
    rows += [(None, text, None, None, None, None, None, None, None, None), (20, None, None, None, None, None, None, None, None, None), (21, "", "en", "s", 0, None, None, None, None, None), (22, text + " token = abcdefgh", "en", "s", 1, None, None, None, None, None), (22, text + " token = abcdefgh", "en", "s", 1, None, None, None, None, None)]
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, str(DATA)), "test")
            assert name == "bpe" or docs.columns == [c.split()[0] for c in schema.split(", ")]
            if name == "secret_scan" and own:
                assert not [r for r in docs.collect() if "abcdefgh" in (r["text"] or "")]
        docs.count()
