"""Chunking, index, ranking, packing, scans, gate, sources and streaming."""

from __future__ import annotations

import json
import math
import random
from collections import Counter, defaultdict

import pytest
from evisieve import engine
from evisieve.functions import text as tx
from evisieve.operators import chunking, gate, index, packing, ranking, scanning
from evisieve.sources import cache, remote, tables
from evisieve.streaming import incremental
from pyspark.sql import functions as F

# Chunking


def test_code_chunks_cover_lines_and_prefer_declarations():
    lines = [f"function f{i}() {{ return {i} }}" if i % 7 == 0 else f"  x{i} = {i}" for i in range(300)]
    pieces = list(chunking.code_pieces("\n".join(lines) + "\n", "a.js"))
    seen = set()
    for p in pieces:
        assert p.text == "\n".join(lines[p.start - 1 : p.end]) and p.end - p.start < 110
        seen |= set(range(p.start, p.end + 1))
    assert seen == set(range(1, 301))
    assert all(p.end % 7 == 0 for p in pieces[:-1]) and pieces[1].title.startswith("a.js › f")


def test_code_chunks_keep_to_characters_and_skip_blanks():
    pieces = list(chunking.code_pieces("\n".join(["x" * 900] * 40), "a"))
    assert all(len(p.text) <= 6000 for p in pieces)
    assert list(chunking.code_pieces("\n\n  \n", "a")) == [] == list(chunking.code_pieces("", "a"))
    assert len(list(chunking.code_pieces("y" * 20_000, "a"))) == 1


@pytest.mark.parametrize(("most", "overlap"), [(300, 60), (500, 100), (700, 0), (1000, 220), (2200, 220)])
def test_text_chunks_equal_their_lines(most, overlap):
    lines = ["# Top", *(f"line {i} marker{i} " + "w" * (i % 40) for i in range(60)), "## Sub", "", "tail"]
    limits = chunking.Limits(text_chars=most, text_overlap=overlap)
    pieces = list(chunking.text_pieces("\n".join(lines), "doc", limits))
    for p in pieces:
        assert not p.partial and p.text == "\n".join(lines[p.start - 1 : p.end]) and len(p.text) <= most
    text = "\n".join(p.text for p in pieces)
    assert all(f"marker{i} " in text for i in range(60))
    assert pieces[-1].title == "doc › Top › Sub"


def test_text_chunks_inside_a_long_line_are_partial():
    pieces = list(chunking.text_pieces("z" * 5000, "d"))
    assert len(pieces) > 1 and all(p.partial for p in pieces) and all(p.start == p.end == 1 for p in pieces)


def test_heading_trail_and_carriage_returns():
    text = "﻿# A\r\nx\n### C\ny\n## B\nz"
    assert [p.title for p in chunking.text_pieces(text, "t")] == ["t › A", "t › A › C", "t › A › B"]


def test_chunk_frame_masks_keys(spark):
    key = "-----BEGIN PRIVATE KEY-----\n" + "K" * 50 + "\n-----END PRIVATE KEY-----"
    rows = [("s:a", "s", "a.md", "doc", f"# T\n{key}\nend"), ("s:b", "s", "b.py", "code", "def f():\n  pass"), ("s:c", "s", "c", "doc", None), ("s:d", "s", "d", "doc", "")]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id string, source_id string, path string, kind string, text string")).collect()
    assert Counter(r["doc_id"] for r in got) == {"s:a": 1, "s:b": 1} and "KKKK" not in got[0]["text"]
    assert {r["doc_id"]: r["end"] for r in got}["s:a"] == 5


# Ranking

CORPUS = {"a": "the retry loop retries a refund payment", "b": "unrelated text about colours and shapes", "c": "返金のリトライ上限は三回", "d": "constructor toString hasOwnProperty", "e": "payment payment payment refund"}


def frames(spark, corpus):
    chunks = spark.createDataFrame([(k, k, "", "", t) for k, t in corpus.items()], "key string, doc_id string, title string, path string, text string")
    return chunks, index.postings_of(chunks), index.lengths_of(chunks)


def model(corpus, terms, top=60):
    toks = {k: tx.py_tokens(t) for k, t in corpus.items()}
    dl = {k: max(1, len(v)) for k, v in toks.items()}
    avg, n, score = sum(dl.values()) / len(dl), len(dl), defaultdict(float)
    for term, w in terms.items():
        df = sum(term in v for v in toks.values())
        if not df or (df / n > 0.6 and len(term) <= 2):
            continue
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        for k, v in toks.items():
            if tf := v.count(term):
                score[k] += (1 + math.log(w)) * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl[k] / avg))
    return sorted(((k, round(s, 9)) for k, s in score.items()), key=lambda x: (-x[1], x[0]))[:top]


@pytest.mark.parametrize("parts", [1, 7])
def test_bm25_equals_a_plain_model(spark, parts):
    rng = random.Random(parts)
    words = [f"w{i}" for i in range(30)]
    corpus = {f"k{i:02}": " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randrange(1, 60))) for i in range(40)} | CORPUS
    queries = {"x": "w1 w2 w29 w29", "y": "refund retry 返金", "z": "constructor", "none": "zzz"}
    _, postings, lengths = frames(spark, corpus)
    terms = ranking.term_frame(spark, queries, bridge=True)
    got = defaultdict(list)
    for r in ranking.bm25(postings.repartition(parts), lengths, terms, top=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["key"], r["score"]))
    for q, text in queries.items():
        want = model(corpus, ranking.weighted_terms(text), 10)
        assert [k for k, _ in got[q]] == [k for k, _ in want]
        assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(got[q], want))


def test_bm25_filter_keeps_global_statistics(spark):
    chunks, postings, lengths = frames(spark, CORPUS)
    terms = ranking.term_frame(spark, {"q": "refund"}, bridge=False)
    every = {r["key"]: r["score"] for r in ranking.bm25(postings, lengths, terms).collect()}
    some = ranking.bm25(postings, lengths, terms, chunks.where("key = 'e'").select("key")).collect()
    assert [(r["key"], r["score"]) for r in some] == [("e", every["e"])]


def test_title_and_path_count_three_times(spark):
    chunks = spark.createDataFrame([("k", "alpha beta", "alpha", "body alpha")], "key string, title string, path string, text string")
    assert {r["term"]: r["tf"] for r in index.postings_of(chunks).collect()} == {"alpha": 7, "beta": 3, "body": 1}


def lists(spark, *ranked):
    rows = [("q", i, kind, k, float(s)) for i, (kind, items) in enumerate(ranked) for k, s in items]
    return spark.createDataFrame(rows, "query_id string, list_no int, kind string, key int, score double")


def test_fusion_expectations(spark):
    fused = ranking.fuse(lists(spark, ("bm25", [(3, 10), (1, 5)]), ("vector", [(1, 0.5), (2, 0.4), (3, 0.3)])))
    assert {r["key"]: r["score"] for r in fused.collect()} == {1: 0.75, 3: 0.5, 2: 0.25}
    tie = ranking.ranked(ranking.fuse(lists(spark, ("bm25", [(7, 2), (4, 2)]))), 5).orderBy("rank").collect()
    assert [r["key"] for r in tie] == [4, 7]
    n = spark.createDataFrame([("q", 2)], "query_id string, n int")
    assert ranking.fuse(lists(spark, ("bm25", [(1, 3)])), n).first()["score"] == 0.5


def test_boosts(spark):
    fused = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 0.45), ("q", 2, 0.3)], "query_id string, key int, score double")
    chunks = spark.createDataFrame([(0, "x", "x", "code", "s"), (1, "y", "y", "code", "s"), (2, "src/refund.js", "t", "code", "s")], "key int, path string, title string, kind string, source_id string")
    terms = spark.createDataFrame([("q", "refund")], "query_id string, term string")
    got = {r["key"]: r["score"] for r in ranking.boosted(fused, chunks, terms).collect()}
    assert got == {0: 1.0, 1: 0.45, 2: 0.405}
    for priority, factor in ((0.0, 1.0), (1.0, 1.15), (-1.0, 0.85), (-10.0, 0.01)):
        assert {r["key"]: r["score"] for r in ranking.boosted(fused, chunks, terms, None, {"s": priority}).collect()}[0] == pytest.approx(factor)


def test_mmr_prefers_distinct_texts():
    same = [{"score": 10, "doc_id": f"d{i}", "tokens": {"a", "b"}, "key": i} for i in range(4)]
    other = [{"score": 5, "doc_id": f"e{i}", "tokens": {f"t{i}", f"u{i}"}, "key": 10 + i} for i in range(4)]
    picked = ranking.mmr(same + other, 5)
    assert sum(p["key"] < 4 for p in picked) == 1 and len(picked) == 5
    assert len(ranking.mmr(same + other[:1], 5)) == 5 and ranking.mmr([], 3) == []


def test_diversified_equals_mmr(spark):
    rng = random.Random(3)
    rows = [("q", f"k{i}", f"d{i % 5}", " ".join(rng.choices(list("abcdefgh"), k=6)) + f" word{i % 4}", float(20 - i)) for i in range(20)]
    scores = spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], "query_id string, key string, score double")
    chunks = spark.createDataFrame([(r[1], r[2], r[3]) for r in rows], "key string, doc_id string, text string")
    got = [r["key"] for r in ranking.diversified(scores, chunks, 6).orderBy("rank").collect()]
    want = ranking.mmr([{"key": r[1], "doc_id": r[2], "tokens": set(tx.py_tokens(r[3])[:900]), "score": r[4]} for r in rows], 6)
    assert got == [w["key"] for w in want]


def test_vector_search(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(9)] + [(20, None), (21, [1.0])]
    vectors = spark.createDataFrame(rows, "key int, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = ranking.vector_search(vectors, queries, 4).orderBy("rank").collect()
    assert [(r["key"], r["score"]) for r in got] == [(2, 2.0), (5, 2.0), (8, 2.0), (1, 1.0)]


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(50)]
    vectors = spark.createDataFrame(rows, "key int, embedding array<double>")
    queries = vectors.where("key < 20").select(F.col("key").alias("query_id"), "embedding")
    whole = sorted(map(tuple, ranking.vector_search(vectors, queries, 3).collect()))
    monkeypatch.setattr(ranking, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, ranking.vector_search(vectors, queries, 3).collect())) == whole and len(whole) == 60


def test_search_plan_has_no_product_and_prunes(spark, tmp_path):
    chunks, *_ = frames(spark, CORPUS)
    chunks.write.parquet(str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c"))
    plan = ranking.bm25(index.postings_of(read), index.lengths_of(read), ranking.term_frame(spark, {"q": "refund"}))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "doc_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_postings_of_a_batch_score_like_the_index_without_another_shuffle(spark):
    rng = random.Random(8)
    rows = [(i, str(i), f"p{i}", " ".join(rng.choice("alpha beta gamma delta common fooBar x1 42".split()) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(300, None, None, None), (301, "alpha", "beta", "")]
    chunks = spark.createDataFrame(rows, "key long, title string, path string, text string")
    asked = spark.createDataFrame([(1, "alpha beta nowhere"), (2, "gamma common foo"), (3, "42 p7")], "id int, text string")
    terms = ranking.query_terms(asked, "id", "text")
    stored = index.scoring_postings(chunks, terms.select("term").distinct())
    lengths = stored.where(F.col("term") == index.WHOLE).select("key", "dl")
    assert sorted(lengths.collect()) == sorted(index.lengths_of(chunks).collect())
    want = ranking.bm25(index.postings_of(chunks), index.lengths_of(chunks), terms, top=40)
    got = ranking.bm25(stored, lengths, terms, top=40)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 80
    allowed = chunks.where("key % 3 = 0").select("key")
    assert sorted(ranking.bm25(stored, lengths, terms, allowed, 9).collect()) == sorted(ranking.bm25(index.postings_of(chunks), index.lengths_of(chunks), terms, allowed, 9).collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "hashpartitioning(key" not in plan  # only what is left for the ranking is shuffled


# Packing


def hit(doc, start, end, text, score=1.0, **more):
    return {"doc_id": doc, "source_id": "s", "source_type": "github", "path": doc, "title": doc, "kind": "code", "url": "u", "version": "v", "start": start, "end": end, "partial": False, "text": text, "score": score, **more}


def test_neighbours_merge_by_lines():
    merged = packing.merge_neighbours([hit("d", 4, 6, "l4\nl5\nl6", 2.0), hit("d", 1, 4, "l1\nl2\nl3\nl4"), hit("d", 7, 8, "l7\n"), hit("d", 12, 12, "l12"), hit("e", 1, 1, "x")])
    assert [(m["doc_id"], m["start"], m["end"], m["text"], m["score"]) for m in merged] == [("d", 1, 8, "l1\nl2\nl3\nl4\nl5\nl6\nl7\n", 2.0), ("d", 12, 12, "l12", 1.0), ("e", 1, 1, "x", 1.0)]
    assert len(packing.merge_neighbours([hit("d", 1, 3, "a\nb\nc"), hit("d", 3, 4, "OTHER\nd")])) == 2
    assert len(packing.merge_neighbours([hit("d", 1, 2, "a\nb", partial=True), hit("d", 2, 3, "b\nc")])) == 2


def test_neighbours_merge_in_a_stream_of_rows(spark):
    """Passages go on over Arrow batches, whatever the rows' order; no group costs a call of its own."""
    rng, rows = random.Random(3), []
    for q in range(12):
        for d in ("d", "e", None):
            for start in sorted(rng.sample(range(1, 40), rng.randrange(1, 9))):
                end = start + rng.randrange(4)
                text = "\n".join(f"l{i}" if rng.random() < 0.9 else "other" for i in range(start, end + 1))
                rows.append({**hit(d, start, end, text, float(rng.randrange(4))), "query_id": q, "partial": rng.random() < 0.1})
    want = sorted(str((q, p["doc_id"], p["start"], p["end"], p["text"], p["score"])) for q in range(12) for d in ("d", "e", None) for p in packing.merge_neighbours([r for r in rows if r["query_id"] == q and r["doc_id"] == d]))
    rng.shuffle(rows)
    frame = packing.merged(spark.createDataFrame(rows, f"query_id int, {packing.HIT}"))
    assert "FlatMapGroups" not in frame._jdf.queryExecution().executedPlan().toString()
    for size in ("1", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(str((r["query_id"], r["doc_id"], r["start"], r["end"], r["text"], r["score"])) for r in frame.collect()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pack_frame_equals_pack(spark):
    rng = random.Random(4)
    for budget in (300, 800, 2000):
        hits = [hit(f"d{i}", 1, 5, "word " * rng.randrange(20, 400) + f"\npassword = \"hunter2{i}xx\"\n\n\n", float(rng.randrange(5))) for i in range(8)]
        pack = packing.build_pack(hits, budget)
        df = spark.createDataFrame([{**h, "query_id": "q"} for h in hits], f"query_id string, {packing.HIT}")
        got = packing.packed(packing.merged(df), budget).orderBy("n").collect()
        assert [(r["id"], r["label"], r["url"], r["truncated"], r["text"]) for r in got] == [(i["id"], i["label"], i["url"], i["truncated"], i["text"]) for i in pack.items]
        assert pack.tokens <= budget + 10 and "hunter2" not in "".join(i["text"] for i in pack.items)
        if got:
            assert packing.evidence_blocks(packing.packed(packing.merged(df), budget)).first()["evidence"] == packing.evidence_block(pack.items)


# Scans


def code(spark, *docs):
    rows = [(f"s:{p}", "s", "github", p, kind, lang, "https://g/" + p, text) for p, kind, lang, text in docs]
    return spark.createDataFrame(rows, "doc_id string, source_id string, source_type string, path string, kind string, lang string, url string, text string")


def test_findings(spark):
    lines = ["const x = eval(input)", 'password = "abcdefghijklmnop"', "password = process.env.PASSWORD_LONG", "// TODO: later", "res.cookie('a', b)", "res.cookie('a', b, {httpOnly: true, secure: true})", "fetch(url)", "  { signal }", "jwt.decode(t)", "jwt.decode(t, verify=True)", "yaml.load(f)", "yaml.load(f, SafeLoader)", "let a: any = 1"]
    docs = code(spark, ("src/a.ts", "code", "ts", "\n".join(lines)), ("test/b.ts", "code", "ts", "eval(x)"), ("c.md", "doc", "md", "eval(x)"), ("d.py", "code", "py", "\n".join(["# TODO: x"] * 30)))
    got = scanning.findings(docs)
    by = {(r["rule_id"], r["path"], r["line"]) for r in got.collect()}
    for rule, line in (("SEC-EVAL", 1), ("SEC-SECRET-GENERIC", 2), ("REL-TODO", 4), ("SEC-JWT-NOVERIFY", 9), ("SEC-DESERIALIZE", 11), ("REL-TS-ANY", 13)):
        assert (rule, "src/a.ts", line) in by
    for rule, line in (("SEC-SECRET-GENERIC", 3), ("SEC-COOKIE-INSECURE", 6), ("REL-NO-TIMEOUT", 7), ("SEC-JWT-NOVERIFY", 10), ("SEC-DESERIALIZE", 12)):
        assert (rule, "src/a.ts", line) not in by
    assert sum(p == "d.py" for _, p, _ in by) == 20 and not any(p in ("test/b.ts", "c.md") for _, p, _ in by)
    row = got.where("rule_id = 'SEC-SECRET-GENERIC'").first()
    assert "abcdefgh" not in row["snippet"] + row["context"] and row["url"].endswith("#L2")
    assert scanning.ordered(got).first()["severity"] == "critical"
    assert {r["severity"] for r in scanning.findings(docs, "high", test_paths=True).collect()} <= {"high", "critical"}
    total = scanning.summary(got).where("severity is null and rule_id is null").first()["n"]
    assert total == got.count()
    assert scanning.summary(got.limit(0)).collect()[0]["n"] == 0


def test_facts(spark):
    package = json.dumps({"name": "n", "dependencies": {"a": "*", "b": "1"}, "devDependencies": {"c": ">=2"}, "scripts": {"t": "x"}})
    docs = code(spark, ("package.json", "config", "json", package), ("yarn.lock", "other", "lock", "x"), ("sub/package.json", "config", "json", "{broken"), (".env.local", "config", "env", "x"), ("Dockerfile", "config", "dockerfile", "FROM x\n USER app"), ("d/Dockerfile", "config", "dockerfile", "USER root"), (".github/workflows/a.yml", "config", "yml", "x"))
    got = {(r["kind"], r["path"]): r["detail"] for r in scanning.facts(docs).collect()}
    assert "a@*" in got["deps-risk", "package.json"] and "c@>=2" in got["deps-risk", "package.json"] and "b@1" not in got["deps-risk", "package.json"]
    assert got["deps", "package.json"].startswith("name=n / dependencies=2 / devDependencies=1")
    assert "present" in got["lockfile", "package.json"] and ("deps", "sub/package.json") not in got
    assert "without" not in got["container", "Dockerfile"] and "without" in got["container", "d/Dockerfile"]
    assert {k for k, _ in got} == {"deps", "deps-risk", "lockfile", "scripts", "secret-file", "container", "ci"}


def test_endpoints(spark):
    text = "app.get('/a', f)\n@Post('/b')\n@app.get('/c')\nr.HandleFunc(\"/d\", h)\n\n  post '/e'\n@Get()"
    got = {(r["method"], r["route"], r["framework"], r["line"]) for r in scanning.endpoints(code(spark, ("a.x", "code", "js", text))).collect()}
    assert got == {("GET", "/a", "express", 1), ("GET", "/c", "express", 3), ("POST", "/b", "nest/spring", 2), ("GET", "", "nest/spring", 7), ("GET", "/c", "fastapi/flask", 3), ("ANY", "/d", "go", 4), ("POST", "/e", "rails", 6)}


# Gate

EVIDENCE = [{"id": "E1", "text": "The limit is three\n  retries."}, {"id": "E2", "text": "other"}]


def item(**more):
    return {"id": "i", "type": "x", "title": "t", "statement": "s", "evidence": ["E1"], "confidence": "high", **more}


@pytest.mark.parametrize(
    ("items", "codes"),
    [
        ([item(quotes=[{"evidence": "E1", "text": "is three\nretries."}])], []),
        ([item(evidence=["E9"])], ["E_BAD_EVIDENCE"]),
        ([item(evidence=[])], ["E_NO_EVIDENCE"]),
        ([item(quotes=[{"evidence": "E1", "text": "invented"}])], ["E_QUOTE_MISMATCH"]),
        ([item(quotes=[{"evidence": "E2", "text": "other"}])], ["E_QUOTE_NOT_CITED"]),
        ([item(quotes=[{"evidence": "E7", "text": "x"}])], ["E_QUOTE_SRC"]),
        ([item(quotes=[{"evidence": "E1", "text": "  "}])], ["E_QUOTE_EMPTY"]),
        ([item(quotes="x")], ["E_SCHEMA"]),
        ([item(quotes=[3])], ["E_SCHEMA"]),
        ([item(contradicting_evidence=["E8"])], ["E_BAD_EVIDENCE"]),
        ([item(), item()], ["E_DUP_ID"]),
        ([item(statement="it is probably so")], ["E_SPECULATION"]),
        ([item(statement="おそらく", confidence="low")], ["W_SPECULATION"]),
        (["text"], ["E_ITEM"]),
    ],
)
def test_gate(items, codes):
    v = gate.verify({"summary": "s", "items": items, "open_questions": []}, EVIDENCE)
    assert [x["code"] for x in v.violations] == codes and v.ok == (not any(c[0] == "E" for c in codes))
    assert v.stats["items"] == len(items) and len(v.cleaned["items"]) == v.stats["accepted"]


def test_gate_lists_and_malformed_answers():
    v = gate.verify({"summary": "likely", "items": [], "contradictions": [{"description": "d", "evidence": ["E9"]}], "next_actions": [{"action": "a", "evidence": ["E1", "E9"]}]}, EVIDENCE)
    assert sorted(x["code"] for x in v.violations) == ["E_BAD_EVIDENCE", "E_SCHEMA", "W_BAD_EVIDENCE", "W_SPECULATION"]
    assert v.cleaned["contradictions"] == [] and v.cleaned["next_actions"][0]["evidence"] == ["E1"] and v.cleaned["_rejected"]
    for bad in (None, [], "x", 3):
        assert [x["code"] for x in gate.verify(bad, EVIDENCE).violations] == ["E_NO_JSON"]
    for key in ("items", "contradictions", "next_actions", "open_questions"):
        gate.verify({"summary": 1, key: {"a": 1}}, EVIDENCE)
        gate.verify({key: [None, 1, [], {"evidence": 4, "quotes": {}, "id": [1]}]}, EVIDENCE) if key != "items" else None
    assert "E_NO_JSON" in gate.repair_prompt(gate.verify(None, []).violations)


def test_gate_frames_equal_gate(spark):
    answers = {"a": [item(quotes=[{"evidence": "E1", "text": "is three\nretries."}, {"evidence": "E2", "text": "other"}, {"evidence": "E7", "text": "x"}, {"evidence": "E1", "text": ""}, {"evidence": "E1", "text": "no"}])], "b": [item(evidence=[]), item(evidence=["E9", "E1"])]}
    evidence = spark.createDataFrame([(a, e["id"], e["text"]) for a in answers for e in EVIDENCE], "answer_id string, id string, text string")
    quotes = spark.createDataFrame([(a, i, q, x["evidence"], x["text"], it["evidence"]) for a, its in answers.items() for i, it in enumerate(its) for q, x in enumerate(it.get("quotes", []))], "answer_id string, item_no int, quote_no int, evidence string, text string, cited array<string>")
    items = spark.createDataFrame([(a, i, it["id"], it["evidence"]) for a, its in answers.items() for i, it in enumerate(its)], "answer_id string, item_no int, id string, evidence array<string>")
    got = Counter((r[0], r["code"]) for r in gate.quote_violations(quotes, evidence).select("answer_id", "code").collect() + gate.evidence_violations(items, evidence).select("answer_id", "code").collect())
    want = Counter((a, v["code"]) for a, its in answers.items() for v in gate.verify({"summary": "", "items": its, "open_questions": []}, EVIDENCE).violations)
    assert got == want


# Sources, cache, store


def test_files(spark, tmp_path):
    for name, content in {"src/a.py": b"def f(): pass", "README.md": b"# R", ".env": b"X=1", "x.bin": b"z", "big.md": b"y" * 100, "b.py": b"a\x00", "l.py": b"\xff\xfe", "node_modules/m.js": b"m", "k/id_rsa": b"k"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    docs, skipped = tables.file_docs(spark, str(tmp_path), "r", most_bytes=50)
    assert {(r["path"], r["kind"]) for r in docs.collect()} == {("src/a.py", "code"), ("README.md", "doc")}
    assert {r[0]: r[1] for r in skipped.collect()} == {"unknown_type": 1, "too_large": 1, "binary": 1, "bad_encoding": 1, "sensitive": 2}


def test_cache(spark, tmp_path):
    docs = spark.createDataFrame([("a:1", "a", "1", "t1"), ("b:1", "b", "1", "t2")], "doc_id string, source_id string, path string, text string")
    full = tables.as_docs(docs, F.col("source_id"), F.col("path"), F.col("text"))
    cache.write_cache(full, str(tmp_path / "c"))
    cache.write_cache(full.where("source_id = 'a'").withColumn("text", F.lit("new")), str(tmp_path / "c"))
    assert {(r["doc_id"], r["text"]) for r in cache.read_cache(spark, str(tmp_path / "c")).collect()} == {("a:1", "new"), ("b:1", "t2")}
    assert cache.read_cache(spark, str(tmp_path / "c"), ["b"]).count() == 1
    cache.write_json_lines(full, str(tmp_path / "j"))
    (tmp_path / "j" / "bad.json").write_text('{"doc_id": broken\n')
    assert cache.read_json_lines(spark, str(tmp_path / "j")).count() == 2


def test_descendants_end_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    got = {(r["id"], r["depth"]) for r in cache.descendants(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_generations(spark, tmp_path):
    chunks = spark.createDataFrame([("s:a#0", "s:a", "s", "a", "t", "code", "alpha beta")], "key string, doc_id string, source_id string, path string, title string, kind string, text string")
    store = index.IndexStore(spark, str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        store.open()
    assert [store.build(chunks, "k1") for _ in range(4)] == [1, 2, 3, 4]
    assert store.generations() == [3, 4]
    pinned = store.open()
    assert pinned.number == 4 and pinned.manifest["n"] == 1 and pinned.is_stale("k2") and not pinned.is_stale("k1")
    vectors = spark.createDataFrame([("s:a#0", [1.0, 0.0])], "key string, embedding array<float>")
    store.build(chunks, vectors=vectors)
    assert store.open().manifest["dims"] == 2 and pinned.chunks.count() == 1
    with pytest.raises(Exception, match="vectors differ"):
        store.build(chunks, vectors=vectors.union(spark.createDataFrame([("x", [1.0])], "key string, embedding array<float>")))


# Remote sources, against recorded answers


def test_code_host():
    import base64

    answers = {"/commits/main": {"sha": "c1", "commit": {"tree": {"sha": "t1"}}}, "/git/trees/t1": {"tree": [{"type": "blob", "path": p, "sha": p, "size": s} for p, s in (("src/a.py", 5), ("node_modules/x.js", 5), ("src/big.py", 999_999), ("doc.md", 5))]}, "/git/blobs/src/a.py": {"content": base64.b64encode(b"x = 1").decode()}, "/git/blobs/doc.md": {"content": base64.b64encode(b"\xff").decode()}, "/issues": [{"number": 1, "title": "T", "state": "open", "body": "B", "user": {"login": "u"}}, {"number": 2, "title": "P", "state": "open", "pull_request": {}}], "/pulls": []}
    fetch = lambda url, params=None, body=None: answers[url.split("/repos/o/r")[1]]
    host = remote.CodeHost({"id": "g", "repo": "o/r", "issues": {"enabled": True}}, fetch)
    assert host.parts() == [{"part": "files"}, {"part": "issues"}]
    docs = [d for part in host.parts() for _, d, _ in host.fetched(list(host.listing(part)))]
    assert [d and d["path"] for d in docs] == ["src/a.py", None, "issues/1"] and docs[0]["url"] == "https://github.com/o/r/blob/c1/src/a.py"
    answers["/git/trees/t1"]["truncated"] = True
    with pytest.raises(remote.RemoteError):
        list(host.files())


def test_wiki_and_tracker():
    page = lambda i: {"id": i, "title": f"T{i}", "body": {"storage": {"value": "<p>x</p>"}}, "version": {"number": 3}, "_links": {"webui": f"/p/{i}"}}

    def fetch(url, params=None, body=None):
        if "child/page" in url:
            parent = url.split("/content/")[1].split("/")[0]
            return {"results": [{"id": c} for c in {"1": ["2", "3"], "3": ["1"]}.get(parent, [])], "_links": {"next": url}}
        if "search/jql" in url:
            return {"issues": [{"key": "K-1", "fields": {"summary": "S", "status": {"name": "Open"}, "description": {"type": "text", "text": "D"}}}], "nextPageToken": None if body.get("nextPageToken") else "n"}
        if url.endswith("/search"):
            return {"results": [page(i) for i in ("1", "2")]}
        return page(url.rsplit("/", 1)[1])

    wiki = remote.Wiki({"id": "w", "base_url": "https://w", "page_ids": [1], "include_descendants": True}, fetch)
    assert wiki.parts() == [{"ids": ["1", "2", "3"]}]
    assert [(d["path"], d["text"]) for _, d, _ in wiki.fetched(list(wiki.listing(wiki.parts()[0])))] == [(i, f"# T{i}\n\nx") for i in "123"]
    tracker = remote.Tracker({"id": "j", "base_url": "https://j", "jql": "x"}, fetch)
    tickets = [d for _, d, _ in tracker.fetched(list(tracker.listing(tracker.parts()[0])))]
    assert [t["path"] for t in tickets] == ["K-1"] and "status: Open" in tickets[0]["text"] and tickets[0]["text"].endswith("D")
    assert remote.cql({"space_key": 'E"N', "labels": ["a"]}) == 'type = page AND space = "E\\"N" AND label = "a" ORDER BY lastmodified DESC'


def test_gate_for_the_network():
    g = remote.Gate(("a.example",))
    g.check("https://a.example/x")
    for url, method in (("https://b.example/x", "GET"), ("http://a.example/x", "GET"), ("https://a.example/x", "DELETE"), ("https://a.example/x", "POST")):
        with pytest.raises(remote.EgressDenied):
            g.check(url, method)
    with pytest.raises(remote.EgressDenied):
        remote.Gate(("a.example",), offline=True)("https://a.example/x")
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise remote.RemoteError("x")
        return 7

    assert remote.retried(flaky, sleep=lambda s: None) == 7
    with pytest.raises(remote.RemoteError):
        remote.retried(lambda: (_ for _ in ()).throw(remote.RemoteError("x", retry=False)), sleep=lambda s: None)


# Streaming


def test_stream_of_documents_equals_a_batch(spark, tmp_path):
    schema = "doc_id string, source_id string, path string, kind string, text string"
    rows = [(f"s:{i}", "s", f"{i}.md", "doc", t) for i, t in enumerate(CORPUS.values())]
    inbox = tmp_path / "in"
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.parquet(str(inbox))
    stream = lambda: incremental.follow(spark.readStream.schema(schema).parquet(str(inbox)), str(tmp_path / "ix"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    stream()
    spark.createDataFrame([*rows[3:], ("s:0", "s", "0.md", "doc", "changed refund text")], schema).coalesce(1).write.mode("append").parquet(str(inbox))
    stream()
    chunks, postings, lengths = incremental.current(spark, str(tmp_path / "ix"))
    assert chunks.count() == len(rows) and lengths.count() == len(rows)
    got = ranking.bm25(postings, lengths, ranking.term_frame(spark, {"q": "refund"}, False)).collect()
    assert {r["key"].split("#")[0] for r in got} == {"s:0", "s:4"}


def test_event_windows_stream(spark, tmp_path):
    from datetime import datetime

    rows = [(1, datetime(2024, 1, 1, 0, m), u, "t", 1.0) for m, u in ((1, 1), (2, 1), (20, 1), (59, 2))]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id int, event_type string, value double")
    assert sorted(r["n"] for r in incremental.windowed(df, "10 minutes").collect()) == [1, 1, 2]
    assert sorted(r["n"] for r in incremental.sessions(df, "5 minutes").collect()) == [1, 1, 2]


# Engine


def test_end_to_end(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "refund.js").write_text("// retry the refund\nfunction refundPayment() {\n  const MAX_RETRY = 3\n  fetch(url)\n}\n")
    (src / "spec.md").write_text("# 返金\n返金のリトライ上限は 5 回とする。\n")
    (src / ".env").write_text("SECRET=abcdefgh")
    (src / "conf.yaml").write_text("db_password: sup3rsecret\n")
    e = engine.Engine(spark, str(tmp_path / "ws"), {"sources": [{"id": "s", "type": "local", "path": str(src)}, {"id": "bad", "type": "local", "path": str(tmp_path / "none")}]})
    state = e.sync()
    assert state["s"]["ok"] and not state["bad"]["ok"]
    assert e.build_index() == 1 and e.status()["sources"][0]["documents"] == 3
    hits = e.search("返金のリトライ")
    assert {h["path"] for h in hits} >= {"spec.md", "refund.js"} and not e.search("zzzz")
    pack = e.evidence_pack("spec", "返金のリトライ上限", "low")
    again = e.evidence_pack("spec", "返金のリトライ上限", "low")
    assert pack == again and "sup3rsecret" not in json.dumps(pack.items, default=str)
    assert e.save_pack(pack).startswith("pack-")
    assert e.fetch("s:spec.md", 2, 2) == ["返金のリトライ上限は 5 回とする。"]
    with pytest.raises(KeyError):
        e.run_task("nope", "x")
    dry = e.run_task("bug", "refund retry")
    assert "refundPayment" in dry["bundle"] and "REL-NO-TIMEOUT" in dry["bundle"]
    eid = next(i["id"] for i in dry["pack"].items if i["path"] == "refund.js")
    replies = iter(["no json", json.dumps({"summary": "s", "items": [{"id": "1", "type": "observation", "title": "t", "statement": "s", "evidence": [eid], "quotes": [{"evidence": eid, "text": "const MAX_RETRY = 3"}], "confidence": "high"}], "open_questions": []})])
    done = e.run_task("bug", "refund retry", model=lambda system, user: next(replies))
    assert done["verdict"].ok and "MAX_RETRY" in done["report"]


def test_vector_scores_are_held_for_some_queries_at_a_time(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(4)]) for i in range(120)]
    vectors = spark.createDataFrame(rows, "key long, embedding array<float>").coalesce(1)
    asked = vectors.where("key % 5 = 0").select(F.col("key").alias("query_id"), "embedding")
    want = sorted((q, k, s, n) for q, v in rows if q % 5 == 0 for n, (s, k) in enumerate(sorted(((sum(a * b for a, b in zip(v, w)), k) for k, w in rows), key=lambda x: (-x[0], x[1]))[:7], 1))
    for most in (1, 500, 1 << 20):
        monkeypatch.setattr(ranking, "MOST_SCORES", most)
        assert sorted(map(tuple, ranking.vector_search(vectors, asked, 7).collect())) == want


def test_an_index_reads_texts_once_and_sums_chunks_of_one_key(spark):
    rows = [(1, "a", "p", "alpha beta fooBar"), (1, "b", "p", "alpha"), (2, None, None, None), (None, "x1", "", "beta"), (None, "x2", "", "beta")]
    chunks = spark.createDataFrame(rows, "key long, title string, path string, text string")
    postings, lengths = index.stored_postings(chunks)
    assert sorted(map(str, postings.collect())) == sorted(map(str, index.postings_of(chunks).collect())) and postings.count() == postings.select("key", "term").distinct().count()
    assert {(r["key"], r["term"]): r["tf"] for r in postings.collect()} == {(1, "alpha"): 2, (1, "beta"): 1, (1, "foobar"): 1, (1, "foo"): 1, (1, "bar"): 1, (None, "beta"): 2, (None, "x1"): 3, (None, "x2"): 3}
    assert sorted(map(str, lengths.collect())) == sorted(map(str, index.lengths_of(chunks).collect()))
    assert index.totals_of(chunks).first() == (5, 1.8, 7) and index.totals_of(chunks.where("false")).first() == (0, None, 0)


def test_postings_are_written_once_in_the_task_that_reads_a_text(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, f"t{i % 7}", f"p/{i}", " ".join(rng.choice(["alpha", "Beta", "fooBar", "v1.2", "日本", "x_y"]) for _ in range(i % 9))) for i in range(60)]
    for name, more in (("apart", []), ("shared", [(3, "again", "p", "alpha alpha"), (None, "a", "", "beta"), (None, "b", "", None)])):
        spark.createDataFrame(rows + more, "key long, title string, path string, text string").repartition(3).write.parquet(f"{tmp_path}/{name}")
        chunks = spark.read.parquet(f"{tmp_path}/{name}")
        held = index.written_postings(chunks, f"file://{tmp_path}/{name}-postings")
        assert sorted(map(str, index.postings_in(held).collect())) == sorted(map(str, index.postings_of(chunks).collect()))
        assert sorted(map(str, index.lengths_in(held).collect())) == sorted(map(str, index.lengths_of(chunks).collect()))
        for path in held.inputFiles():
            terms = [r["term"] for r in spark.read.parquet(path).collect()]
            assert terms == sorted(terms, key=str.encode)
    plan = index.by_term(index.counted(chunks))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    store = index.IndexStore(spark, f"file://{tmp_path}/index")
    store.build(spark.read.parquet(f"{tmp_path}/apart"))
    now = store.open()
    assert now.manifest["n"] == 60 and now.postings.where("term = ''").isEmpty() and now.manifest["terms"] == now.postings.select("term").distinct().count()


def test_rows_of_one_small_file_are_dealt_to_all_cores(spark, tmp_path):
    from evisieve.operators.tables import dealt
    from evisieve.plans import forms

    spark.range(1000).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = dealt(spark.read.parquet(f"{tmp_path}/supplier.parquet"), "s_suppkey", 100)
    assert rows.rdd.getNumPartitions() == 10 and rows.distinct().count() == 1000
    assert forms.generated_code(spark, str(tmp_path)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_summary_scans_texts_once(spark):
    docs = spark.createDataFrame([("d", "s", "github", "a.js", "js", "u", "config", "// TODO: x\nconsole.log(1)\n// TODO: y")], "doc_id string, source_id string, source_type string, path string, lang string, url string, kind string, text string")
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    found = scanning.findings(docs, masked=False).mapInArrow(seen, scanning.FINDING)
    got = {(r["severity"], r["rule_id"], r["n"]) for r in scanning.summary(found).collect()}
    assert got == {("info", None, 2), ("low", None, 1), (None, "REL-TODO", 2), (None, "REL-DEBUG-LEFTOVER", 1), (None, None, 3)} and runs.value == 3
    assert [tuple(r) for r in scanning.summary(found.where("false")).collect()] == [(None, None, 0)]
