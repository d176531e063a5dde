"""The Merkle manifest against plain Python."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from evisieve.llm import merkle
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf_note string"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves: list[str], fanout: int) -> tuple[str, list[str]]:
    """The root, and each leaf's siblings joined."""
    proofs, at, nodes = [""] * len(leaves), list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for i, p in enumerate(at):
            start = p - p % fanout
            proofs[i] += "".join(nodes[j] for j in range(start, min(start + fanout, len(nodes))) if j != p)
            at[i] = p // fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows: list[tuple], fanout: int) -> list[tuple]:
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in names}
    subs = {g: brute_tree([x[1] for x in ordered[g]], fanout) for g in names}
    root, tops = brute_tree([subs[g][0] for g in names], fanout)
    return sorted(((str(d), x, subs[g][0], root, p + t) for g, t in zip(names, tops) for (d, x), p in zip(ordered[g], subs[g][1])))


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(5)
    langs = ["en"] * 60 + ["de"] * 9 + [None] * 7 + ["", "é", "zz", "Z", "=x"]
    out = [(i * 3 - 40, f"text {rng.random()} 😀"[: rng.randrange(1, 20)], g, "s" if i % 4 else None, i if i % 5 else None, "x") for i, g in enumerate(langs)]
    out += [(None, None, None, None, None, None), (None, None, None, None, None, "y"), (7000, "x" * 300_000, "en", "s", 9, None), (7000, "other", "en", "s", 9, None), (7000, "other", "en", "s", 9, None)]
    return out


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 2), (3, 1), (5, 3)])
def test_manifest_equals_plain_python(spark, rows, fanout, levels):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest(*map(F.col, merkle.FIELDS)).alias("leaf"), "leaf_note")
    found = merkle.manifest(leaves, "lang", "doc_id", fanout=fanout, levels=levels)
    fold = merkle.folded(merkle.folded(F.col("leaf"), F.col("idx"), F.col("n"), F.col("proof"), fanout), F.col("top_idx"), F.col("top_n"), F.col("top_proof"), fanout)
    got = found.select("doc_id", "leaf", "subroot", "root", F.concat("proof", "top_proof").alias("p"), fold.alias("folded"), "lang", "leaf_note").collect()
    assert sorted((str(r[0]), *r[1:5]) for r in got) == brute(rows, fanout)
    assert all(r.folded == r.root for r in got)
    assert sorted((str(r.lang), str(r.leaf_note)) for r in got) == sorted((str(r[2]), str(r[5])) for r in rows)


def test_a_changed_leaf_does_not_fold_to_the_root(spark, rows):
    leaves = spark.createDataFrame(rows, DOCS).select("doc_id", "lang", merkle.leaf_digest(*map(F.col, merkle.FIELDS)).alias("leaf"))
    found = merkle.manifest(leaves, "lang", "doc_id")
    other = merkle.folded(F.sha2("leaf", 256), F.col("idx"), F.col("n"), F.col("proof"))
    assert found.where(other == F.col("subroot")).count() == 0


def test_manifest_of_few_rows(spark, rows):
    leaves = spark.createDataFrame([], DOCS).select("doc_id", "lang", merkle.leaf_digest(*map(F.col, merkle.FIELDS)).alias("leaf"))
    assert merkle.manifest(leaves, "lang", "doc_id").count() == 0
    one = spark.createDataFrame(rows[:1], DOCS).select("doc_id", "lang", merkle.leaf_digest(*map(F.col, merkle.FIELDS)).alias("leaf"))
    r = merkle.manifest(one, "lang", "doc_id").first()
    assert r.leaf == r.subroot == r.root and r.proof == r.top_proof == ""


def test_query_marks_tampered_rows(spark):
    from evisieve.llm import queries

    for r in queries.op13_manifest(spark, "/root/testdata/sf0.001").collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
