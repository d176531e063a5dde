"""Removal of words that occurred earlier, and the index it is made with, against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from evisieve.llm import fmindex
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_words long, spans string"


def words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(rows: list[tuple], length: int) -> dict:
    """Kept words by id; ids have to be unique."""
    seen, out = set(), {}
    for id_, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(text)
        gone: set[int] = set()
        for i in range(len(w) - length + 1):
            if (g := tuple(w[i : i + length])) in seen:
                gone.update(range(i, i + length))
            seen.add(g)
        out[id_] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("alphabet", "depth"), [(1, 4), (2, 5), (3, 20), (40, 20), (5, 2)])
def test_intervals_count_and_find_first(alphabet, depth):
    rng = random.Random(alphabet * depth)
    regions = [[b"%d" % rng.randrange(alphabet) for _ in range(rng.randrange(1, 60))] for _ in range(40)]
    regions += regions[3:6]
    seen: dict = {}
    want = []
    for i, r in enumerate(regions):
        for j in range(len(r) - depth + 1):
            g = tuple(r[j : j + depth])
            if g in seen:
                want.append((i, j, *seen[g]))
            seen.setdefault(g, (i, j))
    assert sorted(zip(*(x.tolist() for x in fmindex.earlier(regions, depth)))) == sorted(want)


def test_rank_of_the_wavelet_matrix():
    symbols = np.random.default_rng(1).integers(0, 37, 1000)
    matrix = fmindex.WaveletMatrix(symbols)
    at = np.arange(1001)
    for c in range(37):
        assert (matrix.rank(np.full(1001, c), at) == np.append(0, np.cumsum(symbols == c))).all()


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["é", "😀", "\x00", "\x1c", "\xa0"]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(0, 300))] for _ in range(25)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join(b) for b in base[:6]]
    for b in base[:10]:
        v = list(b)
        if v:
            v[rng.randrange(len(v))] = "changed"
        texts.append("\n\t".join(v))
    texts += ["x " + " ".join(common) + f" {i} " + " ".join(rng.choice(vocabulary) for _ in range(40)) for i in range(60)]
    texts += [None, "", "  \n", "one", "a " * 5000, " ".join(map(str, range(30_000))), "Upper " * 30, "upper " * 30]
    ids = list(range(-20, len(texts) - 21))
    rng.shuffle(ids)
    return [(i, t, "en", None, 7, "x") for i, t in zip([*ids, None], texts)] + [(-(2**63), " ".join(base[0]), None, None, None, None)]


@pytest.mark.parametrize(("length", "heavy", "shard"), [(20, 1024, 20_000), (20, 1 << 13, 200), (5, 1024, 20_000)])
def test_removal_equals_plain_python(spark, rows, length, heavy, shard, monkeypatch):
    monkeypatch.setattr(fmindex, "HEAVY_ANCHORS", heavy)  # few anchors meet by region, or nearly all
    monkeypatch.setattr(fmindex, "SHARD_BYTES", shard)  # few anchors counted, or nearly all
    got = fmindex.remove_earlier(spark.createDataFrame(rows, DOCS).repartition(5), length).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute(rows, length)
    assert all(r.n_removed == sum(s.end - s.start for s in r.spans) for r in got)


def test_rows_that_share_an_id_and_repeated_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, a), (5, b + " x"), (5, b), (None, b), (None, b), (6, a), (7, "t " + a)]
    got = fmindex.remove_earlier(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Equal rows are one document seen twice; null comes first, so both others of b lose theirs.
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted([("5", a), ("5", a), ("5", "x"), ("5", ""), ("None", b), ("None", b), ("6", ""), ("7", "t")])


def test_removal_of_an_empty_table(spark):
    assert fmindex.remove_earlier(spark.createDataFrame([], DOCS)).count() == 0
