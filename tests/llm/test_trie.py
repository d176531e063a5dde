"""The prefix trie of conversations, and its mergesort, against plain Python."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from evisieve.llm import trie

TURNS = "conv_id long, turn long, role string, text string, depth long, node string"


def digest(role: str, text: str) -> str:
    return sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def brute(rows: list[tuple]) -> list[tuple]:
    own: dict = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    members: dict = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        home = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt = own.get(home, [])[:h] + turns[h:]
        for d in range(len(rebuilt) + 1):
            members.setdefault(tuple(rebuilt[:d]), []).append((c, d == len(rebuilt)))
    kids: dict = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    def total(node: tuple) -> tuple[int, int]:
        below = [total(k) for k in kids.get(node, [])]
        size = len(node[-1][1].encode()) if node else 0
        return (sum(b[0] for b in below) if below else 1), sum(b[1] for b in below) + (len(members[node]) - 1) * size

    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c, e in sorted(m) if e)
        out.append((min(m)[0], len(node), min(members[node[:-1]])[0] if node else None, len(m), len(kids.get(node, [])), *total(node), sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(spark, rows):
    return sorted(str(tuple(r)) for r in trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3)).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    rng = random.Random(3)
    out = []
    for c in list(range(-12, 120)) + [10**15]:
        if c % 25 == 0:
            continue  # homes that are absent
        for t in range(rng.choice([1, 2, 3, 6, 12])):
            out.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", None, "é😀", "a longer text"]), 1, "x"))
    for c in range(1000, 1300):  # copies of one conversation
        out += [(c, t, "user", "same", 1, "x") for t in range(4)]
    out += [(2000, t, "user", str(t), None, None) for t in range(700)] + [(2001, t, "user", str(t), None, None) for t in range(650)]
    return [*out, (None, 1, "user", "lost", 1, "x"), out[0], out[5]]


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_plain_python(spark, rows, small, monkeypatch):
    if small:  # many runs and ranges, chunks of few ids
        for name, value in (("RUN_BYTES", 600), ("RANGE_BYTES", 4000), ("CHUNK_BYTES", 40)):
            monkeypatch.setattr(trie, name, value)
    assert made(spark, rows) == brute(rows)


def test_trie_of_few_rows(spark):
    assert made(spark, []) == [] == made(spark, [(None, 0, "user", "x", 1, "")])
    turnless = [(3, 0, "user", "x", 1, "")]  # takes 0 to 8 turns of an absent home
    assert made(spark, turnless) == brute(turnless)
    many = [(c, 0, "user", "x", 1, "") for c in range(1, 5)] + [(0, 0, None, None, 1, "")]
    assert made(spark, many) == brute(many)


def test_merge_keeps_lcps():
    rng = random.Random(1)
    turn = lambda: bytes([rng.randrange(3)]) * trie.WIDTH
    rows = [(b"".join(turn() for _ in range(rng.randrange(6))), i, []) for i in range(200)]
    runs = []
    for i in range(7):
        run = sorted(rows[i::7])
        runs.append([(*r, 0 if not j else trie.shared(run[j - 1][0], r[0])) for j, r in enumerate(run)])
    got = list(trie.merged(runs))
    assert [g[:3] for g in got] == sorted(rows)
    assert [g[3] for g in got[1:]] == [trie.shared(a[0], b[0]) for a, b in zip(got, got[1:])]
    assert list(trie.merged([])) == []
