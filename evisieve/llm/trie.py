"""The prefix trie of conversations, by an external mergesort that carries common prefixes.

A turn is a 16-byte digest of its role and text, a conversation the digests of its turns one after another, so bytes
compare as turns do. Sorted runs carry for each conversation how many turns it shares with the one before (LCP).
Runs are written to the shared folder and dealt by range of (digests, conv_id), so copies of one conversation spread
as well. Each range merges its pieces of runs by a loser tree that compares only turns past the LCPs, and a stack of
open nodes follows the merged stream: what the next conversation doesn't share is finished and emitted.

Nodes on the path of a range's first or last conversation may go on in other ranges. Their counts are
partial, hold finished descendants only, and are added by node; the trie of these paths alone (two a range, so its size
follows the number of ranges and not of conversations) is folded by the same stack. The ids that end at such a
node travel as chunks of text in order and are hashed as a stream. A task holds one range, of about RANGE_BYTES digests;
a conversation is one row and, like a document, has to fit into a task.

Defined results: rows without conv_id belong to no conversation; turns ascend with null first, equal ones by
digest; null role or text is empty; the remainder has the sign of its id, as in SQL; repeated rows are turns of their
own; an empty table has no nodes, not even a root; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored

WIDTH, RUN_BYTES, RANGE_BYTES, CHUNK_BYTES = 16, 8 << 20, 16 << 20, 64 << 10
#: How many conversations share a home, and turns that a rebuilt one can take from it.
HOMES, MOST_TAKEN = 5, 9

Row = tuple[bytes, int, list[int], int]


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Turns that a and b have in common at their beginning; the first `start` are known to be equal."""
    i, most = start, min(len(a), len(b)) // WIDTH
    while i < most and a[i * WIDTH : (i + 1) * WIDTH] == b[i * WIDTH : (i + 1) * WIDTH]:
        i += 1
    return i


class Head:
    """The next row of a run: lcp is what it shares with the row that was given out last."""

    __slots__ = ("lcp", "rest", "row")

    def __init__(self, rest: Iterator[Row]):
        self.rest, self.lcp = rest, 0
        self.row = next(rest, None)

    def advance(self) -> None:
        self.row = next(self.rest, None)
        self.lcp = self.row[3] if self.row else 0


def loses(a: Head, b: Head) -> bool:
    """Whether b comes before a; the loser's lcp is then that with the winner."""
    if a.row is None or b.row is None:
        return a.row is None
    if a.lcp != b.lcp:  # who shares more with the last row given out is smaller; the other's lcp stays
        return a.lcp < b.lcp
    (x, x_id, *_), (y, y_id, *_) = a.row, b.row
    h = shared(x, y, a.lcp)
    if h * WIDTH == len(x) == len(y):
        lost = x_id > y_id
    else:
        lost = x[h * WIDTH : (h + 1) * WIDTH] > y[h * WIDTH : (h + 1) * WIDTH]
    (a if lost else b).lcp = h
    return lost


def merged(runs: list[list[Row]]) -> Iterator[Row]:
    """The rows of all runs in order, each with its LCP with the row before, by a loser tree."""
    heads = [Head(iter(run)) for run in runs]
    size = 1
    while size < len(heads):
        size *= 2
    heads += [Head(iter(())) for _ in range(size - len(heads))]
    losers: list[Head | None] = [None] * size
    level = list(heads)
    first = size // 2
    while len(level) > 1:  # first round: winners go up, losers stay
        winners = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            lost = loses(a, b)
            losers[first + i // 2] = a if lost else b
            winners.append(b if lost else a)
        level, first = winners, first // 2
    place = {id(h): i for i, h in enumerate(heads)}
    best = level[0]
    while best.row is not None:
        key, conv, sizes, _ = best.row
        yield key, conv, sizes, best.lcp
        best.advance()
        at = (place[id(best)] + size) // 2
        while at:  # only the path of the run that moved on is played again
            if loses(best, losers[at]):
                best, losers[at] = losers[at], best
            at //= 2


class Node:
    """An open node: n, least and ends of its members so far; the counts cover finished children only."""

    __slots__ = ("children", "ends", "first", "leaves", "least", "n", "own", "saved", "size", "waiting")

    def __init__(self, size: int, first: bool):
        self.size, self.first = size, first
        self.n, self.least, self.children, self.leaves, self.saved = 0, None, 0, 0, 0
        self.ends: list[str] = []
        self.own: list[str] = []
        self.waiting: list[tuple] = []

    def member(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)

    def end(self, conv: int) -> None:
        self.member(1, conv)
        self.own.append(str(conv))
        if len(self.own) * 8 >= CHUNK_BYTES:
            self.chunk()

    def chunk(self) -> None:
        if self.own:
            self.ends.append(",".join(self.own))
            self.own = []


NODE = "kind string, node binary, depth int, path long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, text string"
_FIELDS = [f.split()[0] for f in NODE.split(", ")]
_KINDS = [pa.string(), pa.binary(), pa.int32(), *[pa.int64()] * 8, pa.string()]


def name_of(key: bytes, depth: int) -> bytes:
    return blake2b(key[: depth * WIDTH], digest_size=16).digest()


def walk(rows: Iterator[Row], part: int) -> Iterator[tuple]:
    """Rows of NODE from one range's merged stream.

    node: finished; `node` names its parent where that isn't finished here, else parent_conv_id is set. open: a node on
    the first or last path with its counts so far, `path` numbering the paths. ends: a chunk of ids that end at it.
    """
    stack: list[Node] = []
    first = last = b""

    def opened(node: Node, key: bytes, depth: int, path: int) -> Iterator[tuple]:
        node.chunk()
        name = name_of(key, depth)
        yield "open", name, depth, path, node.least, None, node.n, node.children, node.leaves, node.saved, node.size, None
        for i, text in enumerate(node.ends):
            yield "ends", name, i, path, None, None, None, None, None, None, None, text
        for child in node.waiting:
            yield ("node", name, *child)

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        parent = stack[-1]
        parent.member(node.n, node.least)
        if node.first:
            yield from opened(node, first, depth, 2 * part)
            return
        node.chunk()
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.size
        for child in node.waiting:
            yield ("node", None, *child[:3], node.least, *child[4:])
        digest = sha256(",".join(node.ends).encode()).hexdigest()
        record = (depth, None, node.least, None, node.n, node.children, leaves, saved, None, digest)
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        if parent.first:
            yield ("node", name_of(first, depth - 1), *record)
        else:
            parent.waiting.append(record)

    for key, conv, sizes, lcp in rows:
        is_first = not stack
        if is_first:
            first = key
            stack.append(Node(0, True))
        while len(stack) - 1 > lcp:
            yield from close()
        stack += [Node(size, is_first) for size in sizes[len(stack) - 1 :]]
        stack[-1].end(conv)
        last = key
    while stack:  # the last path
        node, depth = stack[-1], len(stack) - 1
        if depth:
            stack[-2].member(node.n, node.least)
        yield from opened(node, last, depth, 2 * part + (0 if node.first else 1))
        stack.pop()


def record_batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names=_FIELDS)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names=_FIELDS)


RUN = "run long, pos int, key binary, conv_id long, sizes array<int>, lcp int"


def _run_batch(run: int, rows: list[tuple[bytes, int, list[int]]]) -> pa.RecordBatch:
    rows.sort(key=lambda r: r[:2])
    lcps = [0, *(shared(a[0], b[0]) for a, b in zip(rows, rows[1:]))]
    columns = [pa.array([run] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32())), pa.array(lcps, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["run", "pos", "key", "conv_id", "sizes", "lcp"])


def sorted_runs(conversations: DataFrame) -> DataFrame:
    """The rebuilt conversations in sorted runs with LCPs, written to the shared folder."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(conv.isNotNull()).select((conv - conv % HOMES).alias("home"), conv.alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).alias("size"), (F.crc32(conv.cast("string")) % MOST_TAKEN).cast("int").alias("taken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        rows, held = [], 0
        home, own = None, {}

        def rebuilt() -> Iterator[tuple[bytes, int, list[int]]]:
            base = own.get(home, (0, [], []))
            for c, (taken, digests, sizes) in own.items():
                yield b"".join(base[1][:taken] + digests[taken:]), c, base[2][:taken] + sizes[taken:]

        for batch in batches:
            for h, c, digest, size, taken in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if h != home:
                    for r in rebuilt():
                        rows.append(r)
                        held += len(r[0])
                    home, own = h, {}
                    if held >= RUN_BYTES:
                        yield _run_batch(part << 32 | made, rows)
                        rows, held, made = [], 0, made + 1
                entry = own.setdefault(c, (taken, [], []))
                entry[1].append(digest)
                entry[2].append(size)
        rows += rebuilt()
        if rows:
            yield _run_batch(part << 32 | made, rows)

    dealt = turns.repartition("home").sortWithinPartitions("home", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return stored(dealt.select("home", "conv_id", "digest", "size", "taken").mapInArrow(run, RUN), "runs")


def _pieces(batches: Iterator[pa.RecordBatch]) -> list[list[Row]]:
    """The runs' rows of one range; a run's first row shares nothing with one given out before."""
    runs: list[list[Row]] = []
    last = None
    for batch in batches:
        for run, key, conv, sizes, lcp in zip(*(c.to_pylist() for c in batch.columns)):
            if run != last:
                runs.append([])
                last, lcp = run, 0
            runs[-1].append((key, conv, sizes, lcp))
    return runs


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations."""
    spark = conversations.sparkSession
    runs = sorted_runs(conversations)
    total = runs.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    keys, ranges = ["key", "conv_id"], total // RANGE_BYTES + 1
    dealt = runs.repartitionByRange(ranges, *keys) if ranges > int(spark.conf.get("spark.sql.shuffle.partitions")) else runs.repartitionByRange(*keys)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(walk(merged(_pieces(batches)), TaskContext.get().partitionId()))

    found = stored(dealt.sortWithinPartitions("run", "pos").select("run", "key", "conv_id", "sizes", "lcp").mapInArrow(merge, NODE), "nodes")

    # Nodes of first and last paths: counts are added by node, then folded along their own trie.
    first = F.min(F.struct("path", "depth")).alias("first")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    paths = found.where("kind = 'open'").groupBy("node").agg(first, F.min("conv_id").alias("conv_id"), *sums, F.max("size").alias("size"))
    paths = paths.select(F.lit("open").alias("kind"), "node", "first.depth", "first.path", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), *(c for c in ("n_convs", "n_children", "n_leaves", "saved_tokens", "size")), F.lit(None).cast("string").alias("text"))
    folded = stored(paths.repartition(1).sortWithinPartitions("path", "depth").mapInArrow(lambda batches: record_batches(fold(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))), NODE), "paths")
    ends = found.where("kind = 'ends'").select("node", "path", "depth", "text").repartition("node").sortWithinPartitions("node", "path", "depth").select("node", "text").mapInArrow(_digests, "node binary, ends_sha256 string")
    no_ends = F.lit(sha256(b"").hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    top = folded.join(ends, "node", "left").select(*columns, F.coalesce("ends_sha256", no_ends).alias("ends_sha256"))
    done = found.where("kind = 'node'").withColumnRenamed("text", "ends_sha256")
    inner = done.where("node is null").select(*columns, "ends_sha256")
    parents = folded.where("size > 0").select("node", F.col("conv_id").alias("parent"), F.col("size").alias("weight"))
    outer = spread_join(done.where("node is not null"), parents, ["node"], "weight").withColumn("parent_conv_id", F.col("parent")).select(*columns, "ends_sha256")
    return top.unionByName(inner).unionByName(outer).withColumn("depth", _long("depth"))


def _long(name: str) -> Column:
    return F.col(name).cast("long")


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The summed nodes of all first and last paths, parents before children: counts of finished descendants become
    those of the whole subtree. `size` is then the number of children that were finished within a range."""
    stack: list[list] = []

    def close() -> tuple:
        r, kids, leaves, saved = stack.pop()
        children = r[7] + kids
        leaves, saved = (r[8] + leaves if children else 1), r[9] + saved + (r[6] - 1) * r[10]
        if stack:
            stack[-1][1] += 1
            stack[-1][2] += leaves
            stack[-1][3] += saved
        return (*r[:5], stack[-1][0][4] if stack else None, r[6], children, leaves, saved, r[7], None)

    for r in rows:
        while len(stack) > r[2]:
            yield close()
        stack.append([r, 0, 0, 0])
    while stack:
        yield close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, comma-joined, as a stream."""
    last, digest, out = None, None, []
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != last:
                if digest:
                    out.append((last, digest.hexdigest()))
                last, digest = node, sha256()
            else:
                digest.update(b",")
            digest.update(text.encode())
    if digest:
        out.append((last, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.binary(), pa.string()])], names=["node", "ends_sha256"])
