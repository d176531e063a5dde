"""Benchmark decontamination with a distributed positional inverted index.

One pass over the training documents writes the index: the postings of all their terms, cut into segments of
SEGMENT_BYTES of text (whole documents). A row holds the lists of one range of terms in one segment: its terms
in order, their counts, and per term the documents and word positions. Rows are dealt and sorted by term range,
so a search reads only the ranges in which the test items' terms lie.

Test items become windows of consecutive words. The corpus counts of a window's terms, read from the index,
give the order of its lists, rarest first. The rarest terms' lists name the documents that can match at all;
of the other lists only these documents' parts are taken. Then, segment by segment, the rarest list less its
offset in the window is intersected with each further list less that list's offset: what is left of all of
them are exact phrases. Proximity matches hold the window's NEAR_TERMS rarest terms, in any order, each within
SLOP words of the rarest.

Terms are 64-bit hashes of words, compared by all their bits. Test items are a stated query set: they are
taken in blocks of about ITEMS_A_BLOCK, so what is collected and broadcast is bounded whatever their number.

Defined results: null and empty texts have no words and no hits; an item without words has no window; an item
of fewer words than a window is one window; repeated documents and items are matched one by one, and item ids
are reported once per document (a null item id as ""); columns of `docs` other than id and text aren't looked
at; empty tables give no hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, alnum_words, give_back, slices, stored, text_bytes

WINDOW, NEAR_TERMS, SLOP = 13, 3, 26
ITEMS_A_BLOCK = 20_000
#: Bytes of text whose postings form one segment, and the ranges of terms that it is cut into.
SEGMENT_BYTES, RANGES = 4 << 20, 4096
#: Documents that can match are broadcast up to this many (8 bytes each); beyond, whole lists are taken.
BROADCAST_DOCS = 2_000_000
_words = Words(alnum_words())


# The index


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index. Rows of range < 0 are documents: key, id and n_words.

    All others are lists: range, key of the segment's first document, and as packed integers the range's terms
    (64 bits, in order), their counts, and for each of their postings in turn the document (its key less the
    segment's) and the word position (32 bits each).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = _arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first, size = None, 0
        for batch in batches:
            for part in slices(batch):
                keys = part.column(0).to_numpy(zero_copy_only=False)
                data, offsets = text_bytes(part.column(2))
                hashes, _, _, row = _words(data, offsets)
                n = np.bincount(row, minlength=part.num_rows)
                yield _documents(keys, part.column(1), n, id_type)
                if first is None:
                    first = int(keys[0])
                position = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                held.append((hashes, (keys - first)[row].astype(np.int32), position.astype(np.int32)))
                size += len(data)
                if size >= SEGMENT_BYTES:
                    yield from _segment(first, held, id_type)
                    held, first, size = [], None, 0
        if held:
            yield from _segment(first, held, id_type)
        give_back()

    shape = f"range int, key bigint, id {kind}, n_words bigint, terms binary, counts binary, docs binary, positions binary"
    # One range of a very common term may hold much of the index: rebalancing splits it.
    return stored(rows.mapInArrow(run, shape).hint("rebalance", "range").sortWithinPartitions("range", "key"), "index")


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


_INDEX = ["range", "key", "id", "n_words", "terms", "counts", "docs", "positions"]


def _documents(keys: np.ndarray, ids: pa.Array, n_words: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
    none = pa.nulls(len(keys), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array((-1 - keys % 64).astype(np.int32)), pa.array(keys), ids.cast(id_type), pa.array(n_words.astype(np.int64)), none, none, none, none], names=_INDEX)


def _segment(first: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    hashes, doc, position = (np.concatenate(x) for x in zip(*held))
    if not len(hashes):
        return
    order = np.argsort(hashes, kind="stable")  # documents and positions stay in order
    hashes, doc, position = hashes[order], doc[order], position[order]
    at = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    terms, counts = hashes[at], np.diff(np.append(at, len(hashes))).astype(np.int32)
    owner = range_of(terms)
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    cuts = np.append(begin, len(terms))  # in terms
    lists = np.append(at, len(hashes))[cuts]  # in postings
    n = len(begin)
    pack = lambda values, ends: pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    yield pa.RecordBatch.from_arrays([pa.array(owner[begin]), pa.array(np.full(n, first)), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pack(terms, cuts), pack(counts, cuts), pack(doc, lists), pack(position, lists)], names=_INDEX)


def range_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - (RANGES - 1).bit_length())).astype(np.int32)


def documents(index: DataFrame) -> DataFrame:
    """key, id and n_words of every indexed document."""
    return index.where("range < 0").select("key", "id", "n_words")


def _packed(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and where each row's begin."""
    raw, offsets = text_bytes(column)
    return np.frombuffer(raw.tobytes(), dtype=kind), offsets // np.dtype(kind).itemsize


def _terms_in(batch: pa.RecordBatch, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each wanted term's lists in a batch: ordinal in `wanted`, count, where its postings begin, and the batch's row."""
    terms, first = _packed(batch.column(1), np.uint64)
    counts, _ = _packed(batch.column(2), np.int32)
    at = np.searchsorted(wanted, terms)
    found = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == terms) if len(wanted) else at[:0]
    begin = np.cumsum(counts, dtype=np.int64) - counts
    return at[found], counts[found], begin[found], np.searchsorted(first, found, side="right") - 1


def _lists(index: DataFrame, terms: np.ndarray, columns: list[str]) -> DataFrame:
    """Index rows of the ranges in which the terms lie."""
    ranges = np.unique(range_of(terms)).tolist()
    some = F.col("range").isin(ranges) if len(ranges) < RANGES // 8 else F.col("range").between(min(ranges, default=0), max(ranges, default=0))
    return index.where((F.col("range") >= 0) & some).select(columns)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the (sorted) terms occurs in the whole corpus."""
    shared = index.sparkSession.sparkContext.broadcast(terms)  # a block's terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            ordinal, n, _, _ = _terms_in(batch, shared.value)
            np.add.at(total, ordinal, n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["term", "n"])

    out = np.zeros(len(terms), dtype=np.int64)
    for term, n in _lists(index, terms, ["key", "terms", "counts"]).mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():  # a row per term of the block
        out[term] = n
    return out


def documents_with(index: DataFrame, terms: np.ndarray) -> DataFrame:
    """Keys of the documents that hold any of the (sorted) terms."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, begin, row = _terms_in(batch, shared.value)
            docs, first = _packed(batch.column(3), np.int32)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.repeat(keys[row], n) + docs[_spread(begin, n)]))], names=["key"])

    return _lists(index, terms, ["key", "terms", "counts", "docs"]).mapInArrow(run, "key bigint").distinct()


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] numbers, then those of begin[1], and so on."""
    ends = np.cumsum(n, dtype=np.int64)
    return np.repeat(begin - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def postings(index: DataFrame, terms: np.ndarray, only: np.ndarray | None) -> DataFrame:
    """key of the segment, term ordinal, docs and positions of the (sorted) terms' lists, cut to the documents `only`."""
    shared = index.sparkSession.sparkContext.broadcast((terms, only))  # BROADCAST_DOCS keys at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, only = shared.value
        for batch in batches:
            ordinal, n, begin, row = _terms_in(batch, terms)
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            at, owner = _spread(begin, n), np.repeat(np.arange(len(n)), n)
            docs, position = (_packed(batch.column(i), np.int32)[0][at] for i in (3, 4))
            if only is not None:
                key = keys[row][owner] + docs
                found = np.searchsorted(only, key)
                keep = only[np.minimum(found, len(only) - 1)] == key if len(only) else np.zeros(len(key), dtype=bool)
                docs, position, owner = docs[keep], position[keep], owner[keep]
            count = np.bincount(owner, minlength=len(n))
            some = np.flatnonzero(count)
            if not len(some):
                continue
            ends = np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row[some]]), pa.array(ordinal[some].astype(np.int32)), *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (docs, position))], names=["key", "term", "docs", "positions"])

    return _lists(index, terms, ["key", "terms", "counts", "docs", "positions"]).mapInArrow(run, "key bigint, term int, docs array<int>, positions array<int>")


# The test items


@dataclass
class Windows:
    """Windows of a block of items: per window its item's ordinal and its terms' ordinals."""

    items: list[str]
    terms: np.ndarray  # sorted distinct hashes
    words: list[bytes]  # a word of each term, which orders terms of equal count
    item: np.ndarray  # per window
    window: list[np.ndarray]  # per window, ordinals into terms


def item_windows(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Windows:
    """All windows of (id, text) items, equal windows of one item once."""
    got, spelled = [], {}
    for name, (_, text) in enumerate(items):
        raw = (text or "").encode("utf-8", "surrogatepass")
        hashes, first, end, _ = _words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        own = hashes.tolist()
        spelled.update(zip(own, (raw[a:b].lower() for a, b in zip(first.tolist(), end.tolist()))))
        if own:
            got += [(name, tuple(own[i : i + window])) for i in range(max(1, len(own) - window + 1))]
    got = list(dict.fromkeys(got))
    terms = np.array(sorted(spelled), dtype=np.uint64)
    return Windows([i or "" for i, _ in items], terms, [spelled[t] for t in terms.tolist()], np.array([i for i, _ in got], dtype=np.int64), [np.searchsorted(terms, np.array(w, dtype=np.uint64)) for _, w in got])


@dataclass
class Plan:
    """Windows ordered for intersection: by rarest term, then each window's lists from rarest to commonest."""

    items: list[str]
    item: np.ndarray
    first: np.ndarray  # where each term's windows begin, by rarest term
    length: np.ndarray
    term: np.ndarray  # window x list: term ordinal, -1 past the window's length
    offset: np.ndarray
    near: np.ndarray  # window x NEAR_TERMS: rarest distinct terms, -1 where there are fewer


def plan_windows(windows: Windows, counts: np.ndarray) -> Plan:
    """Terms by count, then spelling; windows with a term that no document holds can't match and are left out of `first`."""
    widest, n = max(map(len, windows.window), default=1), len(windows.window)
    rank = np.empty(len(windows.terms), dtype=np.int64)
    rank[sorted(range(len(rank)), key=lambda t: (counts[t], windows.words[t]))] = np.arange(len(rank))
    term, offset = np.full((n, widest), -1, dtype=np.int32), np.zeros((n, widest), dtype=np.int32)
    near = np.full((n, NEAR_TERMS), -1, dtype=np.int32)
    for i, own in enumerate(windows.window):
        order = np.argsort(rank[own], kind="stable")
        term[i, : len(own)], offset[i, : len(own)] = own[order], order
        rare = list(dict.fromkeys(own[order].tolist()))[:NEAR_TERMS]
        near[i, : len(rare)] = rare
    order = np.argsort(term[:, 0], kind="stable") if n else np.zeros(0, dtype=np.int64)
    first = np.searchsorted(term[order, 0], np.arange(len(windows.terms) + 1)) if n else np.zeros(len(windows.terms) + 1, dtype=np.int64)
    return Plan(windows.items, windows.item[order], first, np.array([len(w) for w in windows.window], dtype=np.int64)[order], term[order], offset[order], near[order])


# The search


def intersect(plan: Plan, term: np.ndarray, doc: np.ndarray, position: np.ndarray, proximity: bool) -> tuple[np.ndarray, ...]:
    """Exact phrases as (window, doc, start) and proximity matches as (window, doc), from one segment's postings.

    A list is the run of one term's postings in the sorted array `keys`; whether a list holds a document and
    position is a binary search there.
    """
    own, local = np.unique(term, return_inverse=True)
    span = int(position.max(initial=0)) + 1 + plan.term.shape[1] + 2 * SLOP
    size = (int(doc.max(initial=0)) + 1) * span
    keys = np.sort(local * size + doc * np.int64(span) + position + SLOP)  # so many words of room on either side
    lists = np.full(len(plan.first), -1, dtype=np.int64)
    lists[own] = np.arange(len(own))

    def holds(t: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term's list has a posting from low to high."""
        base = lists[t] * size
        at = np.searchsorted(keys, base + low)
        return (lists[t] >= 0) & (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= base + high)

    phrases, nears = [], []
    per = (plan.first[1:] - plan.first[:-1])[term]
    used = np.flatnonzero(per)
    ends, i = np.cumsum(per[used]), 0
    while i < len(used):  # candidates of a bounded number of postings at a time
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 18), side="right")))
        some, i = used[i:j], j
        window = _spread(plan.first[term[some]], per[some])
        here = np.repeat(doc[some] * np.int64(span) + position[some] + SLOP, per[some])
        w, start = window, here - plan.offset[window, 0]
        for k in range(1, plan.term.shape[1]):  # from rare to common; few candidates survive the first lists
            need = plan.term[w, k]
            ok = need < 0
            more = np.flatnonzero(~ok)
            at = start[more] + plan.offset[w[more], k]
            ok[more] = holds(need[more], at, at)
            w, start = w[ok], start[ok]
            if not len(w):
                break
        phrases.append(np.stack([w, start // span, start % span - SLOP]))
        if proximity:
            ok = plan.near[window, NEAR_TERMS - 1] >= 0
            window, here = window[ok], here[ok]
            for k in range(1, NEAR_TERMS):
                ok = holds(plan.near[window, k], here - SLOP, here + SLOP)
                window, here = window[ok], here[ok]
            nears.append(np.unique(np.stack([window, here // span]), axis=1))
    none = np.zeros((3, 0), dtype=np.int64)
    w, d, s = np.concatenate(phrases, axis=1) if phrases else none
    near = np.unique(np.concatenate(nears, axis=1), axis=1) if nears else none[:2]
    return w, d, s, near[0], near[1]


def merged_runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that ranges cover, in order; ranges that touch are one run."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]])) if len(start) else order
    return start[new], end[np.append(new[1:], len(start)) - 1] if len(start) else end


def matches(lists: DataFrame, plan: Plan, proximity: bool) -> DataFrame:
    """key, hit runs (word positions, ends exclusive), items with an exact phrase and items that are only near, of documents with any."""
    shared = lists.sparkSession.sparkContext.broadcast(plan)  # a block's windows
    shape = "key bigint, starts array<int>, ends array<int>, items array<string>, near_items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and keys[a] != segment:
                        yield from solve(segment, held)
                        held = []
                    segment = int(keys[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from solve(segment, held)

    def solve(segment: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        flat = lambda i: np.concatenate([b.column(i).flatten().to_numpy(zero_copy_only=False) for b in held])
        count = np.concatenate([b.column(2).value_lengths().to_numpy(zero_copy_only=False) for b in held])
        term = np.repeat(np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in held]), count)
        window, doc, start, near_window, near_doc = intersect(plan, term, flat(2).astype(np.int64), flat(3).astype(np.int64), proximity)
        found = np.union1d(doc, near_doc)
        if not len(found):
            return
        span = int((start + plan.length[window]).max(initial=0)) + 1
        begin, end = merged_runs(doc * span + start, doc * span + start + plan.length[window])
        at = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(found, begin // span), minlength=len(found)))]).astype(np.int32)
        runs = [pa.ListArray.from_arrays(pa.array(at), pa.array((x - begin // span * span).astype(np.int32))) for x in (begin, end)]
        items: dict[int, set[str]] = {d: set() for d in found.tolist()}
        near: dict[int, set[str]] = {d: set() for d in found.tolist()}
        for into, w, d in ((items, window, doc), (near, near_window, near_doc)):
            for name, d in set(zip(plan.item[w].tolist(), d.tolist())):
                into[d].add(plan.items[name])
        names = [pa.array([sorted(x) for x in own], pa.list_(pa.string())) for own in (items.values(), [near[d] - items[d] for d in items])]
        yield pa.RecordBatch.from_arrays([pa.array(found + segment), *runs, *names], names=["key", "starts", "ends", "items", "near_items"])

    # Lists of a segment meet in one task; they are postings of SEGMENT_BYTES of text or of one document at most.
    return lists.repartition("key").sortWithinPartitions("key").mapInArrow(run, shape)


def search(index: DataFrame, items: list[tuple[str | None, str | None]], window: int = WINDOW, proximity: bool = True) -> DataFrame:
    """`matches` of a block of (id, text) items."""
    windows = item_windows(items, window)
    plan = plan_windows(windows, term_counts(index, windows.terms))
    rarest = windows.terms[np.flatnonzero(plan.first[1:] > plan.first[:-1])]
    able = stored(documents_with(index, rarest), "able")
    only = None
    if able.count() <= BROADCAST_DOCS:
        only = np.sort(np.array([r[0] for r in able.collect()], dtype=np.int64))
    return matches(postings(index, windows.terms, only), plan, proximity)


RUNS = "array<struct<starts:int,ends:int>>"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the runs of all blocks as runs that don't touch, and their words: key, runs, n_hit, items, near_items."""
    pair = pa.struct([("starts", pa.int32()), ("ends", pa.int32())])
    for batch in batches:
        runs, n_hit = [], []
        for own in batch.column(1).to_pylist():
            begin, end = merged_runs(*(np.array([r[x] for r in own], dtype=np.int64) for x in ("starts", "ends")))
            runs.append([{"starts": a, "ends": b} for a, b in zip(begin.tolist(), end.tolist())])
            n_hit.append(int((end - begin).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pair)), pa.array(n_hit, pa.int64()), batch.column(2), batch.column(3)], names=["key", "runs", "n_hit", "items", "near_items"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, proximity: bool = True, one_in: int = 20) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, items, near_items, runs and contaminated (n_hit * one_in >= n_words)."""
    index = build_index(docs, id_col, text_col)
    found = None
    for block in item_blocks(items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))):
        own = stored(search(index, block, window, proximity), "matches").select("key", F.arrays_zip("starts", "ends").alias("runs"), "items", "near_items")
        found = own if found is None else found.unionByName(own)
    every = lambda c: F.flatten(F.collect_list(c)).alias(c)
    found = found.groupBy("key").agg(every("runs"), F.array_distinct(every("items")).alias("items"), F.array_distinct(every("near_items")).alias("near_items"))
    found = found.mapInArrow(_joined, f"key bigint, runs {RUNS}, n_hit bigint, items array<string>, near_items array<string>")
    out = documents(index).join(found, "key", "left")
    of = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    out = out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), of("items"), F.array_except(of("near_items"), of("items")).alias("near_items"), of("runs"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))


def item_blocks(items: DataFrame) -> Iterator[list[tuple[str | None, str | None]]]:
    """The query set, equal items once, in blocks of about ITEMS_A_BLOCK; one empty block if there is none."""
    items = stored(items.distinct(), "items")
    blocks = max(1, -(-items.count() // ITEMS_A_BLOCK))
    for block in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()]  # hashes of distinct items deal evenly
