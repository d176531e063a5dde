"""Exact removal of long repeated byte strings, by suffix sorting.

Every string of LENGTH bytes has one anchor: of its K-byte substrings the one with the least hash, the
leftmost of equals. Equal strings have equal anchors at equal distances, so only strings with the same anchor
content have to be compared, wherever they occur. Consecutive starts with one anchor form a run; a run with
its bytes is a region. Where all regions of an anchor are equal, or a region occurs twice, its strings repeat
and nothing is left to compare. The others are suffix-sorted, anchor by anchor, in two stages: suffixes that
are smaller than their successors are sorted directly, all others follow from scans over the buckets of first
bytes; equal strings are neighbours whose common prefix has LENGTH bytes.

Anchors with more than MOST_REGIONS different regions aren't given to one task: their strings are counted one
by one by a 128-bit hash, which no key's size can overload. The suffix order so decides about strings that repeat in
unequal surroundings; copies of whole stretches are settled by the regions' hashes, and what stands in thousands of
different surroundings by the count. Joins with hot keys are split (common.spread_join).

Defined results: null texts have no bytes; texts shorter than LENGTH keep all; repeated rows repeat each other
and lose all strings of LENGTH; rows that share an id are told apart by their text; an empty table gives an
empty result. Removing bytes may leave invalid UTF-8, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, random_words, slices, spread_join, stored, text_bytes

LENGTH, K = 400, 128
MOST_REGIONS, SORTED_BYTES = 1500, 192 << 10
_VALUES = random_words(31, 256)


def gram_hashes(data: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hashes of all k-byte substrings (k a power of two)."""
    h, span, step = _VALUES[data], 1, np.uint64(0x9E3779B97F4A7C15 | 1)
    with np.errstate(over="ignore"):
        while span < k:
            h = h[:-span] * step + h[span:] if len(h) > span else h[:0]
            step = step * step
            span *= 2
    return mix(h)


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: row, first start, last start, anchor, and the anchor's hash."""
    empty = np.zeros(0, dtype=np.int64)
    n, w = len(data), length - k + 1
    if n < length:
        return empty, empty, empty, empty, np.zeros(0, dtype=np.uint64)
    hashes = gram_hashes(data, k)
    bits = np.uint64(max(20, int(n).bit_length()))
    value = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    # Least value of every w consecutive ones, from prefix and suffix minima of blocks.
    blocks = np.append(value, np.full(-len(value) % w, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(value) - w + 1
    anchor = (np.minimum(suffix[:m], prefix[w - 1 : w - 1 + m]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:m]
    start = np.flatnonzero(np.arange(m) + length <= offsets[row + 1])
    if not len(start):
        return empty, empty, empty, empty, np.zeros(0, dtype=np.uint64)
    own = anchor[start]
    at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(at[1:], len(start)) - 1
    return row[start[at]], start[at], start[last], own[at], hashes[own[at]]


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of `text` (bytes; the end counts as smallest) in order, by two-stage sorting.

    depth: how many bytes the direct sort compares; the order is exact to that depth (None: all bytes).
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    depth = min(n, depth or n)
    step = np.sign(np.diff(text.astype(np.int16)))
    # A suffix is smaller than its successor if the next different byte is larger; the last one is not.
    change = np.append(np.flatnonzero(step), n - 1)
    smaller = np.append(step, -1)[change[np.searchsorted(change, np.arange(n))]] > 0
    direct = np.flatnonzero(smaller)
    # Bytes one higher, so that what lies past the end is smaller than any byte.
    padded = np.concatenate([text.astype(np.uint16) + 1, np.zeros(depth, dtype=np.uint16)]) if int(text.max()) == 255 else np.concatenate([text + np.uint8(1), np.zeros(depth, dtype=np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    keys = np.ascontiguousarray(keys.astype(">u2") if padded.dtype == np.uint16 else keys)
    direct = direct[np.argsort(keys.view(f"S{keys.shape[1] * keys.itemsize}").ravel(), kind="stable")] if len(direct) else direct
    del keys
    first = text[direct]
    own = np.searchsorted(first, np.arange(257))
    # Scans in order of first bytes: each suffix places its predecessor, unless that was sorted directly.
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    placed[text[n - 1]].append(np.array([n - 1], dtype=np.int64))
    out = []

    def before(suffixes: np.ndarray) -> np.ndarray:
        p = suffixes[suffixes > 0] - 1
        return p[~smaller[p]]

    for c in range(256):
        large, wave = [], np.concatenate(placed[c]) if placed[c] else direct[:0]
        while len(wave):  # runs of c: each wave starts one byte earlier and is larger than the wave before
            large.append(wave)
            p = before(wave)
            wave = p[text[p] == c]
        bucket = np.concatenate([*large, direct[own[c] : own[c + 1]]])
        out.append(bucket)
        p = before(bucket)
        p = p[text[p] > c]
        if len(p):
            order = np.argsort(text[p], kind="stable")
            p, heads = p[order], text[p[order]]
            for at, end in zip(cuts := np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])), [*cuts[1:], len(p)]):
                placed[heads[at]].append(p[at:end])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` with the one before it, `most` at most (first: 0)."""
    out = np.zeros(len(order), dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([text.astype(np.int16), np.full(most, -1, dtype=np.int16)]), most)
    for i in range(1, len(order), 4096):
        a, b = order[i - 1 : min(len(order), i + 4096) - 1], order[i : i + 4096]
        differ = (view[a] != view[b]) | (view[a] < 0)
        out[i : i + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return out


def repeated_starts(regions: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per region, the starts whose `length` bytes also start elsewhere in these regions."""
    sizes = np.array([len(r) for r in regions])
    # UTF-8 has no byte 0xFF, so a zero can separate regions.
    text = np.frombuffer(b"".join(r + b"\xff" for r in regions), dtype=np.uint8) + np.uint8(1)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    order = suffix_array(text, length)
    region = np.repeat(np.arange(len(regions)), sizes + 1)
    valid = np.arange(len(text)) + length <= (begins + sizes)[region]
    order = order[valid[order]]
    equal = common_prefixes(text, order, length) >= length
    twice = equal | np.append(equal[1:], False)
    starts = np.sort(order[twice])
    owner = region[starts]
    return [starts[owner == i] - begins[i] for i in range(len(regions))] if len(regions) < 64 else np.split(starts - begins[owner], np.searchsorted(owner, np.arange(1, len(regions))))


def as_spans(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Sorted starts as covered ranges, one per stretch of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _runs(docs: DataFrame, length: int, k: int) -> DataFrame:
    """id, t, lo, hi (first and last start), fp (anchor) and r (the region, where its anchor stands included)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(2))
                row, lo, hi, anchor, fp = runs(data, offsets, length, k)
                raw = data.tobytes()
                r = np.array([int.from_bytes(blake2b(raw[a : b + length], digest_size=8, salt=(p - a).to_bytes(8, "little")).digest(), "little", signed=True) for a, b, p in zip(lo.tolist(), hi.tolist(), anchor.tolist())], dtype=np.int64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array((lo - offsets[row]).astype(np.int32)), pa.array((hi - offsets[row]).astype(np.int32)), pa.array(fp.astype(np.int64)), pa.array(r)], names=["id", "t", "lo", "hi", "fp", "r"])

    return docs.mapInArrow(run, "id bigint, t bigint, lo int, hi int, fp bigint, r bigint")


REGION = "fp bigint, hot boolean, id bigint, t bigint, lo int, open boolean, body binary"


def _regions(docs: DataFrame, length: int) -> DataFrame:
    """The regions that have to be compared: docs has id, t, text and runs (lo, hi, fp, flag, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for id_, t, text, own in zip(*(part.column(i).to_pylist() for i in range(4))):
                    raw = text.encode("utf-8", "surrogatepass")
                    rows += [(x["fp"], x["hot"], id_, t, x["lo"], x["flag"] == 2, raw[x["lo"] : x["hi"] + length]) for x in own if x["flag"]]
                if rows:
                    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["fp", "hot", "id", "t", "lo", "open", "body"])

    return docs.select("id", "t", "text", "runs").mapInArrow(run, REGION)


SPAN = "id bigint, t bigint, start int, end int"


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "t", "start", "end"])


def _sorted_spans(regions: DataFrame, length: int) -> DataFrame:
    """Spans of open regions that repeat in a region of the same anchor; anchors have MOST_REGIONS at most."""

    def solve(group: list[tuple]) -> list[tuple[int, int, int, int]]:
        out = []
        for (_, id_, t, lo, open_, _), starts in zip(group, repeated_starts([g[5] for g in group], length)):
            if open_:
                out += [(id_, t, lo + a, lo + b) for a, b in as_spans(starts, length)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size, spans = [], 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORTED_BYTES and row[0] != group[-1][0]:  # whole anchors only
                    spans += solve(group)
                    group, size = [], 0
                    if len(spans) > 10_000:
                        yield _span_batch(spans)
                        spans = []
                group.append(row)
                size += len(row[5])
        if group:
            spans += solve(group)
        if spans:
            yield _span_batch(spans)

    return regions.select("fp", "id", "t", "lo", "open", "body").repartition("fp").sortWithinPartitions("fp").mapInArrow(run, SPAN)


def window_hashes(data: np.ndarray, length: int, values: np.ndarray, step: np.uint64) -> np.ndarray:
    """64-bit hashes of all `length`-byte substrings: hashes of doubled spans, put together by the bits of `length`."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, span, out, done = values[data], 1, np.zeros(n, dtype=np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if length & span:
                out = out * step + h[done : done + n]
                done += span
            if span * 2 > length:
                return mix(out)
            h = h[:-span] * step + h[span:]
            step, span = step * step, span * 2


_HASHES = [(random_words(seed, 256), np.uint64(0x9E3779B97F4A7C15 + 2 * seed | 1)) for seed in (33, 34)]


def _counted_spans(regions: DataFrame, length: int) -> DataFrame:
    """The same for anchors with any number of regions: each string's 128-bit hash is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64 << 10):
                data, offsets = text_bytes(part.column(4))
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                start = np.arange(len(data) - length + 1 if len(data) >= length else 0)
                start = start[start + length <= offsets[row[start] + 1]]
                w1, w2 = (window_hashes(data, length, *h)[start].astype(np.int64) for h in _HASHES)
                take = row[start]
                column = lambda i: part.column(i).take(pa.array(take))
                at = part.column(2).to_numpy(zero_copy_only=False)[take] + start - offsets[take]
                yield pa.RecordBatch.from_arrays([column(0), column(1), pa.array(at.astype(np.int32)), column(3), pa.array(w1), pa.array(w2)], names=["id", "t", "start", "open", "w1", "w2"])

    each = stored(regions.select("id", "t", "lo", "open", "body").mapInArrow(run, "id bigint, t bigint, start int, open boolean, w1 bigint, w2 bigint"), "windows")
    twice = stored(each.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1"), "twice")
    return spread_join(each.where("open"), twice, ["w1", "w2"], "c").select("id", "t", "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (start and end in bytes) and kept (binary) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # t tells rows that share an id apart: 63 bits of the text's hash, and whether the id is null.
    t = F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(id_col).isNull().cast("long"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), t.alias("t"), text.alias("text"))
    own_id = F.when(F.col("t").bitwiseAND(F.lit(1)) == 0, F.col("id")).alias("id")
    every = stored(_runs(rows, length, k), "runs")
    anchors = every.groupBy("fp").agg(F.count("*").alias("c"), F.min("r").alias("lo_r"), F.max("r").alias("hi_r")).where("c > 1").select("fp", "c", (F.col("lo_r") == F.col("hi_r")).alias("equal"))
    every = stored(spread_join(every, stored(anchors, "anchors"), ["fp"], "c").drop("c"), "repeated")

    # Anchors with different regions: what occurs twice repeats, and one of its copies is compared with the rest.
    mixed = every.where("not equal")
    kinds = stored(mixed.groupBy("fp", "r").agg(F.count("*").alias("c"), F.min(F.struct("id", "t", "lo")).alias("rep")), "regions")
    size = kinds.groupBy("fp").agg(F.count("*").alias("size"))
    kinds = stored(spread_join(kinds, size, ["fp"], "size").withColumn("hot", F.col("size") > MOST_REGIONS), "kinds")
    flag = F.when(F.col("c") == 1, 2).when(F.col("rep") == F.struct("id", "t", "lo"), 1).otherwise(0)
    mixed = spread_join(mixed, kinds, ["fp", "r"], "c").select("id", "t", "lo", "hi", "fp", flag.alias("flag"), "hot")
    plain = every.where("equal").select("id", "t", "lo", "hi", "fp", F.lit(0).alias("flag"), F.lit(False).alias("hot"))
    by_doc = stored(plain.unionByName(mixed).groupBy("id", "t").agg(F.collect_list(F.struct("lo", "hi", "fp", "flag", "hot")).alias("runs")), "by_doc")
    touched = stored(rows.join(by_doc, ["id", "t"]), "touched")

    regions = stored(_regions(touched, length), "compare")
    spans = _sorted_spans(regions.where("not hot"), length).unionByName(_counted_spans(regions.where("hot"), length))
    found = spans.groupBy("id", "t").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    closed = F.transform(F.filter("runs", lambda x: x["flag"] < 2), lambda x: F.struct(x["lo"].alias("start"), (x["hi"] + length).alias("end")))
    touched = touched.select("id", "t", "text", closed.alias("closed")).join(found, ["id", "t"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for id_, own, closed, found in zip(*(c.to_pylist() for c in part.columns)):
                    raw = own.encode("utf-8", "surrogatepass")
                    spans, kept, at = [], [], 0
                    for a, b in sorted((x["start"], x["end"]) for x in [*closed, *(found or [])]):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    out.append((id_, len(raw), [{"start": a, "end": b} for a, b in spans], b"".join([*kept, raw[at:]])))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out), kinds)], names=["id", "n_bytes", "spans", "kept"])

    shape = "id bigint, n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary"
    changed = touched.select(own_id, "text", "closed", "found").mapInArrow(cut, shape)
    same = rows.join(by_doc.select("id", "t"), ["id", "t"], "left_anti").select(own_id, F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    out = changed.unionByName(same)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return out.select(F.col("id").cast(kind).alias(id_col), "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")


def kept_digest(kept: bytes) -> str:
    return sha256(kept).hexdigest()
