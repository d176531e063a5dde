"""Exact removal of word sequences that occurred earlier, by a compressed FM-index per shard.

A window is LENGTH consecutive words of a document. Its anchor is, of its GRAM-word sequences, the one with the least
hash (the leftmost of equals), so equal windows have equal anchors at equal distances. Consecutive window starts
with one anchor form a run; a run with its words is a region. Regions are dealt to shards by anchor: all occurrences of
a window meet in one shard, and each document streams only through the shards of its own anchors.

What occurs as a whole region again is settled by the region's hash: all but the first are repeats. Regions whose anchor
has others beside them go to a shard's index. It holds the words as symbols, in order of (doc_id, start): a wavelet matrix
over the Burrows-Wheeler transform (sorted to a depth of LENGTH, equal ones by position), where depth - 1
neighbours end, and the first position of each window that occurs twice. Regions then stream from right to left:
the interval of the LENGTH - 1 words to the right is widened from that of LENGTH, one word is added by backward search, and the
interval of each window (its matching statistics, up to LENGTH) tells how often it occurs and where first.

Whole anchors fill shards of SHARD_BYTES. An anchor whose own regions are more than that (a passage in very many different
surroundings) would overload its shard: its windows are counted one by one by a 128-bit hash, which spreads. Both ways see
every window, so the bound is on memory alone.

Defined results: null text has no words; documents ascend by doc_id, null first, and rows of one doc_id by a hash of their
text; rows equal in both are one document seen twice and don't repeat each other; texts with fewer words than
a window keep all; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, give_back, mix, random_words, slices, space_words, spread_join, stored, text_bytes

LENGTH, GRAM = 20, 4
#: Runs of an anchor, as a share of all, from which they meet by region; bytes of words that one shard's index holds.
HEAVY_ANCHORS, SHARD_BYTES = 1024, 320 << 10
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_WORDS = Words(space_words(lower=False))


class WaveletMatrix:
    """Symbols by bit planes, one bit a symbol and plane, with counts at every 64th: rank in one step a plane."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.planes = max(1, int(symbols.max()).bit_length()) if self.n else 1
        self.words, self.ranks, self.zeros = [], [], []
        current = symbols.astype(np.int64)
        for plane in range(self.planes - 1, -1, -1):
            bit = (current >> plane) & 1 == 1
            packed = np.packbits(np.append(bit, np.zeros(-self.n % 64 + 64, dtype=bool)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])
        # Where each symbol's stretch begins once all planes are dealt.
        values = np.arange(int(symbols.max()) + 1 if self.n else 1)
        self.starts = self.rank(values, np.zeros(len(values), dtype=np.int64), raw=True)

    def rank(self, symbol: np.ndarray, at: np.ndarray, raw: bool = False) -> np.ndarray:
        """How often each symbol stands before position `at` (raw: counted from the beginning of all stretches)."""
        for i in range(self.planes):
            plane = self.planes - 1 - i
            block = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ranks[i][block] + np.bitwise_count(self.words[i][block] & below)
            at = np.where((symbol >> plane) & 1 == 1, self.zeros[i] + ones, at - ones)
        return at if raw else at - self.starts[symbol]


class FMIndex:
    """Counts sequences of up to `depth` symbols in `symbols`, whose last one and only separators are 0."""

    def __init__(self, symbols: np.ndarray, depth: int = LENGTH):
        n, self.depth = len(symbols), depth
        self.n = n
        rank, span = symbols.astype(np.int64), 1

        def longer(rank: np.ndarray, by: int) -> np.ndarray:
            """Order by the sequences that begin here and `by` symbols on, one after the other."""
            second = np.append(rank[by:] + 1, np.zeros(min(by, n), dtype=np.int64))[:n]
            return np.unique(rank * (int(rank.max(initial=0)) + 2) + second, return_inverse=True)[1]

        while span * 2 < depth:
            rank, span = longer(rank, span), span * 2
        shorter, rank = (longer(rank, depth - 1 - span) if depth - 1 > span else rank), (longer(rank, depth - span) if depth > span else rank)
        order = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix(np.where(order > 0, symbols[order - 1], 0))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 1))])
        self.groups = np.append(np.flatnonzero(np.append(True, np.diff(shorter[order]) != 0)), n)
        heads = np.append(np.flatnonzero(np.append(True, np.diff(rank[order]) != 0)), n)
        many = np.flatnonzero(np.diff(heads) > 1)
        self.heads, self.earliest = heads[many], order[heads[many]]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of `symbol` followed by what the given intervals stand for."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[: len(symbol)], self.first[symbol] + both[len(symbol) :]

    def widen(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first depth - 1 symbols of a sequence of depth symbols."""
        i = np.searchsorted(self.groups, low, side="right")
        return self.groups[i - 1], self.groups[i]

    def intervals(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """low and high of the `depth` symbols from each position on (-1 where fewer are left in its range).

        Ranges of `symbols` stream from right to left, all at once, one symbol a step; they have to occur in the index.
        """
        low_of, high_of = np.full(len(symbols), -1, dtype=np.int64), np.full(len(symbols), -1, dtype=np.int64)
        order = np.argsort(begins - ends, kind="stable")
        begins, ends = begins[order], ends[order]
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n, dtype=np.int64)
        sizes = ends - begins
        for step in range(int(sizes.max(initial=0))):
            active = int(np.searchsorted(-sizes, -step, side="left"))
            if step >= self.depth:
                low[:active], high[:active] = self.widen(low[:active])
            at = ends[:active] - 1 - step
            low[:active], high[:active] = self.extend(symbols[at], low[:active], high[:active])
            if step >= self.depth - 1:
                low_of[at], high_of[at] = low[:active], high[:active]
        return low_of, high_of

    def earliest_of(self, low: np.ndarray) -> np.ndarray:
        """First position of the sequences of `depth` symbols that occur more than once."""
        return self.earliest[np.searchsorted(self.heads, low)]


def earlier(regions: list[list[bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """For regions in document order (lists of words): the starts of windows that also start earlier, and in which region and start."""
    flat = pa.array([w for r in regions for w in r], pa.binary()).dictionary_encode()
    sizes = np.array([len(r) for r in regions], dtype=np.int64)
    begins = np.cumsum(np.append(0, sizes[:-1] + 1))
    symbols = np.zeros(int(sizes.sum()) + len(regions), dtype=np.int64)
    inside = np.ones(len(symbols), dtype=bool)
    inside[begins + sizes] = False
    symbols[inside] = flat.indices.to_numpy() + 1
    index = FMIndex(symbols, length)
    low, high = index.intervals(symbols, begins, begins + sizes)
    twice = np.flatnonzero(high - low > 1)
    source = index.earliest_of(low[twice])
    keep = source != twice
    twice, source = twice[keep], source[keep]
    region, origin = np.searchsorted(begins, twice, side="right") - 1, np.searchsorted(begins, source, side="right") - 1
    return [region, twice - begins[region], origin, source - begins[origin]]


def window_sums(values: np.ndarray, length: int, step: np.uint64) -> np.ndarray:
    """Hashes of all `length` consecutive values: sums weighted by powers of `step`."""
    n = len(values) - length + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length if n > 0 else 0):
            out = out * step + values[i : i + n]
    return out


def runs(hashes: np.ndarray, row: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor: first start, last start, hash of the anchor, hash of the region's words."""
    empty = np.zeros(0, dtype=np.int64)
    n, wide = len(hashes), length - gram + 1
    if n < length:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = mix(window_sums(hashes, gram, _STEP))
    bits = np.uint64(max(20, int(n).bit_length()))
    value = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    least = np.lib.stride_tricks.sliding_window_view(value, wide).min(axis=1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    if not len(start):
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    own = anchor[start]
    at = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
    last = np.append(at[1:], len(start)) - 1
    low, high = start[at], start[last]
    with np.errstate(over="ignore"):
        weights = np.cumprod(np.append(np.uint64(1), np.full(n, _STEP, dtype=np.uint64)))
        undo = np.cumprod(np.append(np.uint64(1), np.full(n, _INVERSE, dtype=np.uint64)))
        sums = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(0xA5A5)) * weights[:n]))
        region = mix((sums[high + length] - sums[low]) * undo[low] + (high - low).astype(np.uint64))
    return low, high, grams[own[at]], region


#: Run positions as one number: first start times _PACK plus how many starts follow.
_PACK = 64


def _runs(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(2))
                hashes, _, _, row = _WORDS(data, offsets)
                low, high, fp, region = runs(hashes, row, length)
                begin = np.searchsorted(row, np.arange(part.num_rows))
                owner = row[low]
                take = pa.array(owner)
                at = (low - begin[owner]) * _PACK + high - low
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at), pa.array(fp.view(np.int64)), pa.array(region.view(np.int64))], names=["id", "t", "at", "fp", "r"])
        give_back()

    return rows.select("id", "t", "text").mapInArrow(run, "id bigint, t bigint, at bigint, fp bigint, r bigint")


REGION = "fp bigint, id bigint, t bigint, start int, body binary"
SPAN = "id bigint, t bigint, start int, end int"


def _batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])


_REGION_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
_SPAN_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _regions(touched: DataFrame, length: int) -> DataFrame:
    """The words of each run in `open` (fp, at) of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for id_, t, text, own in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.encode("utf-8", "surrogatepass").split()
                    for x in own:
                        start, more = divmod(x["at"], _PACK)
                        out.append((x["fp"], id_, t, start, b" ".join(words[start : start + more + length])))
                if out:
                    yield _batch(out, _REGION_KINDS, REGION)

    return touched.select("id", "t", "text", "open").mapInArrow(run, REGION)


def _indexed_spans(regions: DataFrame, length: int) -> DataFrame:
    """Spans of windows that start earlier in a region of the same anchor; whole anchors fill a shard."""

    def solve(group: list[tuple]) -> Iterator[tuple]:
        group.sort(key=lambda g: g[1:4])
        for region, start, origin, source in zip(*(x.tolist() for x in earlier([g[4] for g in group], length))):
            _, id_, t, lo, _ = group[region]
            _, id0, t0, lo0, _ = group[origin]
            if (id0, t0, lo0 + source) != (id_, t, lo + start):
                yield id_, t, lo + start, lo + start + length

    def joined(spans: Iterator[tuple]) -> Iterator[tuple]:
        """Spans that touch, as one."""
        last = None
        for s in spans:
            if last and s[:2] == last[:2] and last[2] <= s[2] <= last[3]:
                last = (*last[:3], max(last[3], s[3]))
            else:
                if last:
                    yield last
                last = s
        if last:
            yield last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, size = [], 0
        for batch in batches:
            for fp, id_, t, start, body in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and fp != group[-1][0]:
                    if spans := list(joined(solve(group))):
                        yield _batch(spans, _SPAN_KINDS, SPAN)
                    group, size = [], 0
                group.append((fp, id_, t, start, body.split()))
                size += len(body)
        if group and (spans := list(joined(solve(group)))):
            yield _batch(spans, _SPAN_KINDS, SPAN)
        give_back()

    return regions.select("fp", "id", "t", "start", "body").repartition("fp").sortWithinPartitions("fp").mapInArrow(run, SPAN)


_COUNTERS = [random_words(seed, 1)[0] for seed in (71, 72)]


def _counted_spans(regions: DataFrame, length: int) -> DataFrame:
    """The same for anchors with any number of regions: the first of each window is found by its 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 64 << 10):
                data, offsets = text_bytes(part.column(3))
                hashes, _, _, row = _WORDS(data, offsets)
                if len(hashes) < length:
                    continue
                start = np.flatnonzero(row[: len(row) - length + 1] == row[length - 1 :])
                w1, w2 = (mix(window_sums(mix(hashes ^ c), length, _STEP))[start].view(np.int64) for c in _COUNTERS)
                owner = row[start]
                take = pa.array(owner)
                at = part.column(2).to_numpy(zero_copy_only=False)[owner] + start - np.searchsorted(row, np.arange(part.num_rows))[owner]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2)], names=["id", "t", "start", "w1", "w2"])

    own = F.struct("id", "t", "start")
    each = stored(regions.select("id", "t", "start", "body").mapInArrow(run, "id bigint, t bigint, start int, w1 bigint, w2 bigint"), "windows")
    twice = stored(each.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(own).alias("head")).where("c > 1"), "twice")
    return spread_join(each, twice, ["w1", "w2"], "c").where(own != F.col("head")).select("id", "t", "start", (F.col("start") + length).alias("end"))


def repeats(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Word spans of rows (id, t, text) that windows cover which also start earlier: id, t, found (start and end, some overlapping)."""
    every = stored(_runs(rows, length), "runs")
    top = every.agg(F.expr(f"approx_top_k(fp, {HEAVY_ANCHORS}, {64 * HEAVY_ANCHORS})").alias("top"), F.count("*").alias("total"))
    top = top.select("total", F.explode("top").alias("x")).where(F.col("x.count") * HEAVY_ANCHORS >= F.col("total"))
    heavy = [r[0] for r in top.select("x.item").collect()]  # HEAVY_ANCHORS numbers at most
    own, every = F.struct("id", "t", "at"), every.withColumn("hot", F.col("fp").isin(heavy))
    # Of these anchors, regions that are as frequent themselves: HEAVY_ANCHORS at most, with their first place.
    pairs = every.where("hot").groupBy("fp", "r").agg(F.count("*").alias("c"), F.min(own).alias("least"))
    pairs = stored(pairs.where(F.col("c") * HEAVY_ANCHORS >= every.count()).select("fp", "r", "least"), "pairs")
    every = every.join(F.broadcast(pairs), ["fp", "r"], "left")
    # Runs meet by anchor; those of a frequent anchor by region, and those of a frequent region not at all.
    meets = F.when(F.col("least").isNotNull(), F.xxhash64("id", "t", "at")).when(F.col("hot"), F.xxhash64("fp", "r")).otherwise(F.col("fp"))
    by_anchor, by_region = Window.partitionBy("g", "fp"), Window.partitionBy("g", "fp", "r")
    flagged = every.withColumn("g", meets).select(
        "id", "t", "at", "fp", (F.col("hot") | (F.min("r").over(by_anchor) != F.max("r").over(by_anchor))).alias("mixed"), (F.coalesce("least", F.min(own).over(by_region)) == own).alias("head")
    ).where("mixed or not head")
    # Copies are repeats from end to end; heads have to be compared with what else their anchor has.
    start = F.call_function("div", F.col("at"), F.lit(_PACK))
    span = F.struct(start.cast("int").alias("start"), (start + F.col("at") % _PACK + length).cast("int").alias("end"))
    by_doc = flagged.groupBy("id", "t").agg(F.collect_set(F.when(F.col("head"), F.struct("fp", "at"))).alias("open"), F.collect_set(F.when(~F.col("head"), span)).alias("closed"))
    by_doc = stored(by_doc, "by_doc")
    touched = rows.join(by_doc.where(F.size("open") > 0).select("id", "t", "open"), ["id", "t"])
    regions = stored(_regions(touched, length), "regions")
    crowded = regions.groupBy("fp").agg(F.sum(F.octet_length("body")).alias("bytes")).where(F.col("bytes") > SHARD_BYTES).select("fp")
    crowded = stored(crowded, "crowded")
    spans = _indexed_spans(regions.join(crowded, "fp", "left_anti"), length).unionByName(_counted_spans(regions.join(crowded, "fp", "left_semi"), length))
    found = spans.unionByName(by_doc.select("id", "t", F.explode("closed").alias("x")).select("id", "t", "x.start", "x.end"))
    return stored(found.groupBy("id", "t").agg(F.collect_set(F.struct("start", "end")).alias("found")), "spans")


def remove_earlier(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans (start and end in words) and kept (words joined by one space) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Null ids come first: they share the least id, and their t is below all others.
    half = F.shiftrightunsigned(F.xxhash64(text), 1)
    t = F.when(F.col(id_col).isNull(), -half - 1).otherwise(half)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), t.alias("t"), text.alias("text"))
    spans = repeats(rows, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        for batch in batches:
            for part in slices(batch):
                out = []
                for id_, text, found in zip(*(c.to_pylist() for c in part.columns)):
                    words = text.encode("utf-8", "surrogatepass").split()
                    merged: list[list[int]] = []
                    for a, b in sorted((x["start"], x["end"]) for x in found or []):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    kept, at = [], 0
                    for a, b in merged:
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    out.append((id_, len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in merged], b" ".join(kept).decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["id", "n_words", "n_removed", "spans", "kept"])
        give_back()

    shape = "id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept string"
    own_id = F.when(F.col("t") >= 0, F.col("id")).alias("id")
    out = rows.join(spans, ["id", "t"], "left").select(own_id, "text", "found").mapInArrow(cut, shape)
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
