"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct word shingles, as 64-bit hashes. Register i is the truncated minimum of an
exponentially distributed hash over the set, spaced by powers of BASE: merging two sketches is the maximum of
each register, and equal registers grow likelier with similarity. Documents with equal sets are one class;
class representatives meet where a band of register values is equal. A pair's similarity is estimated by
maximum likelihood from how many registers are larger, smaller and equal, given both set sizes; pairs far
below the threshold go, all others are verified on their full sets.

No group is expanded into all its pairs. Within each band bucket everyone is first compared with one hub, the
member that shares the most buckets, and only with the hub of most of its buckets; verified links give components. Then, in
buckets that still hold several components, the members outside the largest are compared with all members of
other components; in large buckets only those pairs are made that can be linked by their counts of rare
shingles (rare_shingles, bucket_pairs). Two things can miss a link: a pair may share fewer bands than
Rule.shared asks for, and the estimate may fall below Rule.floor. With 32 bands of 5 registers the first has
probability 1.9e-7 at similarity 0.85 and 3e-6 at 0.80, the second under 1e-7; what is linked is exact.

Defined results: null, empty and wordless texts have an empty set and stay alone; a text of fewer words than
a shingle is one shingle; repeated rows repeat, and rows that share an id are one document; ids must be
integers that aren't null (rows with a null id stay alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, give_back, mix, random_words, slices, space_words, stored, text_bytes

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65534
CACHED = 4096
#: Buckets of more members are searched by rare shingles, those that so many of their documents hold at most.
MOST_DIRECT, RARE = 64, 16
_words = Words(space_words())
_SALT = (random_words(21, REGISTERS) >> np.uint64(32)).astype(np.uint32)
_FACTOR = (random_words(22, REGISTERS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_STEPS = random_words(23, 64) | np.uint64(1)
_BAND = random_words(24, ROWS) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    hashes, _, _, row = _words(data, offsets)
    n = np.bincount(row, minlength=len(column))
    ends = np.cumsum(n)
    with np.errstate(over="ignore"):
        joined = hashes * _STEPS[0]
        for i in range(1, words):
            joined[: len(hashes) - i] += hashes[i:] * _STEPS[i]
        joined = mix(joined)
        out = []
        for k, end in zip(n.tolist(), ends.tolist()):
            if k >= words:
                out.append(np.unique(joined[end - k : end - words + 1]))
            elif k:
                out.append(mix(np.array([np.sum(hashes[end - k : end] * _STEPS[words : words + k]) + np.uint64(k)], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set: one 16-bit register per hash function; all 0 for the empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, dtype=np.uint16)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), 1024):
            h = (low[None, i : i + 1024] ^ _SALT[:, None]) * _FACTOR[:, None]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x846CA68B)
            np.minimum(least, h.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / log(BASE)), 0, TOP).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of register values."""
    with np.errstate(over="ignore"):
        return mix((sketch.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs from registers (pair x register) and set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = chance(u - v * j), chance(v - u * j)
        return above * np.log(p) + below * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (hi - lo) / 3
        left = likelihood(lo + third) >= likelihood(hi - third)
        lo, hi = np.where(left, lo, lo + third), np.where(left, hi - third, hi)
    return (lo + hi) / 2


@dataclass(frozen=True)
class Rule:
    """Shingles of `words` words; linked if den * intersection >= num * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def floor(self) -> float:
        """Estimates below it belong to linked pairs with probability under 1e-7."""
        j = self.num / self.den
        return j - 5.5 * (j * (1 - j) / REGISTERS) ** 0.5

    @property
    def shared(self) -> int:
        """Linked pairs share this many bands or more, but for one in a million."""
        p = (self.num / self.den) ** ROWS
        t, below = 0, (1 - p) ** BANDS
        while below < 1e-6:
            t += 1
            below += comb(BANDS, t) * p**t * (1 - p) ** (BANDS - t)
        return max(1, t)


def sketches(docs: DataFrame, rule: Rule) -> DataFrame:
    """id, n (set size), k1 and k2 (digest of the set), sketch and band keys of each row (docs: id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[bytes, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1), rule.words)
                keys, sketch, bands = [], [], []
                for s in sets:
                    key = blake2b(s.tobytes(), digest_size=16).digest()
                    if key not in seen:
                        if len(seen) >= CACHED:
                            seen.clear()
                        r = registers(s)
                        seen[key] = (r.tobytes(), band_keys(r).astype(np.int64))
                    keys.append(key)
                    sketch.append(seen[key][0])
                    bands.append(seen[key][1])
                halves = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sketch, pa.binary()), lists], names=["id", "n", "k1", "k2", "sketch", "bands"])
        give_back()

    return docs.mapInArrow(run, "id bigint, n bigint, k1 bigint, k2 bigint, sketch binary, bands array<bigint>")


def estimated(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose estimated similarity may reach the threshold, with the estimate."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [np.frombuffer(b"".join(part.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (4, 5)]
                j = likely_similarity(*rows, *(part.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3)))
                keep = np.flatnonzero(j >= rule.floor)
                if len(keep):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), pa.array(j[keep])], names=["a", "b", "j"])
        give_back()

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a bigint, b bigint, j double")


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                ids = part.column(1).to_pylist()
                new = {b: i for i, b in enumerate(ids) if b not in known}
                if len(known) + len(new) > 64:
                    known.clear()
                    new = {b: i for i, b in enumerate(ids)}
                known.update(zip(new, shingle_sets(part.column(3).take(pa.array(list(new.values()), pa.int64())), rule.words)))
                keep = []
                for i, (b, s) in enumerate(zip(ids, shingle_sets(part.column(2), rule.words))):
                    both = len(np.intersect1d(s, known[b], assume_unique=True))
                    keep.append(rule.den * both >= rule.num * (len(s) + len(known[b]) - both))
                keep = pa.array(np.flatnonzero(keep))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], names=["a", "b"])
        give_back()

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node that has an edge (a, b), by alternating large and small stars."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.distinct(), "stars")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def rare_shingles(ids: DataFrame, found: DataFrame, known: DataFrame, texts: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents with how many rare shingles the given ones (id) have, and their pairs that share some.

    A shingle is rare if at most RARE of the given documents hold it. A pair of these that can be linked either
    shares rare shingles, and is found here by them; or it shares none, and bucket_pairs() rules it out by counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1), rule.words)
                rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                if len(rows):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate(sets).astype(np.int64))], names=["id", "g"])
        give_back()

    each = stored(texts.join(ids, "id", "left_semi").mapInArrow(run, "id bigint, g bigint").distinct(), "shingles")  # rows may share an id
    # One pass counts all shingles; those of a single document need no join, and those of many aren't joined.
    count = stored(each.groupBy("g").agg(F.count("*").alias("df"), F.min("id").alias("one")).where(F.col("df") <= RARE), "counts")
    alone = count.where("df = 1").groupBy(F.col("one").alias("id")).agg(F.count("*").alias("alone"))
    # With shingles in order of how many hold them, the first one that a linked pair shares stands early in both, and
    # what follows it on either side bounds what else they share.
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "g"))
    rare = stored(each.join(count.where("df > 1").select("g", "df"), "g").withColumn("at", place).select("g", "id", "at"), "rare")
    few = rare.groupBy("id").agg(F.count("*").alias("few"))
    own = ids.join(known.select("id", "n"), "id").join(alone, "id", "left").join(few, "id", "left").join(found, "id", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    own = stored(own.select("id", "n", number("alone").alias("alone"), (number("alone") + number("few")).alias("r"), F.coalesce("component", "id").alias("component")), "sizes")
    rare = rare.join(own, "id").withColumn("at", F.col("at") + F.col("alone")).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * rule.num / F.lit(rule.den)) + 1)
    side = lambda c: rare.select("g", F.col("id").alias(c), F.col("at").alias(f"at_{c}"), F.col("n").alias(f"n_{c}"), F.col("component").alias(f"c_{c}"))
    shared = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = rule.den * shared >= rule.num * (F.col("n_a") + F.col("n_b") - shared)
    by = side("a").join(side("b"), "g").where(F.expr("a < b and c_a != c_b") & fits).select("a", "b").distinct()
    by = by.withColumn("times", F.lit(rule.shared))  # as if they shared enough bands: the estimate decides
    counted = own.select("id", "r", F.lit(True).alias("counted"))
    sized = known.select("id", "n").join(counted, "id", "left").select("id", "n", F.coalesce("r", F.lit(0).cast("long")).alias("r"), F.coalesce("counted", F.lit(False)).alias("counted"))
    return sized, by


def reachable(rule: Rule, n_a: str, n_b: str, only_a: Column, only_b: Column) -> Column:
    """False for pairs that can't be linked: sizes, and how many elements of each the other is known to lack."""
    n_a, n_b = F.col(n_a), F.col(n_b)
    return rule.den * F.least(n_a - only_a, n_b - only_b) >= rule.num * F.greatest(n_a, n_b, n_b + only_a, n_a + only_b)


def bucket_pairs(placed: DataFrame, sized: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b, times) of different components that share buckets and can be linked, as far as counts tell.

    placed: band, id, component, main; sized: id, n, r, counted. Rare shingles count only between two documents
    that were counted. In heavy buckets members that can't reach the threshold with any partner of their bucket's
    sizes are left out before the join, other pairs in its condition. Counted documents carry their buckets (as
    many as bands at most), so that a pair of them comes once, in the first bucket that it shares.
    """
    rows = placed.join(sized, "id")
    own = rows.where("counted").groupBy("id").agg(F.sort_array(F.collect_set("band")).alias("bands"))
    rows = rows.join(own, "id", "left")
    least = rows.groupBy("band").agg(F.min("n").alias("least"))
    rows = rows.join(least, "band")
    # A partner has num / den of the own size at least, and the bucket's least size at least; all of a heavy bucket are counted.
    partner = F.greatest("least", F.floor(F.col("n") * rule.num / rule.den))
    rows = rows.where(~F.col("heavy") | (rule.den * (F.col("n") - F.col("r")) >= rule.num * F.greatest(F.col("n"), partner + F.col("r"))))
    rows = rows.select("band", F.col("id").alias("b"), F.col("component").alias("c_b"), "main", F.col("n").alias("n_b"), F.col("r").alias("r_b"), F.col("counted").alias("k_b"), F.col("bands").alias("bands_b"))
    x = rows.where("c_b != main").select("band", F.col("b").alias("a"), F.col("c_b").alias("c_a"), F.col("n_b").alias("n_a"), F.col("r_b").alias("r_a"), F.col("k_b").alias("k_a"), F.col("bands_b").alias("bands_a"))
    both = F.col("k_a") & F.col("k_b")
    only = lambda c: F.when(both, F.col(c)).otherwise(0)
    fits = reachable(rule, "n_a", "n_b", only("r_a"), only("r_b"))
    shared = F.array_intersect("bands_a", "bands_b")
    once = ~both | ((F.get(shared, F.lit(0)) == x["band"]) & (F.size(shared) >= rule.shared))
    sides = (F.col("c_b") == F.col("main")) | (F.col("a") < F.col("b"))
    joined = x.join(rows, (x["band"] == rows["band"]) & (F.col("c_a") != F.col("c_b")) & sides & fits & once)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(both, rule.shared).otherwise(1).alias("times"))


def near_duplicates(docs: DataFrame, rule: Rule | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id that links reach) and kept (the id is its component's) of each row."""
    rule = rule or Rule()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stored(sketches(rows, rule), "sketches")
    # Classes of equal sets; equal rows are combined before the shuffle.
    classes = stored(sketched.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "classes")
    member = classes.select("id", F.explode("bands").alias("band"))
    full = member.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("band", "c")
    member = stored(member.join(full, "band"), "buckets")
    busy = member.groupBy("id").agg(F.sum("c").alias("shared"))
    texts = stored(rows.join(busy.select("id"), "id", "left_semi"), "texts")
    known = classes.select("id", "n", "sketch").join(busy.select("id"), "id", "left_semi")
    known = stored(known, "sketched")

    # Everyone against one hub: the one that is hub of most of its buckets. Whatever this misses is left to the pairs below.
    ranked = member.select("band", "id").join(busy, "id")
    hubs = ranked.groupBy("band").agg(F.max(F.struct("shared", -F.col("id"))).alias("h")).select("band", (-F.col("h.col2")).alias("hub"))
    tried = member.select("band", F.col("id").alias("a")).join(hubs, "band").where("a != hub").groupBy("a", "hub").count()
    tried = tried.groupBy("a").agg(F.max(F.struct("count", -F.col("hub"))).alias("x")).select("a", (-F.col("x.col2")).alias("b"))
    tried = stored(estimated(tried, known, rule).select("a", "b"), "hubs")
    links = stored(verified(tried, texts, rule), "links")
    found = stored(components(links), "components")

    # In buckets that still hold several components: members outside the largest against all others.
    placed = member.select("band", "id").join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("band", (F.col("c") > MOST_DIRECT).alias("heavy"))
    placed = stored(placed.join(open_, "band"), "open")
    main = placed.groupBy("band", "component").count().groupBy("band").agg(F.max(F.struct("count", -F.col("component"))).alias("x")).select("band", (-F.col("x.col2")).alias("main"))
    placed = placed.join(main, "band")
    sized = known.select("id", "n", F.lit(0).cast("long").alias("r"), F.lit(False).alias("counted"))
    by_rare = None
    if not placed.where("heavy").isEmpty():
        sized, by_rare = rare_shingles(placed.where("heavy").select("id").distinct(), found, known, texts, rule)
    pairs = bucket_pairs(placed, sized, rule)
    if by_rare is not None:
        pairs = pairs.unionByName(by_rare)
    pairs = pairs.groupBy("a", "b").agg(F.sum("times").alias("times")).where(F.col("times") >= rule.shared).select("a", "b")
    more = stored(estimated(pairs, known, rule).select("a", "b").distinct(), "pairs")
    more = stored(verified(more, texts, rule), "links")
    found = stored(components(links.unionByName(more)), "components")

    # Rows take their class's component.
    named = classes.select("k1", "k2", "id").join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    out = sketched.select("id", "n", "k1", "k2").join(named, ["k1", "k2"], "left")
    out = out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

