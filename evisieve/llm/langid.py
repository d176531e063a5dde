"""Language identification with bit-sliced Bloom filters over n-grams.

Each slot of the table holds one bit per language, so three look-ups and two ANDs return the set of all
languages that hold an n-gram. A text's count for a language, less the hits that come by chance, over its n-grams
is that language's share; the largest share decides. A hit comes by chance if an n-gram shares its GRAM_BITS bits with
one of the filter's, or if the filter's load has all its slots set.

Training reads a bounded sample: for each language at most BUCKETS * PER_BUCKET documents, those with the
lowest hash of their id in each hash bucket. An n-gram enters the filter of every language in which it is at
least SHARE times as frequent as where it is most frequent. N-grams are hashed to GRAM_BITS bits, and each reaches the
driver once, with the bits of its languages, which bounds what it gets. MOST_LANGUAGES are learned, those with the most
sampled documents.

Defined results: null texts and texts without a letter are `und` with score 0; rows without a language, or of
one that has no sampled document, don't train; ties go to the language first in order of its sampled
documents, then by name; with nothing to learn from every text is `und`; repeated rows repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, mix, slices, stored

BUCKETS, PER_BUCKET = 32, 16
LENGTHS = (3, 5)
GRAM_BITS, SLOT_BITS, HASHES = 22, 21, 3
SHARE, LEAST = 0.3, 3
#: A language more costs a bit in each of 2**SLOT_BITS slots: 64 MB in all.
MOST_LANGUAGES = 256
UNKNOWN = "und"
_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[:128] = True
_SEPARATES[65:91] = _SEPARATES[97:123] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SEPARATES] = 32


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the row of each. N-grams run over bytes with A-Z lower-cased and
    every run of other ASCII characters as one space; a text begins and ends with a space."""
    own = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" " + b" \n ".join(own) + b" ", dtype=np.uint8)]
    kept = np.ones(len(data), dtype=bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
    begins = np.concatenate([[0], np.cumsum([len(t) + 3 for t in own])[:-1]]).astype(np.int64) if own else np.zeros(0, np.int64)
    starts = (np.cumsum(kept) - 1)[begins] if own else begins  # each row's leading space, which ends the row before
    data = data[kept]
    row = np.repeat(np.arange(len(own), dtype=np.int32), np.diff(np.append(starts, len(data)))) if own else np.zeros(0, np.int32)
    last = np.append(starts[1:], len(data) - 1)
    wide = data.astype(np.uint64)
    all_hashes, all_rows = [], []
    for n in LENGTHS:
        m = len(wide) - n + 1
        if m <= 0 or not own:
            continue
        code = np.full(m, n, dtype=np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i : i + m]
        inside = np.arange(m) + (n - 1) <= last[row[:m]]
        all_hashes.append(mix(code[inside]))
        all_rows.append(row[:m][inside])
    if not all_hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    return np.concatenate(all_hashes), np.concatenate(all_rows)


@dataclass
class Filters:
    """The table (a row per word of languages, a column per slot), its languages and each filter's chance of a false hit.

    Bit i % bits of word i // bits belongs to languages[i].
    """

    languages: list[str]
    table: np.ndarray
    false_hits: np.ndarray

    @property
    def bits(self) -> int:
        return self.table.dtype.itemsize * 8

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Word x n-gram: the bit set of the languages whose filter holds it."""
        slots = np.uint64(self.table.shape[1] - 1)
        out = self.table[:, (hashes & slots).astype(np.int64)]
        for i in range(1, HASHES):
            out = out & self.table[:, ((hashes >> np.uint64(SLOT_BITS * i)) & slots).astype(np.int64)]
        return out

    def holds(self, masks: np.ndarray, language: int) -> np.ndarray:
        """0 or 1 for each n-gram."""
        own = masks[language // self.bits]
        return (own >> own.dtype.type(language % self.bits)) & own.dtype.type(1)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """Row x language: the share of n-grams that the language holds, corrected for false hits, 0 to 1."""
        hashes, rows = grams(texts)
        masks = self.masks(reduced(hashes))
        total = np.maximum(np.bincount(rows, minlength=len(texts)), 1)
        out = np.zeros((len(texts), len(self.languages)))
        for i, wrong in enumerate(self.false_hits):
            hit = np.bincount(rows, weights=self.holds(masks, i).astype(np.float64), minlength=len(texts)) / total
            out[:, i] = np.clip((hit - wrong) / (1 - wrong), 0, 1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        shares = self.shares(texts)
        best = shares.argmax(axis=1)
        return [(self.languages[b], float(s[b])) if t and any(map(str.isalpha, t)) else (UNKNOWN, 0.0) for t, b, s in zip(texts, best, shares)]


def reduced(hashes: np.ndarray) -> np.ndarray:
    """The hash that filters see: made from the GRAM_BITS bits by which n-grams are counted."""
    return mix(hashes >> np.uint64(64 - GRAM_BITS))


def build_filters(languages: list[str], codes: np.ndarray, members: np.ndarray) -> Filters:
    """codes: the GRAM_BITS bits of what enters the filters, each once; members: word x code, the bits of its languages."""
    table = np.zeros((max(1, len(members)), 1 << SLOT_BITS), dtype=members.dtype)
    hashes = mix(codes.astype(np.uint64))
    for k in range(HASHES):
        slots = ((hashes >> np.uint64(SLOT_BITS * k)) & np.uint64(table.shape[1] - 1)).astype(np.int64)
        for word, own in zip(table, members):
            np.bitwise_or.at(word, slots, own)
    out = Filters(languages, table, np.zeros(len(languages)))
    for i in range(len(languages)):
        load, share = out.holds(table, i).mean(), float(out.holds(members, i).sum()) / 2**GRAM_BITS
        out.false_hits[i] = 1 - (1 - load**HASHES) * (1 - share)
    return out


def train(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from a bounded sample of the rows for which `learns` holds and the language is known."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    rows = docs.where(learns & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), h.alias("h"))
    order = Window.partitionBy("lang", "bucket").orderBy("h", "id")
    sample = rows.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))).withColumn("rank", F.row_number().over(order)).where(f"rank <= {PER_BUCKET}").select("id", "lang")
    # At most BUCKETS * PER_BUCKET ids a language, so the join's small side is bounded.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.distinct()), "id").select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                langs = np.array(part.column(0).to_pylist(), dtype=object)
                for language in dict.fromkeys(langs.tolist()):
                    own = [t for t, x in zip(part.column(1).to_pylist(), langs) if x == language]
                    values, n = np.unique(grams(own)[0] >> np.uint64(64 - GRAM_BITS), return_counts=True)
                    docs = np.zeros(len(values), dtype=np.int64)
                    docs[:1] = len(own)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(docs)], names=["lang", "gram", "n", "docs"])

    counted = texts.mapInArrow(count, "lang string, gram bigint, n bigint, docs bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = stored(counted, "grams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    languages = [r["lang"] for r in totals.orderBy(F.col("docs").desc(), "lang").limit(MOST_LANGUAGES).collect()]
    if not languages:
        return build_filters([], np.zeros(0, np.uint64), np.zeros((1, 0), np.uint8))
    number = spark_rows(docs, [(x, i) for i, x in enumerate(languages)], "lang string, i int")
    own = totals.select("lang", "total").join(F.broadcast(number), "lang")  # MOST_LANGUAGES rows
    rated = counted.select("lang", "gram", "n").join(F.broadcast(own), "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = F.max("rate").over(Window.partitionBy("gram"))  # as many rows as there are languages
    found = rated.withColumn("most", most).where((F.col("rate") >= SHARE * F.col("most")) & (F.col("n") >= LEAST))
    bits = 8 if len(languages) <= 8 else 64
    words = range(-(-len(languages) // bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % bits)
    members = [F.coalesce(F.bit_or(F.when(F.call_function("div", F.col("i"), F.lit(bits)) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}") for w in words]
    got = found.groupBy("gram").agg(*members).toArrow()  # at most 2**GRAM_BITS rows
    kind = np.uint8 if bits == 8 else np.uint64
    return build_filters(languages, got["gram"].to_numpy().astype(np.uint64), np.stack([got[f"w{w}"].to_numpy().astype(np.int64).view(np.uint64).astype(kind) for w in words]))


def spark_rows(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def identify(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred and score of each row, and the columns in `keep`."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**SLOT_BITS slots
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(id_col, *keep).schema)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = shared.value.predict(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    return map_batches(docs.select(F.col(text_col).alias("__text"), id_col, *keep), make, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no training may read: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
