"""Shared pieces of the training-data operators: shared-folder tables, byte batches and hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and 0x09 to 0x0D.
WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text that one numpy pass handles; a longer text is handled alone and whole.
SLICE_BYTES = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`.

    Where a session on one machine names none (tests), a temporary folder is set up and named.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else f"file://{tempfile.mkdtemp(prefix='evisieve-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there.

    Lost executors cost only the tasks that read; nothing is computed anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evisieve/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Has the driver remove an intermediate table when it ends; frames that read it work until then."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


#: Keys that spread_join broadcasts at most.
HEAVY_KEYS = 1024


def spread_join(left: DataFrame, right: DataFrame, on: list[str], weight: str) -> DataFrame:
    """An inner join whose hot keys don't meet in one task.

    right: one row a key; `weight`: how many rows of `left` the key has. Keys with a HEAVY_KEYS-th of all these rows
    or more (so HEAVY_KEYS at most, whatever the size) are broadcast; the others are joined by shuffle.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * HEAVY_KEYS >= F.lit(total)
    heavy, light = F.broadcast(right.where(is_heavy)), right.where(~is_heavy)
    rest = left.join(heavy.select(on), on, "left_anti").join(light, on)
    return left.join(heavy, on).unionByName(rest)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """`make` over each Arrow batch of `df`; it gets slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system, Arrow's too: Python workers live on between tasks, and their peaks add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of `batch` whose string and binary bytes stay near `most`; one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.full(n, 16, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += np.diff(offsets_of(column))
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, one more than it has rows; nulls count as empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = column.buffers()[1]
    if raw is None or len(column) == 0:
        return np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(raw, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and where each row begins there (one more than rows). Null: empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = offsets_of(column)
    raw = column.buffers()[2]
    if raw is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def random_words(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """_STEP to the powers 0 to n - 1, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256) - 1, _STEP, dtype=np.uint64))])
    return _POWERS[:n]


class Words:
    """Splits bytes into maximal runs of word bytes and hashes each run to 64 bits.

    `classes` maps a byte to the byte it counts as, or to 0 for bytes that separate words. Hashes of two
    runs differ with probability 1 - 2**-64 or so; runs never cross the rows of a batch.
    """

    def __init__(self, classes: np.ndarray, seed: int = 11):
        self.word = classes > 0
        self.values = random_words(seed, 256)[classes]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """hash, first byte, byte past the end, row of each word in reading order."""
        empty = np.zeros(0, dtype=np.int64)
        if not len(data):
            return np.zeros(0, dtype=np.uint64), empty, empty, empty
        inside = self.word[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begins[cuts] |= inside[cuts]
        first = np.flatnonzero(begins)
        if not len(first):
            return np.zeros(0, dtype=np.uint64), empty, empty, empty
        at = np.flatnonzero(inside)
        start = np.searchsorted(at, first)
        length = np.diff(np.append(start, len(at)))
        local = np.arange(len(at)) - np.repeat(start, length)
        with np.errstate(over="ignore"):
            summed = np.add.reduceat(self.values[data[at]] * powers(int(length.max()))[local], start)
            hashes = mix(summed + length.astype(np.uint64) * _STEP)
        return hashes, first, first + length, np.searchsorted(offsets, first, side="right") - 1


def lowered() -> np.ndarray:
    """Byte classes: A-Z count as a-z, all else as itself; byte 0 counts as 255, which UTF-8 never holds."""
    classes = np.arange(256, dtype=np.uint8)
    classes[65:91] += 32
    classes[0] = 255
    return classes


def space_words(lower: bool = True) -> np.ndarray:
    """Classes for words `[^\\x20\\x09-\\x0D]+`."""
    classes = lowered() if lower else np.where(np.arange(256) == 0, 255, np.arange(256)).astype(np.uint8)
    classes[np.frombuffer(WHITE_SPACE, dtype=np.uint8)] = 0
    return classes


def alnum_words() -> np.ndarray:
    """Classes for words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of text with A-Z lower-cased."""
    classes = lowered()
    byte = np.arange(256)
    classes[(byte < 0x30) | ((byte >= 0x3A) & (byte <= 0x40)) | ((byte >= 0x5B) & (byte <= 0x60)) | ((byte >= 0x7B) & (byte <= 0x7F))] = 0
    return classes
