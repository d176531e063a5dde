"""BPE encoding and decoding with content-defined chunks.

A rolling hash over the bytes cuts each text where its value meets a mask, so passages that documents share are
cut alike. Each distinct chunk is encoded and decoded once per worker and kept in a bounded cache, from which all
documents take it. A cut may fall inside a piece, so every join is repaired: the text around it, REACH pieces
between white space on either side, is encoded again. The repair holds if both chunks end there in the tokens
that these pieces have on their own, and if the new tokens begin and end with those of the outer half of the
pieces: then it agrees exactly with what stays of both chunks. Otherwise the reach doubles, and where it would
pass a chunk's middle the two chunks become one, up to the whole text. The vocabulary file is a parameter; files
with steps that don't work piece by piece are refused.

Most chunks are met once, so what a chunk shares with others are its pieces: their ids are kept as well, in a memo
of CACHED_PIECES. In ASCII text, full stops and commas after a letter or digit count as pieces of their own and, if the
file lower-cases, letters as lower case, which leaves fewer distinct pieces. Results are tested against
whole-text encoding by the library.

Defined results: null and empty texts have no token; any length is encoded whole; repeated rows repeat.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, random_words

CHUNK_MASK = np.uint64((1 << 12) - 1)
CHUNK_LEAST, CHUNK_MOST = 1024, 32768
WINDOW = 16
REACH = 2
CACHED_BYTES, CACHED_PIECES = 48 << 20, 350_000
_STOP = re.compile(rb"(?<=[A-Za-z0-9])[.,](?=[ \n])")
#: Steps of a vocabulary file that look at one piece between white space at a time.
NORMALISERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_GEAR = random_words(5, 256)


def cut_points(data: np.ndarray) -> list[int]:
    """Where chunks of `data` end: by a rolling hash of the last 16 bytes, never inside a code point."""
    n = len(data)
    if n <= CHUNK_LEAST:
        return [n]
    with np.errstate(over="ignore"):
        rolled, span = _GEAR[data], 1
        while span < WINDOW:  # rolled[i] covers the last `span` bytes
            shifted = rolled[:-span] << np.uint64(span)
            rolled = rolled.copy()
            rolled[span:] += shifted
            span *= 2
    hits = np.flatnonzero(((rolled >> np.uint64(20)) & CHUNK_MASK) == 0) + 1
    out, at = [], 0
    for hit in [*hits.tolist(), n]:
        while hit - at > CHUNK_MOST:
            at = _aligned(data, at + CHUNK_MOST)
            out.append(at)
        if hit == n or hit - at >= CHUNK_LEAST:
            at = _aligned(data, hit)
            if not out or at > out[-1]:
                out.append(at)
    return out


def _aligned(data: np.ndarray, at: int) -> int:
    while at < len(data) and (int(data[at]) & 0xC0) == 0x80:
        at += 1
    return at


def check_file(path: str) -> tuple[bool, list[bytes]]:
    """Whether the file lower-cases, and its added tokens.

    Raises ValueError unless pieces between white space have the same tokens alone as in a text, full stops and commas
    are tokens of their own, and decoding joins tokens by one space: that needs the steps that are named here.
    """
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model, split = own["model"], own["pre_tokenizer"]
    steps = own["normalizer"]
    steps = [] if steps is None else steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    if model["type"] != "BPE" or own["decoder"] is not None or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback")):
        raise ValueError("only BPE without dropout, unknown tokens, prefixes and a decoder step can be put together from chunks")
    if not all(s in NORMALISERS for s in steps):
        raise ValueError("the file has a normaliser that isn't known to work piece by piece")
    if split is None or split["type"] != "Sequence" or split["pretokenizers"] != SPLITTERS:
        raise ValueError("the file has other splitting steps than those that leave white space out and punctuation alone")
    added = [t["content"] for t in own.get("added_tokens") or []]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in own.get("added_tokens") or []) or any(t.split() != [t] for t in added):
        raise ValueError("the file has added tokens that look at what is around them")
    return {"type": "Lowercase"} in steps, [t.encode() for t in added]


class Encoder:
    """Encodes and decodes with one vocabulary file, keeping chunks it has seen.

    An encoding is a list of ids; `encoded`, `reused` and `widened` count chunks and joins over the worker's life.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lowers, self.added = check_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunks: dict[bytes, array] = {}
        self.memo: dict[bytes, tuple[int, ...]] = {}
        self.held = self.encoded = self.reused = self.widened = 0
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.decimal = [b"%d" % i for i in range(size)]
        self.token = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]

    def pieces(self, text: bytes) -> list[bytes]:
        """Pieces between white space of a text with the same tokens and fewer distinct pieces."""
        if text.isascii() and not any(t in text for t in self.added):  # added tokens keep their case
            text = _STOP.sub(rb" \g<0>", text.lower() if self.lowers else text)
        return text.split()

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of each text, as a whole; pieces that aren't in the memo go through the library."""
        split = [self.pieces(t) for t in texts]
        found = [list(map(self.memo.get, own)) for own in split]
        fresh = list({p for own, got in zip(split, found) if None in got for p, ids in zip(own, got) if ids is None})
        if len(self.memo) + len(fresh) > CACHED_PIECES:  # those that were met first are the frequent ones
            self.memo = dict(islice(self.memo.items(), CACHED_PIECES // 2))
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "surrogatepass") for p in some], add_special_tokens=False)
            self.memo.update(zip(some, [tuple(g.ids) for g in got]))
        found = [got if None not in got else [self.memo[p] if ids is None else ids for p, ids in zip(own, got)] for own, got in zip(split, found)]
        return [list(chain.from_iterable(got)) for got in found]

    def texts(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of each text."""
        plans, fresh = [], {}
        for data in texts:
            ends = cut_points(np.frombuffer(data, dtype=np.uint8)) if data else []
            plans.append([data[a:b] for a, b in zip([0, *ends], ends)])
            for part in plans[-1]:
                if part in self.chunks or part in fresh:
                    self.reused += 1
                else:
                    fresh[part] = None
        self.encoded += len(fresh)
        for part, ids in zip(fresh, self.encode(list(fresh))):
            self.keep(part, ids)
        repairs = self.repairs({pair for parts in plans for pair in zip(parts, parts[1:])})
        out = [self.spliced(parts, repairs) for parts in plans]
        if self.held > CACHED_BYTES:  # those that came first are the oldest
            for part in list(islice(self.chunks, len(self.chunks) // 2)):
                self.held -= len(part) + 4 * len(self.chunks.pop(part)) + 200
        return out

    def keep(self, part: bytes, ids: list[int]) -> None:
        self.chunks[part] = array("i", ids)
        self.held += len(part) + 4 * len(ids) + 200

    @staticmethod
    def around(left: bytes, right: bytes, reach: int) -> tuple[bytes, bytes, bytes, bytes] | None:
        """The `reach` pieces before and after a join, each as outer and inner half; None if they pass a chunk's middle."""
        head, tail = left.rsplit(None, 2 * reach), right.split(None, 2 * reach)
        if len(head) <= 2 * reach or len(tail) <= 2 * reach:
            return None
        outer, inner = left.rsplit(None, reach)[0], left.rsplit(None, reach // 2)[0]
        near, far = right.split(None, reach // 2)[-1], right.split(None, reach)[-1]
        near, far = len(right) - len(near), len(right) - len(far)
        return left[len(outer) : len(inner)], left[len(inner) :], right[:near], right[near:far]

    def repairs(self, joins: set[tuple[bytes, bytes]]) -> dict[tuple[bytes, bytes], tuple[int, list[int], int]]:
        """For each join of chunks how many tokens of the left one go, what takes their place, and how many of the right go.

        Joins that no reach can repair are missing.
        """
        out, reach, open_ = {}, REACH, list(joins)
        while open_:
            at = {join: found for join in open_ if (found := self.around(*join, reach))}
            needed = list({x for a, b, c, d in at.values() for x in (a, a + b, a + b + c + d, c + d, d)})
            ids = dict(zip(needed, self.encode(needed)))
            open_ = []
            for join, (a, b, c, d) in at.items():
                (left, right), old_a, old_b, new = join, ids[a + b], ids[c + d], ids[a + b + c + d]
                same = len(ids[a]) + len(ids[d]) <= len(new) and new[: len(ids[a])] == ids[a] and new[len(new) - len(ids[d]) :] == ids[d]
                left, right = self.chunks[left], self.chunks[right]
                if same and left[max(0, len(left) - len(old_a)) :].tolist() == old_a and right[: len(old_b)].tolist() == old_b:
                    out[join] = (len(old_a), new, len(old_b))
                else:
                    open_.append(join)
            self.widened += len(open_)
            reach *= 2
        return out

    def spliced(self, parts: list[bytes], repairs: dict[tuple[bytes, bytes], tuple[int, list[int], int]]) -> list[int]:
        """The ids of a text from its chunks; chunks whose join couldn't be repaired are encoded as one."""
        while bad := {i + 1 for i, join in enumerate(zip(parts, parts[1:])) if join not in repairs}:
            stretches: list[list[bytes]] = []
            for i, part in enumerate(parts):
                if i in bad:
                    stretches[-1].append(part)
                else:
                    stretches.append([part])
            parts = [b"".join(x) for x in stretches]
            fresh = [p for p in dict.fromkeys(parts) if p not in self.chunks]
            for part, ids in zip(fresh, self.encode(fresh)):
                self.keep(part, ids)
            repairs = repairs | self.repairs(set(zip(parts, parts[1:])) - repairs.keys())
        out: list[int] = []
        skip = 0
        for i, part in enumerate(parts):
            ids = self.chunks[part]
            if i + 1 < len(parts):
                drop, new, following = repairs[part, parts[i + 1]]
                out += ids[skip : len(ids) - drop]
                out += new
                skip = following
            else:
                out += ids[skip:]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b" ".join([self.token[i] for i in ids])

    def numbers(self, ids: list[int]) -> bytes:
        """Decimal ids joined by a space."""
        return b" ".join([self.decimal[i] for i in ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _coded(batch: pa.RecordBatch, vocabulary: str) -> tuple[Encoder, list[list[int]]]:
    own = encoder(vocabulary)
    return own, own.texts([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()])


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (array<int>) and decoded text of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, got = _coded(batch, vocabulary)
        decoded = pa.array([own.decode(ids).decode("utf-8", "surrogatepass") for ids in got], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, got)), pa.int64()), pa.array(got, pa.list_(pa.int32())), decoded], names=[id_col, "n_tokens", "ids", "decoded"])

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, SHA-256 of the decimal ids joined by a space and of the decoded text; ids stay in the worker."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, got = _coded(batch, vocabulary)
        digests = [pa.array([sha256(f(ids)).hexdigest() for ids in got], pa.string()) for f in (own.numbers, own.decode)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, got)), pa.int64()), *digests], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
