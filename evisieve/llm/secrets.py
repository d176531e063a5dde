"""Secret scans: an Aho-Corasick prefilter, anchored expressions near its hits, then embedded checksums.

Every kind has keywords in one automaton: key names for assignments, the fixed prefix of access keys and
tokens, and the 65,536 four-digit strings for long hexadecimal runs. Only where a keyword ends does an
expression run, anchored at the keyword's start. Tokens that embed a checksum count only if it holds.

Defined results: a null text is an empty one and has no span; repeated rows give repeated rows; offsets are
code points, ends exclusive; an empty table gives an empty result; columns other than the id and the text
are only carried, if asked for.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from hashlib import sha256
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Base kinds, then the kinds whose tokens embed a checksum, in the order that breaks ties.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")
ORDER = {kind: i for i, kind in enumerate(KINDS)}

#: Fixed values of the formats.
ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[oprsu]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Keyword -> (kind, keyword length)."""
    found = ahocorasick.Automaton()
    for key in ASSIGN_KEYS:
        found.add_word(key, ("assign", len(key)))
    found.add_word("akia", ("access", 4))
    for letter in "oprsu":
        found.add_word(f"gh{letter}_", ("github", 4))
    found.add_word("npm_", ("npm", 4))
    for digits in product("0123456789abcdef", repeat=4):
        found.add_word("".join(digits), ("hex", 4))
    found.make_automaton()
    return found


def checksum_holds(token: str) -> bool:
    """True if the last six of the 36 characters after the prefix are the CRC-32 of the other 30 in base 62."""
    body, check = token[4:-6], token[-6:]
    value = 0
    for c in check:
        value = value * 62 + BASE62.index(c)
    return value == zlib.crc32(body.encode())


def with_checksum(prefix: str, body: str) -> str:
    """A token of the checksummed format; for tests and synthetic rows."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return prefix + body + digits


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets by start, then kind; leftmost and non-overlapping within a kind."""
    if not text:
        return []
    # Lower-casing the bytes touches A-Z only, so offsets in code points stay.
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    past = dict.fromkeys(KINDS, 0)
    spans = []
    for last, (kind, length) in automaton().iter(low):
        start = last + 1 - length
        if start < past[kind]:
            continue
        if kind == "hex":
            if m := HEX.match(text, start):
                past[kind] = m.end()
                if m.end() - start >= HEX_LEAST:
                    spans.append((kind, start, m.end()))
        elif kind == "assign":
            if m := ASSIGN.match(low, start):
                past[kind] = m.end()
                if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                    spans.append((kind, start, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                past[kind] = m.end()
                if m.end() - start >= ACCESS_LEAST:
                    spans.append((kind, start, m.end()))
        elif m := (GITHUB if kind == "github" else NPM).match(text, start):
            past[kind] = m.end()
            if checksum_holds(m[0]):
                spans.append((kind, start, m.end()))
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each maximal run of covered characters replaced by the name of its first kind in brackets."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `docs`: id, the columns in `keep`, spans, and the redacted text if asked for (null texts stay null)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(id_col, *keep).schema) + f", spans {SPANS}" + ", redacted string" * redacted
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        found = [find_secrets(t) for t in texts]
        columns = [*batch.columns[1:], pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], type=kinds)]
        if redacted:
            columns.append(pa.array([t if not spans else redact(t, spans) for t, spans in zip(texts, found)], type=pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=[id_col, *keep, "spans", *["redacted"] * redacted])

    return map_batches(docs.select(F.col(text_col).alias("__text"), id_col, *keep), make, schema)


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(text: str | None) -> tuple[int, int, int, str, str]:
    """The contract's columns for one text, in plain Python; for tests."""
    spans = find_secrets(text)
    base = [s for s in spans if s[0] in BASE_KINDS]
    counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
    return (*counts, sha256(spans_text(base).encode()).hexdigest(), spans_text(spans))
