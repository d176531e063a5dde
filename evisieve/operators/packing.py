"""Evidence packs: neighbouring chunks joined, credentials masked, cut to a token budget."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import citation_label, line_url
from ..functions.redact import redact, redact_udf
from ..functions.text import py_token_estimate, token_estimate, truncated

OVERHEAD, LEAST_LEFT, MOST_ITEMS = 60, 250, 200
#: What decides about neighbours.
_OWN = ("start", "end", "partial", "text", "score")
HIT = "doc_id string, source_id string, source_type string, path string, title string, kind string, url string, version string, start int, end int, partial boolean, text string, score double"


class Passage:
    """Lines of one document that hits have filled without a gap; `end` is the number of the last one."""

    def __init__(self, hit: dict):
        self.hit, self.lines, self.end, self.score = hit, hit["text"].split("\n"), hit["end"], hit["score"]

    def takes(self, hit: dict) -> bool:
        """Adds a hit that begins inside or right below, if it has the same lines where both are. Cut lines fit nothing.

        A hit that adds no line leaves the score as well.
        """
        below = hit["start"] - self.end - 1  # 0: right below; negative: so many lines are shared
        if below > 0 or -below > len(self.lines) or self.hit.get("partial") or hit.get("partial"):
            return False
        place, own = len(self.lines) + below, hit["text"].split("\n")
        if any(a != b for a, b in zip(self.lines[place:], own)):
            return False
        if hit["end"] > self.end:
            self.lines += own[-below:]
            self.end, self.score = hit["end"], max(self.score, hit["score"])
        return True

    def row(self) -> dict:
        return {**self.hit, "text": "\n".join(self.lines), "end": self.end, "score": self.score}


def merge_neighbours(hits: list[dict]) -> list[dict]:
    """Hits of documents with those that continue each other as one passage."""
    passages: dict[str, list[Passage]] = {}
    for hit in sorted(hits, key=lambda h: (h["doc_id"], h["start"])):
        own = passages.setdefault(hit["doc_id"], [])
        if not own or not own[-1].takes(hit):
            own.append(Passage(hit))
    return [p.row() for own in passages.values() for p in own]


def merged(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """merge_neighbours() per query and document, over rows in order: a task holds one passage at a time, not one group.

    Rows come sorted, so a passage is a run of them: its first row, with the text, end and score of the whole run.
    """
    names = [f.split()[0] for f in HIT.split(", ")]
    schema = f"{by} {hits.schema[by].dataType.simpleString()}, {HIT}"
    order = ["start", "end", F.col("score").desc(), "text"]
    rows = hits.select(by, *names).withColumn("opens", F.row_number().over(Window.partitionBy(by, "doc_id").orderBy(*order)) == 1)
    return rows.sortWithinPartitions(by, "doc_id", *order).mapInArrow(_runs, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of sorted hits; the last column tells the first hit of each query's document. The open passage goes on in the next batch."""
    held: tuple[pa.RecordBatch, Passage] | None = None  # the passage's first row, without the last column
    for batch in batches:
        whole = batch.select(batch.schema.names[:-1])
        hits = zip(*(batch.column(c).to_pylist() for c in ("opens", *_OWN)))
        heads, passages = [], []
        now = held[1] if held else None
        for i, (opens, *own) in enumerate(hits):
            hit = dict(zip(_OWN, own))
            if now is None or opens or not now.takes(hit):
                now = Passage(hit)
                heads.append(i)
                passages.append(now)
        if heads:  # all passages but the last one are complete
            if held:
                yield _filled(held[0], [held[1]])
            if len(heads) > 1:
                yield _filled(whole.take(pa.array(heads[:-1])), passages[:-1])
            held = whole.take(pa.array(heads[-1:])), passages[-1]
    if held:
        yield _filled(held[0], [held[1]])


def _filled(heads: pa.RecordBatch, passages: list[Passage]) -> pa.RecordBatch:
    new = {"text": ["\n".join(p.lines) for p in passages], "end": [p.end for p in passages], "score": [p.score for p in passages]}
    return pa.RecordBatch.from_arrays([pa.array(new[f.name], f.type) if f.name in new else heads.column(f.name) for f in heads.schema], schema=heads.schema)


@F.pandas_udf(T.StringType())
def cut_udf(texts: pd.Series, left: pd.Series) -> pd.Series:
    """truncated() over an Arrow batch; a pack has one such item at most. Null: null."""
    return pd.Series([None if t is None else truncated(t, int(n)) for t, n in zip(texts, left)])


def packed(hits: DataFrame, budget: int, by: str = "query_id", most: int = MOST_ITEMS, masked: bool = True) -> DataFrame:
    """Items of each query's pack, in order of score: id E1, E2, ..., label, url, tokens and text.

    Items are taken while their running sum fits; the first that doesn't is cut if LEAST_LEFT tokens are left,
    and ends the pack. All but that cut is a running sum over each query's ranking.
    """
    rows = hits.withColumn("r", redact_udf("text")) if masked else hits.withColumn("r", F.struct(F.col("text"), F.lit(0).alias("count"), F.array().cast("array<string>").alias("kinds")))
    rows = rows.withColumn("body", F.col("r.text")).withColumn("tokens", token_estimate(F.col("r.text")) + OVERHEAD)
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "doc_id", "start")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("before", before).where(F.col("n") <= most)
    fits = F.col("before") + F.col("tokens") <= budget
    left = F.lit(budget) - F.col("before") - OVERHEAD
    # Sums only grow, so the first item that doesn't fit is the one whose predecessors all do.
    rows = rows.where(fits | ((F.col("before") <= budget) & (left >= LEAST_LEFT)))
    rows = rows.withColumn("truncated", ~fits).withColumn("left", F.when(~fits, left.cast("int")))
    # One pass: only texts that are cut go to Python and are estimated again.
    rows = rows.withColumn("cut", cut_udf(F.when(F.col("truncated"), F.col("body")), F.coalesce("left", F.lit(0))))
    rows = rows.withColumn("body", F.when(F.col("truncated"), F.col("cut")).otherwise(F.col("body")))
    rows = rows.withColumn("tokens", F.when(F.col("truncated"), token_estimate(F.col("body")) + OVERHEAD).otherwise(F.col("tokens")))
    return rows.select(
        by, F.concat(F.lit("E"), "n").alias("id"), "n", "source_id", "source_type", "kind", "path", "title", "start", "end", "version",
        line_url(F.col("url"), F.col("source_type"), F.col("kind"), F.col("start"), F.col("end")).alias("url"),
        citation_label(F.col("source_id"), F.col("path"), F.col("kind"), F.col("start"), F.col("end")).alias("label"),
        "truncated", "tokens", F.col("body").alias("text"), F.col("r.count").alias("masked"), F.col("r.kinds").alias("masked_kinds"), "score",
    )


@dataclass
class Pack:
    """One pack on the driver: bounded by its budget."""

    items: list[dict] = field(default_factory=list)
    tokens: int = 0
    dropped: int = 0
    masked: int = 0
    masked_kinds: list[str] = field(default_factory=list)
    task: str | None = None


def build_pack(hits: list[dict], budget: int, most: int = MOST_ITEMS, head: int = 0, masked: bool = True) -> Pack:
    """The pack of one ranking that is on the driver already: packed() on running sums of a list.

    Masking counts include the first item that doesn't fit, whether it is cut or left out.
    """
    ranked = sorted(merge_neighbours(hits), key=lambda h: (-h["score"], h["doc_id"]))
    safe = [redact(h["text"]) if masked else (h["text"], 0, []) for h in ranked[:most]]
    sums = list(accumulate((py_token_estimate(text) + OVERHEAD for text, _, _ in safe), initial=head))
    whole = max(0, bisect_right(sums, budget) - 1)
    rest = budget - sums[whole] - OVERHEAD
    shown = [(text, False) for text, _, _ in safe[:whole]]
    tokens = sums[whole]
    if whole < len(safe) and rest >= LEAST_LEFT:
        shown.append((truncated(safe[whole][0], rest), True))
        tokens += py_token_estimate(shown[-1][0]) + OVERHEAD
    items = [{**hit, "id": f"E{n}", "label": label(hit), "url": link(hit), "truncated": cut, "text": text} for n, (hit, (text, cut)) in enumerate(zip(ranked, shown), 1)]
    seen = safe[: whole + 1]
    kinds = list(dict.fromkeys(chain.from_iterable(own for _, _, own in seen)))
    return Pack(items, tokens, len(ranked) - len(items), sum(count for _, count, _ in seen), kinds)


def label(hit: dict) -> str:
    return f"{hit['source_id']}/{hit['path']}" + ("" if hit["kind"] in ("doc", "ticket") else f":{hit['start']}-{hit['end']}")


def link(hit: dict) -> str | None:
    own = hit.get("url") and hit.get("source_type") == "github" and hit["kind"] not in ("issue", "pr") and hit.get("start")
    return f"{hit['url']}#L{hit['start']}-L{hit['end']}" if own else hit.get("url")


def evidence_block(items: list[dict]) -> str:
    """The items as tagged text for a prompt; the same items give the same text."""
    quoted = lambda v: re.sub("[&\"<]", lambda m: {"&": "&amp;", '"': "&quot;", "<": "&lt;"}[m[0]], str(v if v is not None else ""))
    out = []
    for e in items:
        head = {"id": e["id"], "source": e["source_id"], "type": e["source_type"], "kind": e["kind"], "path": quoted(e["path"]), "lines": f"{e['start']}-{e['end']}", "version": quoted(e.get("version"))}
        head |= {"url": quoted(e["url"])} if e.get("url") else {}
        head |= {"truncated": "true"} if e.get("truncated") else {}
        out.append("<evidence " + " ".join(f'{k}="{v}"' for k, v in head.items()) + f">\n{e['text']}\n</evidence>")
    return "\n\n".join(out)


def evidence_blocks(items: DataFrame, by: str = "query_id") -> DataFrame:
    """The same as one text per query, without Python. A pack is bounded by its budget, and so is the text."""
    quoted = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    optional = F.concat(F.when(F.col("url").isNotNull(), F.concat(F.lit(' url="'), quoted("url"), F.lit('"'))).otherwise(""), F.when(F.col("truncated"), ' truncated="true"').otherwise(""))
    block = F.concat(F.format_string('<evidence id="%s" source="%s" type="%s" kind="%s" path="%s" lines="%s-%s" version="%s"', "id", "source_id", "source_type", "kind", quoted("path"), "start", "end", quoted("version")), optional, F.lit(">\n"), F.col("text"), F.lit("\n</evidence>"))
    rows = items.select(by, F.struct("n", block.alias("block")).alias("b"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("evidence"))
