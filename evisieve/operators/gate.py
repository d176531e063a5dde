"""The verification gate: what a model answered, checked against the evidence it was given."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonschema import extract_json, validate

#: Words of speculation, and the white space that quotes may differ in.
SPECULATIVE = (
    "おそらく", "と思われる", "と思います", "推測", "かもしれ", "一般的に", "通常は", "恐らく", "であろう", "と考えられます",
    "probably", "likely", "presumably", "typically", "usually", "i think", "it seems", "appears to be", "might be",
)
BLANK = "[ \\t\\u00a0\\u2000-\\u200a\\u202f\\u205f\\u3000\\ufeff]"
_BLANKS, _LEAD = re.compile(f"{BLANK}+"), re.compile(f"\n{BLANK}*")


@dataclass(frozen=True)
class Policy:
    require_citations: bool = True
    min_evidence: int = 1
    verbatim_quotes: bool = True
    drop_unverified: bool = True
    forbid_speculation: bool = True


@dataclass
class Verdict:
    ok: bool = True
    violations: list[dict] = field(default_factory=list)
    cleaned: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)


def normal(text: Any) -> str:
    """Quotes and sources compare by this: composed characters, one kind of line end and of blank, no indents."""
    composed = unicodedata.normalize("NFC", str(text)).replace("\r\n", "\n")
    return _LEAD.sub("\n", _BLANKS.sub(" ", composed)).strip()


def speculation(text: str) -> list[str]:
    low = text.lower()
    return [w for w in SPECULATIVE if w in low]


def _check_item(item: dict, known: dict[str, str], policy: Policy, seen: set) -> tuple[list[tuple[str, str]], int, int]:
    """(code, message) of what is wrong with one item, quotes checked, quotes failed."""
    out: list[tuple[str, str]] = []
    if item.get("id"):
        if item["id"] in seen:
            out.append(("E_DUP_ID", f"item id {item['id']} occurs before"))
        seen.add(item["id"])
    lists = {}
    for key in ("evidence", "contradicting_evidence", "quotes"):
        value = item.get(key)
        lists[key] = value if isinstance(value, list) else []
        if key != "evidence" and value is not None and not isinstance(value, list):
            out.append(("E_SCHEMA", f"{key} must be an array"))
    cited = lists["evidence"]
    if policy.require_citations and len(cited) < policy.min_evidence:
        out.append(("E_NO_EVIDENCE", f"fewer than {policy.min_evidence} evidence ids"))
    if unknown := [str(e) for e in cited if not isinstance(e, str) or e not in known]:
        out.append(("E_BAD_EVIDENCE", f"no such evidence: {', '.join(unknown)}"))
    out += [("E_BAD_EVIDENCE", f"no such contradicting evidence: {e}") for e in lists["contradicting_evidence"] if not isinstance(e, str) or e not in known]
    checked = failed = 0
    for i, quote in enumerate(lists["quotes"]):
        if not isinstance(quote, dict):
            out.append(("E_SCHEMA", f"quotes[{i}] must be an object"))
            continue
        checked += 1
        source = quote.get("evidence")
        if not isinstance(source, str) or source not in known:
            failed += 1
            out.append(("E_QUOTE_SRC", f"no such evidence: {source}"))
            continue
        if cited and source not in cited:
            out.append(("E_QUOTE_NOT_CITED", f"{source} isn't among the item's evidence"))
        text = normal(quote.get("text"))
        if not text:
            failed += 1
            out.append(("E_QUOTE_EMPTY", f"the quote from {source} is empty"))
        elif policy.verbatim_quotes and text not in normal(known[source]):
            failed += 1
            out.append(("E_QUOTE_MISMATCH", f"{source} has no such text: {str(quote.get('text'))[:80]}"))
    if policy.forbid_speculation and (words := speculation(" ".join(str(item.get(k) or "") for k in ("title", "statement", "remediation")))):
        sure = str(item.get("confidence")).lower() == "high"
        out.append(("E_SPECULATION" if sure else "W_SPECULATION", f"speculates: {', '.join(words)}"))
    return out, checked, failed


def verify(answer: Any, evidence: list[dict], schema: dict | None = None, policy: Policy = Policy()) -> Verdict:
    """Violations (E_ hard, W_ soft), the answer without what failed, and counts. evidence: id and text of items."""
    known = {e["id"]: e["text"] for e in evidence}
    v = Verdict()
    add = lambda code, place, message: v.violations.append({"code": code, "place": place, "message": message})
    counts = dict.fromkeys(("items", "accepted", "rejected", "quotes_checked", "quotes_failed", "cited"), 0)
    if not isinstance(answer, dict):
        add("E_NO_JSON", "$", "no JSON object")
        v.ok, v.cleaned = False, {"summary": "", "items": [], "open_questions": [], "contradictions": [], "next_actions": [], "_rejected": []}
        v.stats = counts | {"hard": 1, "soft": 0, "offered": len(evidence)}
        return v
    for message in validate(schema, answer):
        add("E_SCHEMA", "$", message)
    items = answer["items"] if isinstance(answer.get("items"), list) else []
    item_schema = ((schema or {}).get("properties", {}).get("items") or {}).get("items")
    accepted, rejected, seen = [], [], set()
    for i, item in enumerate(items):
        place = f"items[{i}]" + (f" ({item['id']})" if isinstance(item, dict) and item.get("id") else "")
        if not isinstance(item, dict):
            add("E_ITEM", place, "an item must be an object")
            continue
        problems, checked, failed = _check_item(item, known, policy, seen)
        counts["quotes_checked"] += checked
        counts["quotes_failed"] += failed
        for code, message in problems:
            add(code, place, message)
        reasons = [f"E_SCHEMA: {m}" for m in validate(item_schema, item, f"$.items[{i}]")] + [f"{c}: {m}" for c, m in problems if c[0] == "E"]
        (rejected if reasons else accepted).append({"item": item, "reasons": reasons} if reasons else item)
    if policy.forbid_speculation and isinstance(answer.get("summary"), str) and (words := speculation(answer["summary"])):
        add("W_SPECULATION", "$.summary", f"speculates: {', '.join(words)}")
    lists = {}
    for key in ("contradictions", "next_actions"):
        if answer.get(key) is None:
            continue
        if not isinstance(answer[key], list):
            add("E_SCHEMA", f"$.{key}", f"{key} must be an array")
            continue
        lists[key] = []
        for i, entry in enumerate(answer[key]):
            place = f"{key}[{i}]"
            ids = entry.get("evidence") if isinstance(entry, dict) else None
            if not isinstance(entry, dict) or (ids is not None and not isinstance(ids, list)):
                add("E_SCHEMA", place, "an entry must be an object with an array of evidence ids")
                lists[key].append(entry)
                continue
            bad = [e for e in ids or [] if not isinstance(e, str) or e not in known]
            if bad:
                message = f"no such evidence: {', '.join(map(str, bad))}"
                add("E_BAD_EVIDENCE" if key == "contradictions" else "W_BAD_EVIDENCE", place, message)
            if not bad or not policy.drop_unverified:
                lists[key].append(entry)
            elif key == "contradictions":
                rejected.append({"kind": "contradiction", "item": entry, "reasons": [f"E_BAD_EVIDENCE: {message}"]})
            else:
                lists[key].append({**entry, "evidence": [e for e in ids if e not in bad]})
    if not isinstance(answer.get("open_questions"), list):
        add("E_SCHEMA", "$.open_questions", "open_questions must be an array")
    hard = sum(x["code"][0] == "E" for x in v.violations)
    v.ok = hard == 0
    v.cleaned = {**answer, **lists, "items": accepted if policy.drop_unverified else items, "_rejected": rejected}
    cited = {e for item in accepted for e in (item.get("evidence") or []) if isinstance(e, str) and e in known}
    v.stats = counts | {"items": len(items), "accepted": len(accepted), "rejected": sum("kind" not in r for r in rejected), "cited": len(cited), "hard": hard, "soft": len(v.violations) - hard, "offered": len(evidence)}
    return v


def repair_prompt(violations: list[dict], hard: int = 25, soft: int = 10) -> str:
    """What to tell a model about its violations."""
    line = lambda x: f"- [{x['code']}] {x['place']}: {x['message']}"
    bad = [x for x in violations if x["code"][0] == "E"]
    mild = [x for x in violations if x["code"][0] != "E"]
    return "\n".join(["# Violations", *map(line, bad[:hard]), *(["", "# Warnings"] if mild else []), *map(line, mild[:soft]), "", "Return the JSON again without these. Remove a failing item or cite evidence that exists; don't add new guesses: what lacks evidence is an open question."])


# Whole batches of answers, as relations.


REPLIES = "ok boolean, violations array<struct<code:string,place:string,message:string>>, items int, accepted int, rejected int, hard int, soft int"


def verify_replies(replies: DataFrame, schema: dict | None = None, policy: Policy = Policy(), by: str = "answer_id") -> DataFrame:
    """verify() of what models wrote: id, ok, violations and counts. replies: id, reply, evidence (array of id and text).

    An answer and its evidence are one row, so nothing is shuffled.
    """
    kind = replies.schema[by].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, reply, evidence in zip(*(c.to_pylist() for c in batch.columns)):
                v = verify(extract_json(reply), evidence or [], schema, policy)
                rows.append({by: name, "ok": v.ok, "violations": v.violations, **{k: v.stats[k] for k in ("items", "accepted", "rejected", "hard", "soft")}})
            fields = [(by, batch.schema.field(0).type), ("ok", pa.bool_()), ("violations", pa.list_(pa.struct([(n, pa.string()) for n in ("code", "place", "message")]))), *((k, pa.int32()) for k in ("items", "accepted", "rejected", "hard", "soft"))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return replies.select(by, "reply", "evidence").mapInArrow(run, f"{by} {kind}, {REPLIES}")


@F.pandas_udf(T.StringType())
def composed_udf(texts: pd.Series) -> pd.Series:
    """NFC, for which Spark has no function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normal_column(text: Column, composed: bool = False) -> Column:
    """normal() as a Column; texts that aren't composed yet need composed_udf first (`composed` false)."""
    text = text if composed else composed_udf(text)
    blank = BLANK.replace("\\\\", "\\")
    folded = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), f"{blank}+", " "), f"\n{blank}*", "\n")
    return F.regexp_replace(folded, "\\A[\\s\\u00a0\\ufeff]+|[\\s\\u00a0\\ufeff]+\\z", "")


def quote_violations(quotes: DataFrame, evidence: DataFrame, composed: bool = False) -> DataFrame:
    """answer_id, item_no, quote_no and code of quotes that fail.

    quotes: answer_id, item_no, quote_no, evidence, text, cited (array); evidence: answer_id, id, text.
    """
    source = evidence.select("answer_id", F.col("id").alias("evidence"), normal_column(F.col("text"), composed).alias("source"))
    rows = quotes.withColumn("quote", normal_column(F.col("text"), composed)).join(source, ["answer_id", "evidence"], "left")
    missing = F.col("source").isNull()
    code = F.when(missing, "E_QUOTE_SRC").when(F.col("quote") == "", "E_QUOTE_EMPTY").when(~F.contains("source", "quote"), "E_QUOTE_MISMATCH")
    loose = F.when(~missing & (F.size("cited") > 0) & ~F.array_contains("cited", F.col("evidence")), "E_QUOTE_NOT_CITED")
    return rows.select("answer_id", "item_no", "quote_no", F.explode(F.array_compact(F.array(loose, code))).alias("code"))


def evidence_violations(items: DataFrame, evidence: DataFrame, least: int = 1) -> DataFrame:
    """answer_id, item_no, code and detail for too few or unknown evidence ids and repeated item ids.

    items: answer_id, item_no, id, evidence (array).
    """
    offered = evidence.groupBy("answer_id").agg(F.collect_set("id").alias("offered"))
    rows = items.join(offered, "answer_id", "left")
    unknown = F.array_except(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("offered", F.array().cast("array<string>")))
    few = F.when(F.coalesce(F.size("evidence"), F.lit(0)) < least, F.struct(F.lit("E_NO_EVIDENCE").alias("code"), F.lit("").alias("detail")))
    bad = F.when(F.size(unknown) > 0, F.struct(F.lit("E_BAD_EVIDENCE").alias("code"), F.array_join(F.array_sort(unknown), ", ").alias("detail")))
    own = rows.select("answer_id", "item_no", F.explode(F.array_compact(F.array(few, bad))).alias("v")).select("answer_id", "item_no", "v.*")
    from pyspark.sql import Window

    again = items.where(F.col("id").isNotNull()).withColumn("n", F.row_number().over(Window.partitionBy("answer_id", "id").orderBy("item_no"))).where("n > 1")
    return own.unionByName(again.select("answer_id", "item_no", F.lit("E_DUP_ID").alias("code"), F.col("id").alias("detail")))
