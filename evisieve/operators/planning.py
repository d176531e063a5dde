"""Tasks, effort and the deterministic query planner: the same instruction always gives the same queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Task:
    id: str
    label: str
    item_types: tuple[str, ...]
    kind_priors: dict[str, float]
    needs: tuple[str, ...]
    keywords: tuple[str, ...]
    instruction: str


_KINDS = ("code", "doc", "ticket", "pr", "issue", "config", "other")
_priors = lambda *values: dict(zip(_KINDS, values))

#: Labels, item types, priors and keywords of the tasks; the instructions are our own words.
TASKS = {
    t.id: t
    for t in (
        Task("spec", "仕様の整理", ("requirement", "behavior", "constraint", "data", "interface", "dependency", "gap"), _priors(0.7, 1.0, 0.5, 0.2, 0.3, 0.4, 0.1), ("endpoints", "facts"),
             ("仕様", "要件", "設計", "振る舞い", "API", "specification", "requirement", "design", "behavior", "contract", "schema"),
             "State what the evidence requires and what the code does. Where documents and code differ, record a contradiction and a gap."),
        Task("bug", "問題・バグの調査", ("observation", "reproduction", "hypothesis", "root_cause", "impact", "fix_candidate", "ruled_out"), _priors(1.0, 0.5, 0.8, 0.7, 0.9, 0.6, 0.1), ("facts", "findings"),
             ("不具合", "バグ", "エラー", "例外", "再現", "ログ", "bug", "error", "exception", "stack trace", "failure", "regression", "timeout", "retry"),
             "Separate observations from hypotheses; each hypothesis names evidence for and against it. A root cause needs a quoted line."),
        Task("security", "セキュリティリスクの評価", ("risk", "exposure", "control", "gap", "ruled_out"), _priors(1.0, 0.5, 0.3, 0.3, 0.3, 0.9, 0.1), ("endpoints", "facts", "findings"),
             ("認証", "認可", "権限", "暗号", "入力検証", "セキュリティ", "auth", "permission", "token", "session", "validate", "sanitize", "encrypt", "secret", "injection"),
             "Rate each risk by what the evidence shows to be reachable. Name controls that exist; move false alarms to ruled_out."),
        Task("static", "静的解析と品質評価", ("defect", "smell", "debt", "dependency_risk", "test_gap", "ruled_out"), _priors(1.0, 0.3, 0.2, 0.3, 0.2, 0.8, 0.1), ("facts", "findings"),
             ("例外処理", "依存関係", "複雑度", "lint", "error handling", "dependency", "test", "coverage", "deprecated"),
             "Start from the scan's findings and decide by the code which are real; one item per cause, with all places."),
        Task("design", "新機能の設計", ("requirement", "decision", "component", "interface", "data_model", "migration", "impact", "risk", "alternative", "open_design_question"), _priors(0.9, 1.0, 0.6, 0.4, 0.4, 0.5, 0.1), ("endpoints", "facts"),
             ("設計", "アーキテクチャ", "拡張", "影響範囲", "データモデル", "architecture", "interface", "module", "migration", "schema", "extension point"),
             "Proposals are new, what they rest on is cited: patterns to follow, files that change, one alternative at least."),
    )
}


@dataclass(frozen=True)
class Effort:
    queries: int
    final: int
    evidence_tokens: int


EFFORTS = {"low": Effort(3, 14, 20_000), "normal": Effort(6, 28, 55_000), "deep": Effort(12, 56, 110_000)}

#: Quoted phrases, and what looks like an identifier or a path.
QUOTED = "[\"「『`]([^\"'」』`]{1,80})[\"'」』`]"
APOSTROPHES = "(?<![A-Za-z0-9_])'([^\"'」』`\\n]{1,80})'(?![A-Za-z0-9_])"
IDENTIFIER = (
    r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*[./][A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*|[A-Z][a-z]+[A-Z][A-Za-z0-9]+"
    r"|[a-z]+(?:[A-Z][a-z0-9]*)+|[a-z]+_[a-z_]+)(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
MOST_IDENTIFIERS = 4


def concepts(instruction: str) -> list[str]:
    """Quoted phrases in order, then the first distinct identifiers and paths."""
    found = [(m.start(), m[1]) for m in re.finditer(QUOTED, instruction)]
    for m in re.finditer(APOSTROPHES, instruction):  # apostrophes inside words don't quote
        if re.fullmatch(r"\S.*\s.*\S", m[1]) or re.fullmatch(r"[A-Za-z_][\w./-]*", m[1], re.A):
            found.append((m.start(), m[1]))
    quoted = [q for _, q in sorted(found, key=lambda x: x[0]) if len(q) > 1 or re.match("[぀-ヿ㐀-鿿]", q)]
    names = list(dict.fromkeys(m[1] for m in re.finditer(IDENTIFIER, instruction)))
    return quoted + names[:MOST_IDENTIFIERS]


def plan_queries(task: str, instruction: str, most: int = 6) -> tuple[list[str], list[str]]:
    """Query texts in order, and the concepts that the limit cut off."""
    t = TASKS[task]
    own = [c.strip() for c in concepts(instruction)]
    wide = [f"{instruction} {' '.join(t.keywords[:5])}", f"{instruction} {' '.join(t.keywords[5:])}", f"{t.label} {instruction}"]
    queries = list(dict.fromkeys(q for q in (x.strip() for x in [instruction, *own, *wide]) if q))
    kept = queries[: max(1, most)]
    return kept, [c for c in dict.fromkeys(own) if c and c not in kept and c != instruction.strip()]


def planned(instruction: Column, most: int = 6) -> Column:
    """Query texts for a whole column of instructions: the text, its double-quoted phrases and identifiers."""
    phrases = F.filter(F.regexp_extract_all(instruction, F.lit(QUOTED), 1), lambda q: F.length(q) > 1)
    names = F.slice(F.array_distinct(F.regexp_extract_all(instruction, F.lit(IDENTIFIER), 1)), 1, MOST_IDENTIFIERS)
    every = F.transform(F.concat(F.array(instruction), phrases, names), lambda q: F.trim(q))
    return F.slice(F.array_distinct(F.filter(every, lambda q: q != "")), 1, most)


def answer_schema(task: str) -> dict:
    """JSON schema of a task's answer."""
    text, ids = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
    quote = {"type": "object", "required": ["evidence", "text"], "properties": {"evidence": text, "text": text}}
    item = {
        "type": "object",
        "required": ["id", "type", "title", "statement", "evidence", "confidence"],
        "properties": {
            "id": text, "type": {"type": "string", "enum": list(TASKS[task].item_types)}, "title": {"type": "string", "minLength": 1}, "statement": {"type": "string", "minLength": 1},
            "evidence": ids, "quotes": {"type": "array", "items": quote}, "confidence": {"type": "string", "enum": ["high", "medium", "low"]},
            "severity": {"type": "string", "enum": ["critical", "high", "medium", "low", "info"]}, "cwe": text, "impact": text, "remediation": text, "contradicting_evidence": ids,
        },
    }
    listed = lambda *names: {"type": "array", "items": {"type": "object", "required": list(names[:1]), "properties": {n: ids if n == "evidence" else text for n in names}}}
    return {
        "type": "object",
        "required": ["summary", "items", "open_questions"],
        "properties": {"summary": text, "items": {"type": "array", "items": item}, "open_questions": listed("question", "why_unresolved", "where_to_look"), "contradictions": listed("description", "evidence"), "next_actions": listed("action", "rationale", "evidence")},
    }
