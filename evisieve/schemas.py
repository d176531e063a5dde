"""Schemas of the rows that operators exchange."""

from __future__ import annotations

#: A raw document. `kind`: code, doc, config, other, issue, pr or ticket.
DOC = (
    "doc_id string, source_id string, source_type string, path string, title string, kind string, lang string, "
    "url string, version string, hash string, meta map<string,string>, text string"
)
#: A chunk: its document's columns but text and hash, then lines (1-based, inclusive) and its own text.
CHUNK = (
    "doc_id string, chunk_no int, source_id string, source_type string, path string, title string, kind string, lang string, "
    "url string, version string, start int, end int, hash string, n_tokens int, partial boolean, text string"
)
FINDING = "rule_id string, severity string, category string, cwe string, title string, source_id string, path string, line int, snippet string, context string, url string"
ENDPOINT = "method string, route string, framework string, source_id string, path string, line int, url string, snippet string"
VIOLATION = "code string, place string, message string, hint string"
#: A model's answer.
ANSWER = (
    "summary string, items array<struct<id string, type string, title string, statement string, evidence array<string>, "
    "quotes array<struct<evidence string, text string>>, confidence string, severity string, cwe string, impact string, "
    "remediation string, contradicting_evidence array<string>>>, "
    "open_questions array<struct<question string, why_unresolved string, where_to_look string>>, "
    "contradictions array<struct<description string, evidence array<string>>>, "
    "next_actions array<struct<action string, rationale string, evidence array<string>>>"
)
