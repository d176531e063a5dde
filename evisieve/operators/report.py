"""Reports and prompts: small texts made on the driver from bounded results."""

from __future__ import annotations

from ..functions.text import py_token_estimate


def static_facts(findings: list[dict], facts: list[dict], endpoints: list[dict], budget: int) -> str:
    """Scan results as text within a token budget; lines from the latter part go first."""
    lines = []
    if findings:
        lines.append("## Findings of the rule scan")
        for f in findings:
            lines += [f"- [{f['severity']}] {f['rule_id']} {f['title']} @ {f['source_id']}/{f['path']}:{f['line']}" + (f" ({f['cwe']})" if f.get("cwe") else ""), f"  > {f['snippet']}"]
    if facts:
        lines += ["", "## Project facts", *(f"- [{f['kind']}] {f['source_id']}/{f['path']}: {f['detail']}" for f in facts)]
    if endpoints:
        lines += ["", "## Endpoints", *(f"- {e['method']} {e['route']} @ {e['source_id']}/{e['path']}:{e['line']} ({e['framework']})" for e in endpoints)]
    text = "\n".join(lines)
    while py_token_estimate(text) > budget and len(lines) > 10:
        at = int(len(lines) * 0.7)
        del lines[at : at + -(-len(lines) // 10)]
        text = "\n".join([*lines, "…(cut to the budget)"])
    return text


def markdown(answer: dict, items: list[dict], title: str = "Report") -> str:
    """A verified answer: summary, items by type in order of first use, then what is open, and the sources."""
    names = {e["id"]: e["label"] for e in items}
    cite = lambda ids: ", ".join(f"{i} ({names[i]})" if i in names else str(i) for i in ids or [])
    out = [f"# {title}", "", str(answer.get("summary") or ""), ""]
    kinds = list(dict.fromkeys(i.get("type") for i in answer.get("items", [])))
    for kind in kinds:
        out += [f"## {kind}", ""]
        for i in (i for i in answer["items"] if i.get("type") == kind):
            head = f"### {i.get('title')}" + (f" [{i['severity']}]" if i.get("severity") else "")
            out += [head, "", str(i.get("statement") or ""), "", f"Evidence: {cite(i.get('evidence'))}. Confidence: {i.get('confidence')}.", ""]
            out += [f"> {line}" for q in i.get("quotes") or [] for line in str(q.get("text")).split("\n")]
            out += [f"{k.capitalize()}: {i[k]}" for k in ("impact", "remediation", "cwe") if i.get(k)] + [""]
    for key, field in (("contradictions", "description"), ("open_questions", "question"), ("next_actions", "action")):
        if rows := answer.get(key):
            out += [f"## {key.replace('_', ' ').capitalize()}", "", *(f"- {r.get(field)}" + (f" ({cite(r['evidence'])})" if r.get("evidence") else "") for r in rows if isinstance(r, dict)), ""]
    if rejected := answer.get("_rejected"):
        out += ["## Rejected", "", *(f"- {(r['item'] or {}).get('title')}: {'; '.join(r['reasons'])}" for r in rejected), ""]
    out += ["## Sources", "", "| id | source | version |", "|-|-|-|", *(f"| {e['id']} | {e['label']} | {e.get('version') or ''} |" for e in items)]
    return "\n".join(out) + "\n"


def bundle(system: str, user: str) -> str:
    """The exact prompt of a dry run."""
    return f"# System\n\n{system}\n\n# User\n\n{user}\n"


def skipped_text(counts: dict[str, int]) -> str:
    """What a sync left out, the most frequent reason first; empty if nothing."""
    return ", ".join(f"{n} {reason.replace('_', ' ')}" for reason, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n)
