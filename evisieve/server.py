"""A JSON-RPC server over standard input and output: the engine's operations as tools, its presets as prompts.

One message a line. Arguments are checked against the tools' schemas before anything runs; results are masked and
bounded. Calls run one after another, so a sync never overlaps a search; searches share the engine's open snapshot
until a newer generation is published.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from . import config as cfg
from .engine import SYSTEM, Engine
from .functions.jsonschema import validate
from .functions.redact import redact, redact_message
from .operators import packing, planning, presets, scanning

VERSIONS = ("2025-11-25", "2025-06-18", "2025-03-26", "2024-11-05")
#: Bounds of what is returned and of what is taken: characters of a hit, findings and facts, size and depth of an answer.
HIT_MOST, FINDINGS_MOST, FACTS_MOST, ENDPOINTS_MOST = 4000, 200, 80, 100
ANSWER_MOST, DEPTH_MOST = 2_000_000, 64
BAD_REQUEST, NO_METHOD, BAD_ARGUMENTS, PARSE_ERROR = -32600, -32601, -32602, -32700

_TEXT = {"type": "string", "minLength": 1, "pattern": r"\S"}
_NAMES = {"type": "array", "items": {"type": "string"}}
_LINE = {"type": "integer", "minimum": 1}


def _object(required: tuple[str, ...] = (), **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


_TASK, _EFFORT = {"type": "string", "enum": list(planning.TASKS)}, {"type": "string", "enum": list(planning.EFFORTS)}


@dataclass(frozen=True)
class Tool:
    description: str
    schema: dict


TOOLS = {
    "status": Tool("What is indexed, from which sources, and what may leave this machine.", _object()),
    "search": Tool("The best places of the indexed sources for a query, with their lines.", _object(("query",), query=_TEXT, k={"type": "integer", "minimum": 1, "maximum": 100}, sources=_NAMES, kinds=_NAMES)),
    "evidence_pack": Tool("Evidence for an instruction within a token budget, and the form of an answer.", _object(("instruction",), instruction=_TEXT, task=_TASK, effort=_EFFORT, sources=_NAMES, include_static={"type": "boolean"})),
    "verify": Tool("Checks an answer against the pack that it was made from.", _object(("pack_id", "result"), pack_id=_TEXT, result={"type": "object"})),
    "static_scan": Tool("Findings of the rule scan, project facts and endpoints, without a model.", _object(sources=_NAMES, severity={"type": "string", "enum": list(scanning.SEVERITIES)}, limit={"type": "integer", "minimum": 1, "maximum": 1000})),
    "fetch": Tool("Lines of a document, or an item of a pack.", _object(path=_TEXT, source=_TEXT, start=_LINE, end=_LINE, pack_id=_TEXT, evidence_id=_TEXT)),
    "run_task": Tool("A whole investigation: evidence, answer and report; without a model the prompt.", _object(("instruction",), instruction=_TEXT, task=_TASK, effort=_EFFORT, sources=_NAMES, dry_run={"type": "boolean"})),
    "sync": Tool("Reads the sources again and builds the index.", _object(sources=_NAMES)),
}


def depth(value: Any, most: int = DEPTH_MOST) -> int:
    """How deep lists and objects nest, as far as `most`."""
    level, n = [value], 0
    while level and n <= most:
        level = [x for v in level if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        n += 1
    return n


class Server:
    """model: a function for run_task as in Engine.run_task; None answers with the prompt."""

    def __init__(self, engine: Engine, model: Callable | None = None):
        self.engine, self.model = engine, model
        config = engine.config
        self.presets, _ = presets.load(config["presets"], {s["id"] for s in config["sources"]})

    # Messages

    def handle(self, message: Any) -> dict | None:
        """The answer to one message; None for notifications."""
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return self._error(None, BAD_REQUEST, "not a request")
        if "id" not in message:
            return None
        name, params, number = message["method"], message.get("params") or {}, message["id"]
        if not isinstance(params, dict):
            return self._error(number, BAD_ARGUMENTS, "params must be an object")
        methods: dict[str, Callable[[dict], dict]] = {
            "initialize": self._initialize,
            "ping": lambda _: {},
            "tools/list": lambda _: {"tools": [{"name": n, "description": t.description, "inputSchema": t.schema} for n, t in TOOLS.items()]},
            "tools/call": self._call,
            "prompts/list": lambda _: {"prompts": [{"name": p.name, "description": p.description, "arguments": [{"name": a["name"], "required": a.get("required", True)} for a in p.arguments]} for p in self.presets.values()]},
            "prompts/get": self._prompt,
        }
        if name not in methods:
            return self._error(number, NO_METHOD, f"no method {name}")
        try:
            return {"jsonrpc": "2.0", "id": number, "result": methods[name](params)}
        except (cfg.ConfigError, KeyError, ValueError) as e:
            return self._error(number, BAD_ARGUMENTS, str(e))

    @staticmethod
    def _error(number: Any, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": redact_message(text)}}

    def _initialize(self, params: dict) -> dict:
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}, "prompts": {}}, "serverInfo": {"name": "evisieve", "version": "2"}}

    def _call(self, params: dict) -> dict:
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            raise ValueError(f"no tool {name}")
        if wrong := validate(TOOLS[name].schema, given):
            raise ValueError("; ".join(wrong))
        try:
            result, failed = getattr(self, name)(**given), False
        except Exception as e:  # a tool's failure is its result, not the protocol's
            result, failed = redact_message(str(e)).split("\n")[0], True
        text = result if isinstance(result, str) else json.dumps(result, ensure_ascii=False, indent=2, default=str)
        return {"content": [{"type": "text", "text": text}], "isError": failed}

    def _prompt(self, params: dict) -> dict:
        name, values = params.get("name"), params.get("arguments") or {}
        if name not in self.presets:
            raise ValueError(f"no prompt {name}")
        if not all(isinstance(v, str) for v in values.values()):
            raise ValueError("arguments must be texts")
        p = self.presets[name]
        text = f"{p.expand(values)}\n\nCall evidence_pack with task {p.task}, effort {p.effort}" + (f" and sources {', '.join(p.sources)}" if p.sources else "") + "; answer from its evidence alone, and call verify with the answer."
        return {"description": p.description, "messages": [{"role": "user", "content": {"type": "text", "text": text}}]}

    # Tools

    def status(self) -> dict:
        tasks = [{"id": t.id, "label": t.label} for t in planning.TASKS.values()]
        if not self.engine.store.generations():
            return {"indexed": False, "hint": "call sync", "sources": self.engine.source_ids(), "tasks": tasks}
        return {"indexed": True, "tasks": tasks, **self.engine.status()}

    def search(self, query: str, k: int = 12, sources: list[str] | None = None, kinds: list[str] | None = None) -> list[dict]:
        def shown(hit: dict) -> dict:
            text = redact(hit["text"])[0] or ""  # masked before it is cut
            text = text if len(text) <= HIT_MOST else text[:HIT_MOST] + "\n…(truncated)"
            return {"rank": hit["rank"], "score": round(hit["score"], 5), "lines": f"{hit['start']}-{hit['end']}", "text": text, **{c: hit[c] for c in ("source_id", "path", "kind", "title", "url")}}

        return [shown(hit) for hit in self.engine.search(query, k, sources or None, kinds or None)]

    def evidence_pack(self, instruction: str, task: str = "spec", effort: str = "normal", sources: list[str] | None = None, include_static: bool | None = None) -> dict:
        pack = self.engine.evidence_pack(task, instruction, effort, sources or None)
        spec = planning.TASKS[task]
        static = None
        if "findings" in spec.needs if include_static is None else include_static:
            found = self.engine.scan(sources or None, "medium")
            static = {"summary": [r.asDict() for r in found["summary"].collect()], "findings": [r.asDict() for r in found["findings"].limit(60).collect()]}
        return {
            "pack_id": self.engine.save_pack(pack, task=task), "task": task, "contract": SYSTEM, "instruction": spec.instruction, "output_schema": planning.answer_schema(task), "index_key": self.engine.key,
            "evidence": packing.evidence_block(pack.items), "labels": {i["id"]: i["label"] for i in pack.items}, "tokens": pack.tokens, "dropped": pack.dropped, "static": static,
        }

    def verify(self, pack_id: str, result: dict) -> dict:
        if depth(result) > DEPTH_MOST or len(json.dumps(result)) > ANSWER_MOST:
            raise ValueError(f"an answer may nest {DEPTH_MOST} deep and hold {ANSWER_MOST} characters")
        pack = self.engine.load_pack(pack_id)
        v = self.engine.verify(result, pack, pack.task)
        return {"passed": v.ok, "stats": v.stats, "violations": v.violations, "verified_result": v.cleaned}

    def static_scan(self, sources: list[str] | None = None, severity: str = "low", limit: int = FINDINGS_MOST) -> dict:
        found = self.engine.scan(sources or None, severity)
        most = {"findings": limit, "summary": 1000, "facts": FACTS_MOST, "endpoints": ENDPOINTS_MOST}
        return {name: [r.asDict() for r in found[name].limit(n).collect()] for name, n in most.items()}

    def fetch(self, path: str | None = None, source: str | None = None, start: int = 1, end: int | None = None, pack_id: str | None = None, evidence_id: str | None = None) -> dict:
        if (pack_id is None) != (evidence_id is None) or (pack_id is None and path is None):
            raise ValueError("give a path, or pack_id and evidence_id")
        if pack_id is not None:
            item = next((i for i in self.engine.load_pack(pack_id).items if i["id"] == evidence_id), None)
            if item is None:
                raise ValueError(f"no {evidence_id} in the pack")
            return item
        return self.engine.window(path, source, start, end)

    def run_task(self, instruction: str, task: str = "spec", effort: str = "normal", sources: list[str] | None = None, dry_run: bool = False) -> str:
        out = self.engine.run_task(task, instruction, effort, None if dry_run else self.model, sources or None)
        return redact(out.get("report") or out["bundle"])[0] or ""

    def sync(self, sources: list[str] | None = None) -> dict:
        state = self.engine.sync(sources or None)
        return {"sources": state, "generation": self.engine.build_index()}


def serve(server: Server, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answers messages until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            answer = server.handle(json.loads(line))
        except ValueError:
            answer = Server._error(None, PARSE_ERROR, "not JSON")
        if answer is not None:
            print(json.dumps(answer, ensure_ascii=False), file=out, flush=True)
