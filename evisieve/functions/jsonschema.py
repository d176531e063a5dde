"""A JSON-schema subset, and finding JSON in what a model wrote."""

from __future__ import annotations

import json
import math
import re
from typing import Any

TYPES = {
    "string": lambda v: isinstance(v, str),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and math.isfinite(v) and v == int(v)),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
    "null": lambda v: v is None,
}


def type_name(value: Any) -> str:
    return next((t for t in ("null", "boolean", "array", "object", "string", "number") if TYPES[t](value)), "unknown")


def validate(schema: dict | None, value: Any, path: str = "$") -> list[str]:
    """What is wrong with `value`, by path; empty if nothing is. A wrong type ends the look at that value."""
    if not schema:
        return []
    wanted = schema.get("type")
    wanted = wanted if isinstance(wanted, list) else [wanted] if wanted else []
    if wanted and not any(TYPES.get(t, lambda v: True)(value) for t in wanted):
        return [f"{path}: expected {'|'.join(wanted)}, got {type_name(value)}"]
    out = []
    bound = lambda key, n, ok, text: out.append(f"{path}: {text} {schema[key]}") if key in schema and not ok(n, schema[key]) else None
    least, most = (lambda n, k: n >= k), (lambda n, k: n <= k)
    if schema.get("enum") and value not in schema["enum"]:
        out.append(f"{path}: {json.dumps(value, ensure_ascii=False)} is none of {', '.join(map(str, schema['enum']))}")
    if TYPES["number"](value) and math.isfinite(value):
        bound("minimum", value, least, "must be at least")
        bound("maximum", value, most, "must be at most")
    if isinstance(value, str):
        bound("minLength", len(value), least, "length must be at least")
        bound("maxLength", len(value), most, "length must be at most")
        if schema.get("pattern") and not re.search(schema["pattern"], value):
            out.append(f"{path}: doesn't match {schema['pattern']}")
    if isinstance(value, list):
        bound("minItems", len(value), least, "items must be at least")
        bound("maxItems", len(value), most, "items must be at most")
        for i, v in enumerate(value):
            out += validate(schema.get("items"), v, f"{path}[{i}]")
    if isinstance(value, dict):
        out += [f"{path}.{k}: is required" for k in schema.get("required", []) if value.get(k) is None]
        known = schema.get("properties", {})
        for k, v in value.items():
            if k in known:
                out += validate(known[k], v, f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: isn't known")
    return out


def _parsed(text: str) -> Any:
    try:
        return json.loads(text)
    except ValueError:
        return None


def extract_json(text: str | None) -> Any:
    """The JSON of a reply: all of it, else its first fenced block, else the first balanced object in it."""
    text = (text or "").strip()
    if found := _parsed(text):
        return found
    if (fence := re.search(r"```(?:json)?\s*(.*?)```", text, re.S)) and (found := _parsed(fence[1].strip())):
        return found
    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', text[start:], re.S):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == "}" and depth == 0 and (found := _parsed(text[start : start + m.end()])):
            return found
    return None
