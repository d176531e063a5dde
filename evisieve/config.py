"""Settings: defaults, merging, checks and the keys that tell whether an index is stale."""

from __future__ import annotations

import json
import os
import re
from copy import deepcopy
from hashlib import sha256
from typing import Any

from .functions.text import MOST_EDITS, edit_distance

DEFAULTS: dict[str, Any] = {
    "project": "untitled",
    "sources": [],
    "retrieval": {
        "chunk": {"code": {"max_lines": 110, "overlap_lines": 12, "max_chars": 6000}, "doc": {"max_chars": 2200, "overlap_chars": 220}},
        "glossary_bridge": True,
        "incremental": False,
        "hybrid": {"mmr_lambda": 0.72, "final": 28, "per_query_top": 60},
        "boosts": {"path_match": 0.35, "source_priority": 0.15, "kind_prior": 0.2},
        "embedding": {"provider": "none", "model": None, "dimensions": 512, "batch": 96},
    },
    "model": {"provider": "none", "model": None, "max_output_tokens": 16_000},
    "budget": {"evidence_tokens": 55_000, "static_facts_tokens": 6000, "max_total_tokens": 220_000, "max_repairs": 2},
    "security": {"network_mode": "normal", "allow_hosts": [], "deny_sensitive_paths": True, "extra_deny_paths": [], "redact_secrets": True, "allow_embedding_upload": False, "allow_llm_upload": True, "audit_log": True},
    "policy": {"require_citations": True, "min_evidence": 1, "verbatim_quotes": True, "drop_unverified": True, "forbid_speculation": True},
    "presets": [],
}
SOURCE_TYPES = ("github", "confluence", "jira", "local", "table")


class ConfigError(ValueError):
    """What is wrong with the settings, one problem a line."""


def merge(base: Any, over: Any) -> Any:
    """`over` on `base`: mappings deeply, all else replaced; None leaves the base."""
    if isinstance(base, dict) and isinstance(over, dict):
        return {k: merge(base.get(k), over[k]) if k in over else base[k] for k in [*base, *(k for k in over if k not in base)]}
    return base if over is None else over


def expand_env(value: Any, env: dict[str, str] | None = None) -> Any:
    """${NAME} in texts, from the environment; unknown names stay."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: env.get(m[1], m[0]), value)
    if isinstance(value, dict):
        return {k: expand_env(v, env) for k, v in value.items()}
    return [expand_env(v, env) for v in value] if isinstance(value, list) else value


def parse_env(text: str) -> dict[str, str]:
    """KEY=value lines; comments, blank lines and `export` allowed, quotes go."""
    out = {}
    for line in text.splitlines():
        if m := re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line):
            value = m[2]
            out[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].rstrip()
    return out


def nearest(name: str, known: list[str]) -> str | None:
    """A known name that `name` may be a slip for: the nearest within MOST_EDITS, case, dashes and underscores aside."""
    plain = lambda n: n.lower().replace("_", "").replace("-", "")
    found = [(edit_distance(plain(name), plain(k)), k) for k in known]
    return min(((d, k) for d, k in found if d <= MOST_EDITS), default=(0, None))[1]


def unknown_keys(given: Any, known: Any, path: str = "") -> list[str]:
    out = []
    for k in given if isinstance(given, dict) and isinstance(known, dict) else ():
        if k not in known:
            hint = nearest(k, list(known))
            out.append(f"{path}{k}: unknown" + (f", perhaps {hint}" if hint else ""))
        else:
            out += unknown_keys(given[k], known[k], f"{path}{k}.")
    return out


def problems(config: dict) -> list[str]:
    """All that is wrong with merged settings."""
    out = unknown_keys(config, DEFAULTS)

    def typed(value: Any, default: Any, path: str) -> None:
        if isinstance(default, dict):
            if not isinstance(value, dict):
                out.append(f"{path}: must be an object")
            else:
                for k, d in default.items():
                    typed(value.get(k), d, f"{path}.{k}".lstrip("."))
        elif isinstance(default, bool):
            if not isinstance(value, bool):
                out.append(f"{path}: must be true or false")
        elif isinstance(default, int | float):
            if isinstance(value, bool) or not isinstance(value, int | float) or value != value:
                out.append(f"{path}: must be a number")
            elif value < 0:
                out.append(f"{path}: must not be negative")
        elif isinstance(default, list) and not isinstance(value, list):
            out.append(f"{path}: must be a list")

    typed(config, DEFAULTS, "")
    if not out:
        chunk = config["retrieval"]["chunk"]
        if chunk["code"]["overlap_lines"] >= chunk["code"]["max_lines"] or chunk["doc"]["overlap_chars"] >= chunk["doc"]["max_chars"]:
            out.append("retrieval.chunk: overlap must be less than the size")
        seen = set()
        for i, s in enumerate(config["sources"]):
            if not isinstance(s, dict) or not re.fullmatch(r"[A-Za-z0-9][\w.-]*", str(s.get("id", "")), re.A):
                out.append(f"sources[{i}]: needs an id of letters, digits, dots and dashes")
                continue
            if s["id"] in seen:
                out.append(f"sources[{i}]: id {s['id']} occurs before")
            seen.add(s["id"])
            if s.get("type") not in SOURCE_TYPES:
                out.append(f"sources[{i}]: type must be one of {', '.join(SOURCE_TYPES)}")
            if not isinstance(s.get("priority", 1), int | float):
                out.append(f"sources[{i}]: priority must be a number")
        from .functions.redact import redact

        if redact(json.dumps(config["sources"], indent=0))[1]:
            out.append("sources: holds what looks like a secret; name an environment variable instead")
    return out


def load(given: dict | None = None, env: dict[str, str] | None = None) -> dict:
    """Checked settings on top of the defaults."""
    config = merge(deepcopy(DEFAULTS), expand_env(given or {}, env))
    if found := problems(config):
        raise ConfigError("\n".join(found))
    return config


def stable(value: Any) -> str:
    """JSON with sorted keys and no blanks: equal values give equal texts."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def index_key(config: dict) -> str:
    """Changes with whatever an index depends on."""
    parts = {"sources": config["sources"], "chunk": config["retrieval"]["chunk"], "embedding": config["retrieval"]["embedding"], "deny": config["security"]["extra_deny_paths"]}
    return sha256(stable(parts).encode()).hexdigest()


def source_priority(config: dict) -> dict[str, float]:
    """As set, else a little less from source to source."""
    return {s["id"]: float(s.get("priority", 1 - 0.05 * i)) for i, s in enumerate(config["sources"])}


def expand_template(text: str, values: dict[str, str]) -> str:
    """{{name}} replaced once; \\{{ is a literal. Unknown names are an error."""

    def one(m: re.Match[str]) -> str:
        if m[1]:
            return "{{"
        if m[2] not in values:
            raise ConfigError(f"no value for {{{{{m[2]}}}}}")
        return values[m[2]]

    return re.sub(r"(\\\{\{)|\{\{\s*([A-Za-z_]\w*)\s*\}\}", one, text)
