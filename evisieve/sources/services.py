"""Embedding and model services: requests and answers as plain values, and calls through the gate.

Nothing is sent unless the settings allow it; texts are masked before they leave (embedding.embed_chunks,
packing). Keys come from environment variables, never from settings.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from ..config import ConfigError
from ..functions.jsonschema import extract_json
from .remote import Gate, RemoteError

#: Where the services are, what their keys are called, and what their answers say when they are cut.
EMBEDDING_URLS = {"openai": "https://api.openai.com/v1/embeddings", "voyage": "https://api.voyageai.com/v1/embeddings"}
MODEL_URLS = {"openai": "https://api.openai.com/v1/chat/completions", "anthropic": "https://api.anthropic.com/v1/messages"}
KEY_NAMES = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "voyage": "VOYAGE_API_KEY", "compatible": "LLM_API_KEY"}
CUT_OFF = ("max_tokens", "length")
#: Characters of a query that are sent.
QUERY_MOST = 8000


@dataclass
class Usage:
    """Tokens that a run cost."""

    input: int = 0
    output: int = 0
    cache_read: int = 0
    cache_write: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(*(a + b for a, b in zip(asdict(self).values(), asdict(other).values())))


@dataclass
class Reply:
    """What a model answered; `cut` if its output limit ended it, which the same request would meet again."""

    text: str
    usage: Usage = field(default_factory=Usage)
    cut: bool = False
    json: Any = None


def key_of(settings: dict) -> str:
    name = settings.get("api_key_env") or KEY_NAMES[settings["provider"]]
    if not os.environ.get(name):
        raise ConfigError(f"the environment has no {name}")
    return os.environ[name]


def embedding_request(settings: dict, texts: list[str], purpose: str = "document") -> tuple[str, dict]:
    """URL and body. Where the service tells queries from documents, `purpose` (document or query) says which."""
    provider, base = settings["provider"], settings.get("base_url")
    body: dict[str, Any] = {"model": settings["model"], "input": texts}
    if provider == "voyage":
        return base or EMBEDDING_URLS["voyage"], body | {"input_type": purpose, "output_dimension": settings["dimensions"]}
    if provider == "openai" and settings.get("dimensions"):
        body["dimensions"] = settings["dimensions"]
    return (base.rstrip("/") + "/embeddings" if base else EMBEDDING_URLS["openai"]), body


def embedding_vectors(answer: Any, expected: int, dimensions: int) -> list[list[float]]:
    """Vectors in the order of the texts, by the index that each names; another number or length is an error."""
    rows = answer.get("data") if isinstance(answer, dict) else None
    if not isinstance(rows, list) or len(rows) != expected:
        raise RemoteError(f"the service answered {len(rows) if isinstance(rows, list) else 'no'} vectors for {expected} texts")
    vectors = [r.get("embedding") for r in sorted(rows, key=lambda r: r.get("index", 0))]
    if wrong := next((v for v in vectors if not isinstance(v, list) or len(v) != dimensions), None):
        raise RemoteError(f"the service gives vectors of {len(wrong)} numbers; retrieval.embedding.dimensions is {dimensions}", retry=False)
    return vectors


def _gate(settings: dict, hosts: tuple[str, ...], offline: bool, url: str, headers: dict[str, str]) -> Gate:
    from urllib.parse import urlsplit

    return Gate(hosts, offline, headers, posts=(urlsplit(url).path,), timeout=settings.get("timeout", 180.0))


def embedder(settings: dict, hosts: tuple[str, ...], offline: bool = False) -> Callable[..., list[list[float]]]:
    """A function from texts to vectors, for documents in tasks and for queries on the driver."""

    def embed(texts: list[str], purpose: str = "document") -> list[list[float]]:
        url, body = embedding_request(settings, texts, purpose)
        gate = _gate(settings, hosts, offline, url, {})
        gate.check(url, "POST")  # before a missing key is complained of
        gate.headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key_of(settings)}"}
        return embedding_vectors(gate(url, body=body), len(texts), settings["dimensions"])

    return embed


def model_request(settings: dict, system: str, user: str, schema: dict | None) -> tuple[str, dict[str, str], dict]:
    """URL, name of the key's header and body. Models are asked for JSON by schema where they take one."""
    limit, common = settings.get("max_output_tokens", 16_000), {"model": settings["model"], "temperature": settings.get("temperature", 0)}
    if settings["provider"] == "anthropic":
        body = common | {"max_tokens": limit, "system": [{"type": "text", "text": system}], "messages": [{"role": "user", "content": user}]}
        if schema:
            body |= {"tools": [{"name": "report", "description": "The report", "input_schema": schema}], "tool_choice": {"type": "tool", "name": "report"}}
        base = settings.get("base_url")
        return (base.rstrip("/") + "/v1/messages" if base else MODEL_URLS["anthropic"]), {"header": "x-api-key", "prefix": ""}, body
    body = common | {"max_tokens": limit, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
    if schema:
        body["response_format"] = {"type": "json_schema", "json_schema": {"name": "report", "schema": schema, "strict": False}}
    base = settings.get("base_url")
    return (base.rstrip("/") + "/chat/completions" if base else MODEL_URLS["openai"]), {"header": "Authorization", "prefix": "Bearer "}, body


def model_reply(provider: str, answer: dict) -> Reply:
    """Text, JSON and usage of an answer."""
    used = answer.get("usage") or {}
    if provider == "anthropic":
        parts = answer.get("content") or []
        text = "\n".join(p["text"] for p in parts if p.get("type") == "text")
        given = next((p["input"] for p in parts if p.get("type") == "tool_use"), None)
        usage = Usage(used.get("input_tokens", 0), used.get("output_tokens", 0), used.get("cache_read_input_tokens", 0), used.get("cache_creation_input_tokens", 0))
        return Reply(text, usage, answer.get("stop_reason") in CUT_OFF, extract_json(text) if given is None else given)
    choice = (answer.get("choices") or [{}])[0]
    text = (choice.get("message") or {}).get("content") or ""
    usage = Usage(used.get("prompt_tokens", 0), used.get("completion_tokens", 0), (used.get("prompt_tokens_details") or {}).get("cached_tokens", 0))
    return Reply(text, usage, choice.get("finish_reason") in CUT_OFF, extract_json(text))


def model(settings: dict, hosts: tuple[str, ...], offline: bool = False) -> Callable[[str, str, dict | None], Reply]:
    """A function from system text, prompt and schema to a reply. A service that refuses schemas is asked for JSON alone."""

    def complete(system: str, user: str, schema: dict | None = None) -> Reply:
        url, key, body = model_request(settings, system, user, schema)
        gate = _gate(settings, hosts, offline, url, {})
        gate.check(url, "POST")
        gate.headers = {"Content-Type": "application/json", key["header"]: key["prefix"] + key_of(settings)}
        if settings["provider"] == "anthropic":
            gate.headers["anthropic-version"] = "2023-06-01"
        try:
            answer = gate(url, body=body)
        except RemoteError as e:
            if "response_format" not in body or "HTTP 400" not in str(e):
                raise
            answer = gate(url, body=body | {"response_format": {"type": "json_object"}})
        return model_reply(settings["provider"], answer)

    return complete
