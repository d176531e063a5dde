"""Named investigation templates with arguments, checked before use."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from ..config import ConfigError, expand_template
from .planning import EFFORTS, TASKS

NAME = re.compile(r"[a-z][a-z0-9-]{0,40}\Z")
ARGUMENT = re.compile(r"[A-Za-z_]\w{0,40}\Z", re.A)


@dataclass(frozen=True)
class Preset:
    name: str
    description: str
    task: str
    instruction: str
    effort: str = "normal"
    sources: tuple[str, ...] = ()
    arguments: tuple[dict, ...] = field(default=())

    def expand(self, values: dict[str, str]) -> str:
        """The instruction with its arguments; unknown and missing ones are errors, optional ones may be empty."""
        known = {a["name"]: a for a in self.arguments}
        if extra := sorted(values.keys() - known):
            raise ConfigError(f"{self.name}: no argument {', '.join(extra)}")
        if missing := [n for n, a in known.items() if a.get("required", True) and not values.get(n)]:
            raise ConfigError(f"{self.name}: needs {', '.join(missing)}")
        return expand_template(self.instruction, {n: values.get(n, "") for n in known})


def problems(given: dict, sources: set[str]) -> list[str]:
    """What is wrong with one preset's settings."""
    out = []
    if not NAME.match(str(given.get("name", ""))):
        out.append("name: lower-case letters, digits and dashes")
    if given.get("task") not in TASKS:
        out.append(f"task: one of {', '.join(TASKS)}")
    if given.get("effort", "normal") not in EFFORTS:
        out.append(f"effort: one of {', '.join(EFFORTS)}")
    if not str(given.get("instruction", "")).strip():
        out.append("instruction: is empty")
    if unknown := [s for s in given.get("sources", ()) if s not in sources]:
        out.append(f"sources: unknown {', '.join(unknown)}")
    names = [a.get("name") for a in given.get("arguments", ())]
    if not all(isinstance(n, str) and ARGUMENT.match(n) for n in names) or len(set(names)) < len(names):
        out.append("arguments: distinct names of letters, digits and underscores")
    used = set(re.findall(r"(?<!\\)\{\{\s*([A-Za-z_]\w*)\s*\}\}", str(given.get("instruction", ""))))
    if undeclared := sorted(used - set(names)):
        out.append(f"instruction: undeclared {', '.join(undeclared)}")
    return out


def load(given: list[dict], sources: set[str]) -> tuple[dict[str, Preset], dict[str, list[str]]]:
    """Usable presets by name, and what is wrong with the others. A name used twice disables all its presets."""
    count = Counter(g.get("name") for g in given)
    good, bad = {}, {}
    for g in given:
        found = problems(g, sources) + ([f"name: {g['name']} occurs {count[g['name']]} times"] if count[g.get("name")] > 1 else [])
        if found:
            bad.setdefault(str(g.get("name")), []).extend(found)
        else:
            good[g["name"]] = Preset(g["name"], g.get("description", ""), g["task"], g["instruction"], g.get("effort", "normal"), tuple(g.get("sources", ())), tuple(g.get("arguments", ())))
    return good, bad
