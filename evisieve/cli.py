"""Command line: python -m evisieve.cli COMMAND --workspace DIR --config FILE ..."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from . import config as cfg
from .functions.urls import url_to_source
from .operators import planning, presets

COMMANDS = ("init", "resolve", "sync", "build", "status", "search", "scan", "pack", "run", "ask", "verify", "serve", "presets", "tasks", "doctor", "privacy")


#: Names of a settings file, in the order in which a folder is searched for them.
CONFIG_NAMES = ("evisieve.config.json", ".evisieve.config.json", "evisieve.json")


def find_config(start: Path) -> Path | None:
    """A settings file here or in a folder above."""
    return next((f for d in (start, *start.parents) for n in CONFIG_NAMES if (f := d / n).exists()), None)


def guarded(workspace: str, mode: int = 0o700) -> None:
    """Keeps a workspace on this machine from other users and out of version control; one elsewhere has its own rights."""
    if "://" in workspace and not workspace.startswith("file:"):
        return
    folder = Path("/" + workspace.removeprefix("file:").lstrip("/")) if workspace.startswith("file:") else Path(workspace)
    folder.mkdir(parents=True, exist_ok=True)
    try:
        folder.chmod(mode)
    except OSError:  # a file system without rights
        pass
    ignore = folder / ".gitignore"
    if not ignore.exists():
        ignore.write_text("*\n")


def privacy(config: dict) -> dict[str, Any]:
    """What may leave this machine under these settings."""
    s = config["security"]
    return {"offline": s["network_mode"] == "offline", "hosts": s["allow_hosts"], "texts_to_embedding_service": s["allow_embedding_upload"], "prompts_to_model": s["allow_llm_upload"], "credentials_masked": s["redact_secrets"]}


def doctor(config: dict) -> list[str]:
    """Problems that would stop a run."""
    _, bad = presets.load(config["presets"], {s["id"] for s in config["sources"]})
    out = [f"preset {n}: {p}" for n, ps in bad.items() for p in ps]
    out += [f"source {s['id']}: no such folder" for s in config["sources"] if s["type"] == "local" and "://" not in s.get("path", "") and not Path(s.get("path", "")).exists()]
    return out + ([] if config["sources"] else ["no source is set"])


def model_of(config: dict) -> Any:
    """The model service of the settings; None if there is none."""
    from .sources import services

    s = config["security"]
    return None if config["model"]["provider"] == "none" else services.model(config["model"], tuple(s["allow_hosts"]), s["network_mode"] == "offline")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evisieve")
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("text", nargs="*", help="query, instruction, URL or file")
    parser.add_argument("--workspace", default=".evisieve")
    parser.add_argument("--config")
    parser.add_argument("--task", choices=tuple(planning.TASKS), default="spec")
    parser.add_argument("--effort", choices=tuple(planning.EFFORTS), default="normal")
    parser.add_argument("--source", action="append")
    parser.add_argument("--severity", default="info")
    parser.add_argument("-k", type=int, default=20)
    parser.add_argument("--preset", help="run this preset; TEXT is name=value arguments")
    parser.add_argument("--dry-run", action="store_true")
    a = parser.parse_args(argv)
    text = " ".join(a.text)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if a.command == "tasks":
        show([{"id": t.id, "label": t.label, "item_types": t.item_types} for t in planning.TASKS.values()])
        return 0
    if a.command == "resolve":
        show(url_to_source(text))
        return 0
    path = Path(a.config) if a.config else find_config(Path.cwd())
    if a.command == "init":
        Path("evisieve.json").open("x").write(json.dumps({"project": Path.cwd().name, "sources": []}, indent=2))
        return 0
    given = json.loads(path.read_text()) if path else {}
    try:
        config = cfg.load(given)
    except cfg.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    if a.command in ("doctor", "privacy"):
        found = doctor(config) if a.command == "doctor" else privacy(config)
        show(found)
        return int(a.command == "doctor" and bool(found))
    if a.command == "presets":
        show({"presets": list(presets.load(config["presets"], {s["id"] for s in config["sources"]})[0])})
        return 0
    from pyspark.sql import SparkSession

    from .engine import Engine
    from .operators.packing import Pack

    guarded(a.workspace)
    engine = Engine(SparkSession.builder.getOrCreate(), f"file://{Path(a.workspace).resolve()}", given)
    if a.command == "sync":
        state = engine.sync(a.source)
        show(state)
        return int(not all(s["ok"] for s in state.values()))
    if a.command == "build":
        show({"generation": engine.build_index()})
    elif a.command == "status":
        show(engine.status())
    elif a.command == "search":
        show([{k: h[k] for k in ("rank", "score", "source_id", "path", "start", "end", "title")} for h in engine.search(text, a.k, a.source)])
    elif a.command == "scan":
        show([r.asDict() for r in engine.scan(a.source, a.severity)["findings"].limit(1000).collect()])
    elif a.command == "pack":
        pack = engine.evidence_pack(a.task, text, a.effort, a.source)
        show({"pack": engine.save_pack(pack), "items": [i["label"] for i in pack.items], "tokens": pack.tokens})
    elif a.command in ("run", "ask"):
        model = None if a.dry_run or a.command == "run" and not a.preset else model_of(config)
        if a.preset:
            out = engine.run_preset(a.preset, dict(x.split("=", 1) for x in a.text), model, save=True)
        else:
            out = engine.run_task(a.task, text, a.effort, model, a.source, save=True)
        print(out.get("report") or out["bundle"])
    elif a.command == "serve":
        from .server import Server, serve

        serve(Server(engine, model_of(config)))
    else:
        answer, saved = a.text
        verdict = engine.verify(Path(answer).read_text(), Pack(json.loads(Path(saved).read_text())["items"]), a.task)
        show({"ok": verdict.ok, "violations": verdict.violations, "stats": verdict.stats})
        return int(not verdict.ok)
    return 0


if __name__ == "__main__":
    sys.exit(main())
