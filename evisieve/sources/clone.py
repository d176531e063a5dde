"""Managed clones of code repositories: a few git commands, in a clean environment."""

from __future__ import annotations

import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .remote import DEFAULT_EXCLUDES, EgressDenied
from .tables import file_docs

COMMANDS = ("clone", "fetch", "checkout", "rev-parse", "config")
KEPT_ENV = ("PATH", "HOME", "LANG", "SSH_AUTH_SOCK", "SSL_CERT_FILE")
REF = re.compile(r"[A-Za-z0-9][\w./-]*\Z", re.A)


def git(folder: Path | None, command: str, *args: str, timeout: int = 600) -> str:
    """Output of one allowed git command; no hooks, prompts, file protocol or inherited GIT_ variables."""
    if command not in COMMANDS:
        raise EgressDenied(f"git {command} isn't allowed")
    env = {k: v for k, v in os.environ.items() if k in KEPT_ENV} | {"GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "GIT_ALLOW_PROTOCOL": "https"}
    options = ["-c", "core.hooksPath=/dev/null", "-c", "protocol.file.allow=never"]
    done = subprocess.run(["git", *options, *(["-C", str(folder)] if folder else []), command, *args], env=env, capture_output=True, text=True, timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"git {command} failed: {done.stderr.strip().splitlines()[-1:] or done.returncode}")
    return done.stdout.strip()


def refuse_rewrites(config: str) -> None:
    """URL rewriting would send a clone elsewhere than the allowed host."""
    if re.search(r"^url\..*\.(?:insteadof|pushinsteadof)=", config, re.I | re.M):
        raise EgressDenied("git rewrites URLs (insteadOf)")


def clone(source: dict, folder: str, hosts: tuple[str, ...]) -> tuple[Path, str]:
    """A shallow clone of the source's ref, made or brought up to date, and its commit."""
    host, ref = source.get("host", "github.com"), source.get("ref", "main")
    if host not in hosts:
        raise EgressDenied(f"{host} isn't among the allowed hosts")
    if not REF.match(ref) or ".." in ref or not re.fullmatch(r"[\w-][\w.-]*/[\w-][\w.-]*", source["repo"], re.A):
        raise ValueError("a ref or repository name that git could take for an option or path")
    target = Path(folder) / source["id"]
    url = f"https://{host}/{source['repo']}.git"
    if (target / ".git").exists():
        refuse_rewrites(git(target, "config", "--list"))
        git(target, "fetch", "--depth", "1", "origin", ref)
        git(target, "checkout", "--force", "FETCH_HEAD")
    else:
        git(None, "clone", "--depth", "1", "--branch", ref, "--", url, str(target))
    return target, git(target, "rev-parse", "HEAD")


def cloned_docs(spark: SparkSession, source: dict, folder: str, hosts: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Documents of a clone and counts of skipped files. The folder has to be one that executors share."""
    target, _ = clone(source, folder, hosts)
    return file_docs(spark, f"file://{target.resolve()}", source["id"], tuple(source.get("include", ())), (*DEFAULT_EXCLUDES, *source.get("exclude", ())))
