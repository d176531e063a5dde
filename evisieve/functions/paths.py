"""Path and file expressions: kind and language, binary and encoding tests, deny lists, labels and links."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_glob, glob_regex

#: What file names and extensions mean, which paths are never read, and which of these are examples.
SPECIAL_NAMES = ("dockerfile", "makefile", "jenkinsfile", "procfile")
CODE = (
    "js", "mjs", "cjs", "jsx", "ts", "tsx", "py", "rb", "go", "rs", "java", "kt", "kts", "scala", "c", "h",
    "cc", "cpp", "hpp", "cs", "php", "swift", "m", "mm", "sh", "bash", "zsh", "sql", "graphql", "proto",
    "tf", "hcl", "vue", "svelte", "dart", "ex", "exs", "erl", "pl", "lua", "r", "groovy",
)
DOCS = (
    "md", "markdown", "mdx", "rst", "txt", "adoc",
)
CONFIG = (
    "json", "yaml", "yml", "toml", "ini", "env", "xml", "properties", "gradle", "cfg", "conf",
)
WORKSPACE = ".evisieve"
_KEY_FILES = "{txt,pem,key,json,yml,yaml,toml,ini,properties,env}"
DENY = (
    "**/.env", "**/.env.*", "**/.envrc",
    "**/*.pem", "**/*.key", "**/*.p12", "**/*.pfx", "**/*.jks", "**/*.keystore", "**/*.der", "**/*.crt.key",
    "**/id_rsa*", "**/id_dsa*", "**/id_ecdsa*", "**/id_ed25519*", "**/.ssh/**",
    "**/.netrc", "**/_netrc", "**/.npmrc", "**/.pypirc", "**/.git-credentials",
    "**/.aws/**", "**/.azure/**", "**/.docker/config.json", "**/.kube/**", "**/kubeconfig", "**/*.kubeconfig",
    "**/credentials", "**/credentials.json", "**/service-account*.json", "**/serviceaccount*.json", "**/credentials.{yml,yaml,toml,ini}",
    "**/private_key", "**/private-key", "**/*.privatekey",
    f"**/private_key.{_KEY_FILES}", f"**/private-key.{_KEY_FILES}", f"**/*_private_key.{_KEY_FILES}", f"**/*-private-key.{_KEY_FILES}",
    "**/*.secrets.*", "**/secrets.yaml", "**/secrets.yml", "**/secrets.json", "**/secret.yaml", "**/secret.yml",
    "**/.htpasswd", "**/*.ovpn", "**/*.asc", "**/*.gpg", "**/*.pgp", "**/*.tfstate", "**/*.tfstate.*", "**/.terraform/**",
    f"**/{WORKSPACE}/**", "**/.ds_store",
)
EXAMPLES = ("**/.env.example", "**/.env.sample", "**/.env.template", "**/.env.dist", "**/.env.test.example")
DENIED_DIRS = (".ssh", ".aws", ".kube", ".terraform", WORKSPACE)
SKIPPED_DIRS = (".ssh", ".aws", ".azure", ".kube", ".terraform", WORKSPACE, ".git", "node_modules")
TEST_PATH = "(?i)(?:^|/)(?:test|tests|__tests__|spec|fixtures?|mocks?|examples?|docs?)/"


def extension(path: Column) -> Column:
    """What follows the last full stop, or the whole path without one, in lower case."""
    return F.lower(F.substring_index(path, ".", -1))


def kind_and_lang(path: Column) -> tuple[Column, Column]:
    """kind (code, doc, config, other) and lang of a path."""
    base, ext = F.lower(F.substring_index(path, "/", -1)), extension(path)
    special = base.isin(*SPECIAL_NAMES)
    kind = F.when(special, "config").when(ext.isin(*CODE), "code").when(ext.isin(*DOCS), "doc").when(ext.isin(*CONFIG), "config").otherwise("other")
    return kind, F.when(special, base).when(ext == "", "txt").otherwise(ext)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 4096."""
    return F.contains(F.substring(content, 1, 4096), F.lit(b"\x00"))


def strict_text(content: Column) -> Column:
    """Bytes as text; null if they aren't UTF-8. A leading byte-order mark goes."""
    return F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")


def is_sensitive(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Paths that are never indexed, whatever is included; examples are allowed."""
    norm = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    denied = any_glob(norm, DENY) | any_glob(norm, [g.lower() for g in extra]) | F.arrays_overlap(F.split(norm, "/"), F.array(*map(F.lit, DENIED_DIRS)))
    return ~any_glob(norm, EXAMPLES) & denied


def is_included(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Exclusion wins; with nothing to include everything is."""
    inside = any_glob(path, include) if include else F.lit(True)
    return ~any_glob(path, exclude) & inside


def citation_label(source_id: Column, path: Column, kind: Column, start: Column, end: Column) -> Column:
    """source/path, with lines unless it is a document or ticket."""
    lines = F.when(kind.isin("doc", "ticket"), "").otherwise(F.concat(F.lit(":"), start, F.lit("-"), end))
    return F.concat(source_id, F.lit("/"), path, lines)


def line_url(url: Column, source_type: Column, kind: Column, start: Column, end: Column) -> Column:
    """A link to the lines for files of code hosts; the plain URL elsewhere."""
    own = (source_type == "github") & ~kind.isin("issue", "pr") & (start > 0)
    return F.when(own, F.concat(url, F.lit("#L"), start, F.lit("-L"), end)).otherwise(url)


def is_inside(root: str, target: str) -> bool:
    """True if `target` is `root` or below it, after resolving dots."""
    import os.path

    return PurePosixPath(os.path.normpath(target)).is_relative_to(os.path.normpath(root))


# Plain Python versions, for connectors that meet one path at a time.


def py_any_glob(path: str, globs: tuple[str, ...]) -> bool:
    return any(re.match(glob_regex(g).replace(r"\z", r"\Z"), path) for g in globs)


def py_kind_and_lang(path: str) -> tuple[str, str]:
    base, ext = path.rsplit("/", 1)[-1].lower(), path.rsplit(".", 1)[-1].lower()
    if base in SPECIAL_NAMES:
        return "config", base
    kind = next((k for k, known in (("code", CODE), ("doc", DOCS), ("config", CONFIG)) if ext in known), "other")
    return kind, ext or "txt"


def py_is_sensitive(path: str, extra: tuple[str, ...] = ()) -> bool:
    norm = path.replace("\\", "/").lower()
    denied = py_any_glob(norm, (*DENY, *(g.lower() for g in extra))) or not set(DENIED_DIRS).isdisjoint(norm.split("/"))
    return denied and not py_any_glob(norm, EXAMPLES)
