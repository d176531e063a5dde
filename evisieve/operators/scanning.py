"""Rule scans of code and settings, project facts and endpoints; no model is involved.

Every rule is a pattern on one line; all rules meet a document's line array in one projection, and only lines
that break one become rows, with context from that array. Findings are capped per rule and
document, as that limit is part of what the scan reports.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import TEST_PATH
from ..functions.redact import mask_keys_udf, redact, redact_udf
from ..functions.redact import S as SPACE
from ..schemas import ENDPOINT, FINDING
from .tables import kept

SEVERITIES = ("info", "low", "medium", "high", "critical")
LINE_MOST, SNIPPET, WINDOW, AROUND, PER_DOC = 4000, 300, 6, 2, 20
_JS = ("js", "mjs", "cjs", "jsx", "ts", "tsx")


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    cwe: str | None
    title: str
    pattern: str
    langs: tuple[str, ...] = ()
    ignore: str | None = None
    #: The next lines must lack one of these.
    lacks: tuple[str, ...] = ()


#: The rules. Patterns are Java's; \\b stands for an ASCII word boundary (_B).
_B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
RULES = [
    Rule("SEC-SECRET-PRIVATE-KEY", "critical", "secret", "CWE-798", "A private key is in the repository", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"),
    Rule("SEC-SECRET-AWS-AKID", "critical", "secret", "CWE-798", "Looks like an AWS access key id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("SEC-SECRET-GH-TOKEN", "critical", "secret", "CWE-798", "Looks like a GitHub token", r"\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b"),
    Rule("SEC-SECRET-SLACK", "high", "secret", "CWE-798", "Looks like a Slack token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    Rule("SEC-SECRET-GENERIC", "high", "secret", "CWE-798", "Possibly hard-coded credentials", r"""(?i)\b(?:api[_-]?key|access[_-]?key|client[_-]?secret|[a-z_]*secret|[a-z_]*token|passwd|password|credential|key)\s*[:=]\s*["'][^"'\s${}]{12,}["']""", ignore=r"(?i)(process\.env|os\.environ|getenv|System\.getenv|\$\{|<%|例|sample|example|dummy|placeholder|xxx|changeme|your[_-]?)"),
    Rule("SEC-EVAL", "high", "injection", "CWE-95", "Code is run from text", r"\b(?:eval\s*\(|new\s+Function\s*\(|vm\.runInNewContext\s*\()", _JS),
    Rule("SEC-EXEC-SHELL", "high", "injection", "CWE-78", "A command goes through the shell", r"\b(?:child_process\.)?exec(?:Sync)?\s*\(|\bshell\s*=\s*True|\bRuntime\.getRuntime\(\)\.exec\(|\bos\.system\s*\("),
    Rule("SEC-SQL-CONCAT", "high", "injection", "CWE-89", "SQL is put together from strings", r"""(?i)(?:SELECT|INSERT|UPDATE|DELETE)\b[^\n;]{0,200}(?:\+\s*(?:req|params|query|body|input|user|id)\b|\$\{[^}]+\}|%s['"]?\s*%|f["'][^"']*\{)"""),
    Rule("SEC-XSS-DANGEROUS-HTML", "high", "injection", "CWE-79", "HTML is inserted unescaped", r"dangerouslySetInnerHTML|\.innerHTML\s*=|document\.write\s*\(|v-html\s*="),
    Rule("SEC-PATH-TRAVERSAL", "medium", "injection", "CWE-22", "A path is joined with outside input", r"(?:path\.join|path\.resolve|os\.path\.join|readFile(?:Sync)?|open)\s*\([^)\n]{0,120}\b(?:req\.(?:query|params|body)|request\.(?:args|form)|params\[)"),
    Rule("SEC-DESERIALIZE", "high", "injection", "CWE-502", "Unsafe deserialisation", r"\b(?:pickle\.loads?|yaml\.load\s*\((?![^)]*Safe)|unserialize\s*\(|ObjectInputStream)"),
    Rule("SEC-TLS-DISABLED", "critical", "transport", "CWE-295", "TLS isn't verified", r"NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0|rejectUnauthorized\s*:\s*false|verify\s*=\s*False|InsecureSkipVerify\s*:\s*true|curl.*(?:-k\b|--insecure)"),
    Rule("SEC-WEAK-HASH", "medium", "crypto", "CWE-327", "MD5 or SHA-1", r"""(?i)createHash\s*\(\s*['"](?:md5|sha1)['"]|hashlib\.(?:md5|sha1)\s*\(|MessageDigest\.getInstance\s*\(\s*"(?:MD5|SHA-1)\""""),
    Rule("SEC-WEAK-RANDOM", "medium", "crypto", "CWE-338", "Random numbers unfit for secrets", r"(?i)(?:token|secret|nonce|salt|otp|session|password)[^\n=]{0,30}=\s*[^\n]{0,40}(?:Math\.random\s*\(|random\.random\s*\(|rand\s*\()"),
    Rule("SEC-JWT-NOVERIFY", "critical", "authn", "CWE-347", "A JWT's signature isn't verified", r"""(?i)jwt\.decode\s*\((?![^)]*verify)|verify\s*:\s*false|algorithms?\s*:\s*\[?\s*['"]none['"]"""),
    Rule("SEC-CORS-WILDCARD", "medium", "authz", "CWE-942", "CORS allows every origin", r"""Access-Control-Allow-Origin['"]?\s*[:,]\s*['"]\*['"]|origin\s*:\s*['"]\*['"]|cors\(\s*\)"""),
    Rule("SEC-COOKIE-INSECURE", "medium", "session", "CWE-614", "A cookie lacks secure or httpOnly", r"(?:res\.cookie|set_cookie|setCookie)\s*\([^)]{0,200}\)", lacks=(r"(?i)httpOnly\s*:\s*true", r"(?i)secure\s*:\s*true")),
    Rule("REL-EMPTY-CATCH", "medium", "reliability", None, "An exception is swallowed", r"catch\s*(?:\([^)]*\))?\s*\{\s*\}|except[^\n:]*:\s*pass\b"),
    Rule("REL-AWAIT-IN-LOOP", "low", "performance", None, "await in a loop", r"for\s*\([^)]*\)\s*\{[^}]{0,200}await\s|forEach\s*\(\s*async"),
    Rule("REL-NO-TIMEOUT", "low", "reliability", None, "An HTTP call has no timeout", r"\b(?:fetch|axios\.(?:get|post|put|delete)|requests\.(?:get|post))\s*\([^)]{0,200}\)", lacks=(r"(?i)timeout|signal|AbortController",)),
    Rule("REL-TODO", "info", "debt", None, "Unfinished", r"\b(?:TODO|FIXME|HACK|XXX)\b[:\s]"),
    Rule("REL-DEBUG-LEFTOVER", "low", "debt", None, "Debug output", r"\b(?:console\.(?:log|debug)|print\s*\(|debugger;|binding\.pry|System\.out\.println)"),
    Rule("REL-TS-ANY", "info", "debt", None, "any or @ts-ignore", r":\s*any\b|@ts-ignore|@ts-nocheck", ("ts", "tsx")),
]

#: What the lower-cased text must hold one of for a rule to be looked at.
NEEDS = {
    "SEC-SECRET-PRIVATE-KEY": ("private key-----",),
    "SEC-SECRET-AWS-AKID": ("akia", "asia"),
    "SEC-SECRET-GH-TOKEN": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "SEC-SECRET-SLACK": ("xox",),
    "SEC-SECRET-GENERIC": ("key", "secret", "token", "passwd", "password", "credential"),
    "SEC-EVAL": ("eval", "function", "runinnewcontext"),
    "SEC-EXEC-SHELL": ("exec", "shell", "os.system"),
    "SEC-SQL-CONCAT": ("select", "insert", "update", "delete"),
    "SEC-XSS-DANGEROUS-HTML": ("dangerouslysetinnerhtml", ".innerhtml", "document.write", "v-html"),
    "SEC-PATH-TRAVERSAL": ("path.join", "path.resolve", "readfile", "open"),
    "SEC-DESERIALIZE": ("pickle.load", "yaml.load", "unserialize", "objectinputstream"),
    "SEC-TLS-DISABLED": ("node_tls_reject_unauthorized", "rejectunauthorized", "verify", "insecureskipverify", "curl"),
    "SEC-WEAK-HASH": ("createhash", "hashlib", "messagedigest"),
    "SEC-WEAK-RANDOM": ("math.random", "random.random", "rand"),
    "SEC-JWT-NOVERIFY": ("jwt.decode", "verify", "algorithm"),
    "SEC-CORS-WILDCARD": ("access-control-allow-origin", "origin", "cors("),
    "SEC-COOKIE-INSECURE": ("res.cookie", "set_cookie", "setcookie"),
    "REL-EMPTY-CATCH": ("catch", "except"),
    "REL-AWAIT-IN-LOOP": ("await", "foreach"),
    "REL-NO-TIMEOUT": ("fetch", "axios.", "requests."),
    "REL-TODO": ("todo", "fixme", "hack", "xxx"),
    "REL-DEBUG-LEFTOVER": ("console.", "print", "debugger;", "binding.pry", "system.out"),
    "REL-TS-ANY": ("any", "@ts-"),
}


def java(pattern: str) -> str:
    """The pattern with ASCII word boundaries and Unicode white space."""

    def one(m: re.Match[str]) -> str:
        if m["escape"]:
            return {r"\s": f"[{SPACE}]", r"\b": _B}.get(m["escape"], m["escape"])
        return m["set"].replace(r"\s", SPACE)

    return re.sub(r"(?P<escape>\\.)|(?P<set>\[(?:\\.|[^\]\\])*\])", one, pattern)


def rank_of(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0))


def possible(text: Column, rules: list[Rule]) -> Column:
    """Bits of the rules whose indispensable words a document holds; plain searches, once per document."""
    return reduce(add, [F.when(reduce(or_, [F.contains(text, F.lit(x)) for x in NEEDS[r.id]]), F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules)])


def hits_of(line: Column, lang: Column, after: Column, can: Column, rules: list[Rule]) -> Column:
    """The rules (as ordinals) that a line breaks."""

    def breaks(i: int, r: Rule) -> Column:
        found = (can.bitwiseAND(F.lit(1 << i)) != 0) & line.rlike(java(r.pattern))
        if r.langs:
            found = lang.isin(*r.langs) & found
        if r.ignore:
            found = found & ~line.rlike(java(r.ignore))
        if r.lacks:
            missing = ~after.rlike(java(r.lacks[0]))
            for more in r.lacks[1:]:
                missing = missing | ~after.rlike(java(more))
            found = found & missing
        return found

    return F.array_compact(F.array(*[F.when(breaks(i, r), F.lit(i)) for i, r in enumerate(rules)]))


def findings(docs: DataFrame, least: str = "info", test_paths: bool = False, masked: bool = True) -> DataFrame:
    """Findings (schemas.FINDING) in documents of kind code or config. masked: snippets and context hide credentials."""
    rules = [r for r in RULES if SEVERITIES.index(r.severity) >= SEVERITIES.index(least)]
    docs = docs.where(F.col("kind").isin("code", "config"))
    if not test_paths:
        docs = docs.where(~F.col("path").rlike(TEST_PATH))
    docs = docs.select("doc_id", "source_id", "source_type", "path", "lang", "url", F.split("text", "\n", -1).alias("lines"), possible(F.lower("text"), rules).alias("can"))
    docs = docs.where("can != 0")
    # Lines are tested inside the array, so that only hits become rows that carry it.
    after = lambda i: F.array_join(F.slice("lines", i + 1, WINDOW), "\n")
    none = F.array().cast("array<int>")
    tested = F.transform("lines", lambda line, i: F.struct(i.alias("i"), F.when(F.length(line) <= LINE_MOST, hits_of(line, F.col("lang"), after(i), F.col("can"), rules)).otherwise(none).alias("rules")))
    broken = F.filter(tested, lambda h: F.size(h["rules"]) > 0)
    hits = F.flatten(F.transform(broken, lambda h: F.transform(h["rules"], lambda r: F.struct(h["i"].alias("i"), r.alias("rule")))))
    # Generated columns are computed once, however often they are named below; as plain columns the tests would run for each use.
    docs = docs.select("source_id", "source_type", "path", "url", "lines", F.explode_outer(F.array(hits)).alias("hits")).where(F.size("hits") > 0)
    # A document is one row, so its cap by rule needs no shuffle, and keys are masked once for all its findings.
    of_rule = lambda i: F.filter("hits", lambda h: h["rule"] == i)
    capped = F.flatten(F.array(*[F.slice(of_rule(i), 1, PER_DOC) for i in range(len(rules))]))
    safe = mask_keys_udf(F.array_join("lines", "\n")) if masked else F.array_join("lines", "\n")
    docs = docs.withColumn("capped", capped).withColumn("safe", F.split(safe, "\n", -1))
    # The outer form adds no filter on the array, which would be pushed down and test all lines again.
    rows = docs.select("source_id", "source_type", "path", "url", "safe", F.explode_outer("capped").alias("h")).where("h is not null")
    rows = rows.select("*", F.col("h.i").alias("i"), F.col("h.rule").alias("rule")).drop("h")
    cut = lambda c: F.substring(c, 1, LINE_MOST)
    first = F.greatest(F.col("i") - AROUND, F.lit(0))
    snippet = cut(F.trim(F.get("safe", F.col("i"))))
    around = F.array_join(F.transform(F.slice("safe", first + 1, F.col("i") + AROUND + 1 - first), cut), "\n")
    short = lambda c: F.substring(c, 1, SNIPPET)
    rows = rows.select("source_id", "source_type", "path", "url", "i", "rule", snippet.alias("snippet"), around.alias("context"))
    rows = rows.withColumn("snippet", short(redact_udf("snippet")["text"] if masked else F.col("snippet")))
    context = redact_udf("context")["text"] if masked else F.col("context")
    rows = rows.withColumn("context", F.array_join(F.transform(F.split(context, "\n", -1), short), "\n"))
    known = F.array(*[F.struct(*[F.lit(getattr(r, c)).cast("string").alias(n) for c, n in (("id", "rule_id"), ("severity", "severity"), ("category", "category"), ("cwe", "cwe"), ("title", "title"))]) for r in rules])
    url = F.when(F.col("source_type") == "github", F.concat("url", F.lit("#L"), F.col("i") + 1)).otherwise(F.col("url"))
    return rows.withColumn("r", F.get(known, F.col("rule"))).select("r.*", "source_id", "path", (F.col("i") + 1).alias("line"), "snippet", "context", url.alias("url"))


def ordered(found: DataFrame) -> DataFrame:
    """Severest first, then by rule, path and line in dictionary order."""
    return found.orderBy(rank_of(F.col("severity")).desc(), F.collate("rule_id", "UNICODE"), F.collate("path", "UNICODE"), "line")


def numbered(report: DataFrame) -> DataFrame:
    """A report's findings with their place in it; a report is bounded, so one window over all of it is."""
    order = Window.orderBy(rank_of(F.col("severity")).desc(), F.collate("rule_id", "UNICODE"), F.collate("path", "UNICODE"), "line")
    return report.withColumn("place", F.row_number().over(order))


def evidence_first(found: DataFrame, items: DataFrame, most: int = 120) -> DataFrame:
    """Findings in files that the pack cites before all others, each in their order; a report's top `most`."""
    cited = items.select("source_id", "path").distinct().withColumn("cited", F.lit(True))
    flagged = found.join(cited, ["source_id", "path"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))
    return flagged.orderBy(F.col("cited").desc(), rank_of(F.col("severity")).desc(), "rule_id", "path", "line").limit(most)


def summary(found: DataFrame) -> DataFrame:
    """Counts by severity, by rule, and in all (both null; 0 where nothing was found)."""
    # Stored, as it is named twice: a row a severity and a rule instead of a second scan of all texts.
    by = kept(found.groupingSets([["severity"], ["rule_id"]], "severity", "rule_id").agg(F.count("*").alias("n")), "summary")
    none = F.lit(None).cast("string")
    total = by.where("severity is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return by.unionByName(total.select(none.alias("severity"), none.alias("rule_id"), "n"))


LOCK_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock")


def facts(docs: DataFrame) -> DataFrame:
    """kind, source_id, path, url and detail of what project files state."""
    base = docs.select("source_id", "path", "url", "text")
    name = F.substring_index("path", "/", -1)
    package = base.where(name == "package.json").withColumn("p", F.from_json("text", "name string, dependencies map<string,string>, devDependencies map<string,string>, engines map<string,string>, scripts map<string,string>"))
    package = package.where(F.try_parse_json("text").isNotNull() & F.col("p").isNotNull())
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("string")
    size = lambda c: F.when(F.col(c).isNull(), "0").otherwise(count(c))
    loose = F.filter(F.map_entries(F.map_concat(F.coalesce("p.dependencies", F.create_map().cast("map<string,string>")), F.map_filter(F.coalesce("p.devDependencies", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.coalesce(F.col("p.dependencies"), F.create_map().cast("map<string,string>")), k)))), lambda e: e["value"].rlike(r"^(\*|latest|>=?)"))
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "source_id", "path", "url", detail.alias("detail"))
    folder = F.regexp_replace("path", "package\\.json$", "")
    locks = base.where(name.isin(*LOCK_FILES)).select("source_id", F.regexp_replace("path", "[^/]*$", "").alias("folder"), F.lit(True).alias("locked")).distinct()
    locked = package.withColumn("folder", folder).join(locks, ["source_id", "folder"], "left")
    user = F.col("text").rlike(r"(?mi)^[^\S\r\n]*USER\s+(?!root)")
    out = [
        row(package, "deps", F.concat(F.lit("name="), F.coalesce("p.name", F.lit("?")), F.lit(" / dependencies="), size("p.dependencies"), F.lit(" / devDependencies="), size("p.devDependencies"), F.lit(" / engines="), F.coalesce(F.to_json("p.engines"), F.lit("null")))),
        row(package.withColumn("loose", loose).where(F.size("loose") > 0), "deps-risk", F.concat(F.lit("loose version ranges: "), F.array_join(F.transform("loose", lambda e: F.concat(e["key"], F.lit("@"), e["value"])), ", "))),
        row(locked, "lockfile", F.when(F.col("locked"), "lock file present").otherwise("no lock file in the index (excluded or not committed)")),
        row(package.where(F.col("p.scripts").isNotNull()), "scripts", F.concat(F.lit("scripts: "), F.array_join(F.map_keys("p.scripts"), ", "))),
        row(base.where(F.col("path").rlike(r"(^|/)\.env(\.|$)") & ~F.col("path").rlike(r"\.example|\.sample|\.template")), "secret-file", F.lit("an .env file is in the index")),
        row(base.where(F.col("path").rlike(r"(?i)(^|/)(Dockerfile|docker-compose\.ya?ml)$")), "container", F.when(user, "container definition with a USER").otherwise("container definition without a USER: runs as root")),
        row(base.where(F.col("path").rlike(r"(?i)(^|/)(\.github/workflows/.*\.ya?ml|\.gitlab-ci\.yml|Jenkinsfile)$")), "ci", F.lit("CI definition")),
    ]
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_.withColumn("detail", redact_udf("detail")["text"])


#: Routes by framework; a group more than the route is the method.
ENDPOINTS = [
    ("express", r"\b(?:app|router|api)\.(get|post|put|patch|delete|all)\s*\(\s*['\"`]([^'\"`]+)['\"`]"),
    ("nest/spring", r"@(Get|Post|Put|Patch|Delete)\s*\(\s*['\"`]?([^'\"`)]{0,200})['\"`]?\s*\)"),
    ("fastapi/flask", r"@(?:app|router)\.(get|post|put|patch|delete)\s*\(\s*[\"']([^\"']+)[\"']"),
    ("go", r"\b(?:r|router|mux)\.(?:HandleFunc|Handle)\s*\(\s*\"([^\"]+)\""),
    ("rails", r"^[^\S\r\n]*(get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]"),
]
_ENDPOINTS = [(name, re.compile(p.replace(r"\b", r"(?<![A-Za-z0-9_])"), re.M)) for name, p in ENDPOINTS]


def endpoints_of(source_id: str, source_type: str, path: str, url: str | None, text: str) -> Iterator[tuple]:
    """Routes of one code document, by framework, then by position; lines are looked up among the places of line ends."""
    ends = [m.start() for m in re.finditer("\n", text)]
    for framework, pattern in _ENDPOINTS:
        for m in pattern.finditer(text):
            n = bisect_left(ends, m.start())
            line = text[ends[n - 1] + 1 if n else 0 : ends[n] if n < len(ends) else len(text)]
            method, route = m.groups() if pattern.groups == 2 else ("any", m[1])
            link = f"{url}#L{n + 1}" if url and source_type == "github" else url
            yield method.upper(), redact(route)[0], framework, source_id, path, n + 1, link, (redact(line.strip()[:2000])[0] or "")[:200]


def endpoints(docs: DataFrame) -> DataFrame:
    """Endpoints (schemas.ENDPOINT) in documents of kind code; routes may span lines, so texts are read whole."""
    names = [f.split()[0] for f in ENDPOINT.split(", ")]
    kinds = [pa.int32() if n == "line" else pa.string() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for doc in zip(*(c.to_pylist() for c in batch.columns)) for e in endpoints_of(*doc)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    code = docs.where((F.col("kind") == "code") & F.col("text").isNotNull())
    return code.select("source_id", "source_type", "path", "url", "text").mapInArrow(run, ENDPOINT)


__all__ = ["ENDPOINT", "FINDING", "endpoints", "evidence_first", "facts", "findings", "ordered", "summary"]
