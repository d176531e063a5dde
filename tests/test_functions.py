"""Text, path, masking, HTML, schema, URL and glossary functions."""

from __future__ import annotations

import random
import re
import time
from collections import Counter

import pytest
from evisieve import config as cfg
from evisieve.functions import glossary, html, jsonschema, paths, redact, urls
from evisieve.functions import text as tx
from evisieve.operators import planning
from pyspark.sql import functions as F


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", expression.alias("x")).orderBy("i").select("x").collect()]


SAMPLES = ["", None, "HTTPServer parseURLFast my_var $x__y 検索語 3.14 a", "constructor __proto__ toString", "getUserName2 IOError XMLHttpRequest", "Ünïcode Straße été", "漢字カタカナ mixed漢 a1b2", "x" * 300, "the THE of", "MAX_RETRY_COUNT = 5"]


def test_tokens_column_equals_plain(spark):
    assert column(spark, SAMPLES, tx.tokens(F.col("v"))) == [tx.py_tokens(s) for s in SAMPLES]
    assert column(spark, SAMPLES, tx.tokens(F.col("v"), stop_words=True)) == [tx.py_tokens(s, True) for s in SAMPLES]


def test_identifier_parts():
    cases = {"parseHTTPResponse": ["parse", "http", "response"], "HTTPServer": ["http", "server"], "snake_case_name": ["snake", "case", "name"], "$scope": ["scope"], "ABC": ["abc"], "getX": ["get", "x"], "a1B2": ["a1", "b2"]}
    assert {k: tx.py_parts(k) for k in cases} == cases
    rng = random.Random(1)
    for _ in range(3000):  # the look-around form equals the two-group form
        word = "".join(rng.choice("ABab1_$") for _ in range(rng.randrange(1, 14)))
        spaced = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", re.sub("[_$]+", " ", word)))
        assert tx.py_parts(word) == spaced.lower().split()


def test_cjk_grams_interleave():
    assert tx.py_tokens("検索語") == ["検", "検索", "索", "索語", "語"]


def test_query_terms_count_and_drop_stop_words():
    assert tx.query_terms("the cache of the Cache") == {"cache": 2.0}


def test_token_estimates(spark):
    values = ["", None, "a" * 37, "漢" * 100, "mixed 漢字 text", "😀" * 10]
    want = [0, 0, 11, 106, 7, 7]
    assert column(spark, values, tx.token_estimate(F.col("v"))) == want == [tx.py_token_estimate(v) for v in values]
    cut = tx.truncated("word " * 500, 100)
    assert cut.endswith("…(truncated)") and tx.py_token_estimate(cut.removesuffix("\n…(truncated)")) <= 100
    assert tx.truncated("short", 100) == "short"


@pytest.mark.parametrize(("glob", "path", "hit"), [("**/*.py", "a/b/c.py", True), ("**/*.py", "c.py", True), ("*.py", "a/c.py", False), ("src/**", "src/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("*.{js,ts}", "x.ts", True), ("*.{js,ts}", "x.tsx", False), ("a.b", "axb", False), ("[x]", "[x]", True), ("{open", "{open", True), ("a", "a\n", False)])
def test_globs(spark, glob, path, hit):
    assert column(spark, [path], F.col("v").rlike(tx.glob_regex(glob))) == [hit]


def test_similarity_columns(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "c"], [0.1, 0.2], [0.1, 0.2])], "a array<string>, b array<string>, u array<float>, v array<float>")
    j, o, d = df.select(tx.jaccard(F.col("a"), F.col("b")), tx.overlap_ratio(F.col("a"), F.col("b")), tx.dot(F.col("u"), F.col("v"))).first()
    import numpy as np

    u = np.array([0.1, 0.2], dtype=np.float32).astype(np.float64)
    assert (j, o) == (1 / 3, 0.5) and abs(d - float(u @ u)) < 1e-15


def test_kinds_and_sensitive_paths(spark):
    kind, lang = paths.kind_and_lang(F.col("v"))
    names = ["a/b.py", "Dockerfile", "README.md", "x.yaml", "bin/tool", "x.PY"]
    assert column(spark, names, kind) == ["code", "config", "doc", "config", "other", "code"]
    assert column(spark, names, lang)[:2] == ["py", "dockerfile"]
    bad = [".env", "a/.ENV", "x/id_rsa.pub", "k.PEM", "deploy/Credentials.YML", ".ssh/config", "a\\.aws\\x", "secrets.yaml", "m.tfstate"]
    good = [".env.example", "docs/private_key.md", "src/credentials.js", "a/environment.ts", "secrets.md"]
    assert column(spark, bad + good, paths.is_sensitive(F.col("v"))) == [True] * len(bad) + [False] * len(good)
    assert column(spark, ["a/x.py", "b/x.py"], paths.is_included(F.col("v"), ("**/*.py",), ("b/**",))) == [True, False]
    assert paths.is_inside("/a/b", "/a/b/../b/c") and not paths.is_inside("/a/b", "/a/bc")


def test_binary_and_encoding(spark):
    values = [b"text", b"a\x00b", b"\xff\xfe", "﻿é".encode(), b"x" * 5000 + b"\x00"]
    assert column(spark, values, paths.is_binary(F.col("v")), "binary") == [False, True, False, False, False]
    assert column(spark, values[:4], paths.strict_text(F.col("v")), "binary") == ["text", "a\x00b", None, "é"]


# Masking

MASKED = ['password = "hunter22x"', "DB_PASSWORD=s3cretvalue", "  - API_KEY: abcdef123", 'curl -H "X-Api-Key: abcdef12345"', "postgres://user:pa55word@host/db", "Authorization: Bearer abcdefgh12345", "machine x login y password abcd1234", "AKIA" + "A1" * 8, "ghp_" + "a" * 24, "xoxb-" + "1" * 12, "eyJ" + "a" * 10 + "." + "b" * 10 + "." + "c" * 10, "AccountKey=" + "A" * 44 + "=="]
KEPT = ['password = "${DB_PASSWORD}"', "PASSWORD=process.env.PASSWORD", "password: string;", "TOKEN=changeme", "the password is long", "password_hash = abcdefghij", "const token = this.token", "secret: 秘密の説明です"]


@pytest.mark.parametrize("line", MASKED)
def test_credentials_are_masked(line):
    text, count, kinds = redact.redact(f"before\n{line}\nafter")
    assert count >= 1 and kinds and "«REDACTED:" in text and text.count("\n") == 2
    assert redact.redact(text)[0] == text


@pytest.mark.parametrize("line", KEPT)
def test_harmless_lines_stay(line):
    assert redact.redact(line) == (line, 0, [])


def test_private_keys_keep_line_numbers():
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    block = f"a\n{begin}\nAAAA\nBBBB\n{end}\nz"
    text, count, kinds = redact.redact(block)
    assert text.count("\n") == block.count("\n") and "AAAA" not in text and (count, kinds) == (1, ["PRIVATE_KEY"])
    whole = redact.mask_keys(block)
    assert whole.split("\n") == ["a", redact.KEY_MARK, "", "", "", "z"]
    inline = redact.redact(f'key = "{begin}\\nAAAA\\n{end}" + rest')[0]
    assert "AAAA" not in inline and inline.endswith('" + rest')
    assert "CCCC" not in redact.redact(f"CCCC{end} tail")[0]
    assert redact.mask_keys(f"x {begin} open\nmore") == f"x {redact.KEY_MARK}\n"


def test_masking_long_lines_takes_no_second():
    began = time.time()
    for text in ("a" * 200_000, "authorization:" + " " * 200_000, "-eyJ" * 50_000, "password" * 25_000, "export " * 28_000, "\r" * 200_000, redact.KEY_BEGIN[:11] + "PRIVATE KEY-----" * 7000, "x-api-key" * 20_000):
        redact.redact(text)
    assert time.time() - began < 8


def test_masking_columns(spark):
    values = [*MASKED, *KEPT, None]
    got = column(spark, values, redact.redact_udf("v")["text"])
    assert got == [redact.redact(v)[0] for v in values]
    assert "«REDACTED:AWS_ACCESS_KEY»" in column(spark, ["x AKIA" + "A" * 16], redact.redact_tokens(F.col("v")))[0]


def test_messages_lose_environment_values():
    assert redact.redact_message("x abcdefghijkl y", {"MY_TOKEN": "abcdefghijkl", "PATH": "x"}) == "x «REDACTED:MY_TOKEN» y"
    assert redact.redact_message("longsecret", secrets=("longsecret",)) == "«REDACTED»"


# HTML


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        (None, ""),
        ("<h2>T</h2><p>a</p>", "## T\n\na"),
        ("<ul><li>a<li>b</ul>", "- a\n- b"),
        ("<table><tr><th>x</th><td>y</td></tr></table>", "| x | y"),
        ("a&amp;lt;b&nbsp;c &#x41; &unknown; &#0;", "a&lt;b c A &unknown; &#0;"),
        ("<pre>  a &lt; b\n    c</pre>", "a < b\n    c"),
        ("<SCRIPT>x</SCRIPT>y<style>z</style>", "y"),
        ("<ri:user ri:account-id=\"u1\"/> <ac:link><ri:page ri:content-title=\"T\"/></ac:link>", "@u1 [[T]]"),
        ('<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[a  b]]></ac:plain-text-body></ac:structured-macro>', "```\na  b\n```"),
        ("<![CDATA[x]]> <br/> y", "x\n y"),
        ("<div>unclosed <b", "unclosed <b"),
    ],
)
def test_html(source, want):
    assert html.html_to_text(source) == want


def test_unclosed_html_takes_no_second():
    began = time.time()
    for text in ("<ac:link>" * 20_000, "<pre>" * 40_000, "<script>" * 30_000, "<![CDATA[" * 30_000, '<ac:structured-macro ac:name="code">' * 10_000, " \t" * 100_000, "<" * 200_000):
        html.html_to_text(text)
    assert time.time() - began < 8


def test_rich_text():
    node = {"type": "doc", "content": [{"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "T"}]}, {"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "mention", "attrs": {"text": "u"}}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "x"}]}]}]}, {"type": "codeBlock", "attrs": {"language": "py"}, "content": [{"type": "text", "text": "c"}]}]}
    assert html.rich_text(node) == "\n## T\na\n@u\n\n- x\n\n```py\nc\n```\n"


# JSON, URLs, glossary, plans, settings


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "string", "minLength": 2, "pattern": "^x"}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 3}, "l": {"type": "array", "minItems": 1, "items": {"enum": ["p", "q"]}}}}
    assert jsonschema.validate(schema, {"a": "xy", "n": None, "l": ["p"]}) == []
    bad = jsonschema.validate(schema, {"a": "y", "n": 9, "l": [], "z": 1})
    assert len(bad) == 5 and all(e.startswith("$.") for e in bad)
    assert jsonschema.validate(schema, []) and jsonschema.validate({"type": "integer"}, True) and not jsonschema.validate({"type": "integer"}, 2.0)


@pytest.mark.parametrize(("text", "want"), [('{"a":1}', {"a": 1}), ('x ```json\n{"a":2}\n``` y', {"a": 2}), ('say {"a": "}{", "b": {"c": 1}} end', {"a": "}{", "b": {"c": 1}}), ("none", None), ("", None), ("{bad} {\"a\":1}", None)])
def test_extract_json(text, want):
    assert jsonschema.extract_json(text) == want


def test_urls(spark):
    assert urls.code_host_url("https://github.com/o/r.git/blob/v1/a%20b/c.py") == {"host": "github.com", "repo": "o/r", "ref": "v1", "sub_path": "a b/c.py", "kind": "file", "number": None}
    assert urls.wiki_url("https://x.atlassian.net/wiki/spaces/ENG/pages/12/My+Page")["title"] == "My Page"
    assert urls.wiki_url("https://w/display/ENG/P?pageId=7")["page_id"] == "7"
    assert urls.tracker_url("https://x/browse/abc-12")["key"] == "ABC-12"
    assert urls.url_to_source("https://x.atlassian.net/wiki/x/AbC") is None and urls.url_to_source("nonsense") is None
    assert urls.url_to_source("https://git.corp/o/r")["api_base_url"] == "https://git.corp/api/v3"
    got = column(spark, ["http://h/p?q#f", "not a url"], F.struct(*[c.alias(n) for n, c in urls.url_parts(F.col("v")).items()]))
    assert tuple(got[0]) == ("h", "/p", "q", "f")


def test_glossary():
    assert len(glossary.PAIRS) == 96
    added = glossary.bridge_terms("返金の仕様")
    assert added["refund"] == 0.55 and "retry" not in added
    back = glossary.bridge_terms("refund flow")
    assert back["返金"] == 0.45 and back["遷移"] == 0.45  # two-character terms end at the weight of their gram
    assert glossary.weighted_terms("refund 返金")["refund"] == 1.0


def test_planner():
    kept, cut = planning.plan_queries("bug", 'Why does "login page" fail in src/auth/login.ts with getUserToken and user\'s retry_count?', 6)
    assert kept[0].startswith("Why") and "login page" in kept and "src/auth/login.ts" in kept and "getUserToken" in kept and len(kept) == 6
    assert not any(k.startswith("s retry") for k in kept) and isinstance(cut, list)
    assert planning.plan_queries("spec", "x")[0][0] == "x"
    assert planning.plan_queries("spec", 'a "b" c')[0][1] != "b"


def test_planned_column(spark):
    text = 'the "big cache" in src/a.py uses getX'
    assert column(spark, [text], planning.planned(F.col("v"))) == [[text, "big cache", "src/a.py", "getX"]]


def test_settings():
    assert cfg.load()["project"] == "untitled"
    assert cfg.load({"project": "${NAME}"}, {"NAME": "p"})["project"] == "p"
    for bad in ({"projct": 1}, {"budget": {"max_repairs": "2"}}, {"sources": [{"id": "a b", "type": "local"}]}, {"sources": [{"id": "a", "type": "local"}, {"id": "a", "type": "local"}]}, {"retrieval": {"chunk": {"doc": {"overlap_chars": 9999}}}}, {"sources": [{"id": "a", "type": "local", "token": "ghp_" + "a" * 30}]}, {"security": {"audit_log": 1}}):
        with pytest.raises(cfg.ConfigError):
            cfg.load(bad)
    with pytest.raises(cfg.ConfigError, match="perhaps project"):
        cfg.load({"projct": "x"})
    assert cfg.index_key(cfg.load()) != cfg.index_key(cfg.load({"sources": [{"id": "a", "type": "local"}]}))
    assert cfg.source_priority({"sources": [{"id": "a"}, {"id": "b", "priority": 0.2}]}) == {"a": 1.0, "b": 0.2}
    assert cfg.expand_template(r"{{a}} \{{a}}", {"a": "{{b}}"}) == "{{b}} {{a}}"
    assert cfg.parse_env("A=1\n# x\nexport B='q q'\nC=x # y\n") == {"A": "1", "B": "q q", "C": "x"}


def test_plain_path_functions_equal_columns(spark):
    from pyspark.sql import functions as F

    every = ["a/b.py", "Dockerfile", "x/.env", "x/.env.example", "k/id_rsa", "README", "a.tar.gz", ".ssh/config", "s.secrets.json", "src/App.TSX", "conf.yaml", "x\\.aws\\c", "nodot"]
    kind, lang = paths.kind_and_lang(F.col("p"))
    got = spark.createDataFrame([(p,) for p in every], "p string").select("p", kind.alias("k"), lang.alias("l"), paths.is_sensitive(F.col("p")).alias("s")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {p: (*paths.py_kind_and_lang(p), paths.py_is_sensitive(p)) for p in every}


def test_texts_reach_python_a_part_at_a_time(spark, tmp_path):
    """However many rows an Arrow batch has, Python objects are made of PART_BYTES or so; results are those of the whole."""
    import pyarrow as pa
    from evisieve.functions import batches, html, redact
    from pyspark.sql import functions as F

    texts = ["x" * 3_000_000, None, "", *["y" * 300_000] * 9, 'password = "hunter2xyz"']
    seen = []
    out = batches.by_parts(pa.array(texts), lambda part: (seen.append(sum(len(t or "") for t in part)), pa.array(part, pa.string()))[1], pa.string())
    assert out.to_pylist() == texts and max(seen[1:]) <= batches.PART_BYTES and len(seen) > 3
    assert batches.by_parts(pa.array([], pa.string()), lambda part: pa.array(part, pa.string()), pa.string()).to_pylist() == []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = rows.select("i", redact.redact_udf("t").alias("r"), redact.mask_keys_udf("t").alias("k"), html.html_to_text_udf("t").alias("h")).orderBy("i").collect()
    assert [(r["r"]["text"], r["r"]["count"], r["r"]["kinds"], r["k"], r["h"]) for r in got] == [(*redact.redact(t), redact.mask_keys(t), html.html_to_text(t)) for t in texts]


def test_counts_of_terms_equal_tokens(spark, monkeypatch):
    monkeypatch.setattr(tx, "_PART", 7)  # texts are cut between words, many times
    texts = ["Plain words, the Words 42 4.2 7 1.2.3 é K İx Klm ABC Abc a1", "fooBar HTTPServer x_y $a _ aB 3a", "返金のリトライ abc", "", None, "word " * 50, "ABCd eF9G 9.Ab a.B", "x" * 40 + "_Y " + "ßİSTRASSE"]
    rows = [(i, t) for i, t in enumerate(texts)]
    want = {r["i"]: Counter(r["t"]) for r in spark.createDataFrame(rows, "i int, text string").select("i", tx.tokens(F.col("text")).alias("t")).collect()}
    for i, text in rows:
        counts: dict[str, int] = {}
        assert tx.count_terms(counts, text) == sum(want[i].values()) == sum(counts.values()) and counts == want[i], text
        assert tx.count_terms(counts, text, 3) == sum(want[i].values()) and counts == {t: 4 * n for t, n in want[i].items()}
        assert Counter(tx.py_tokens(text)) == want[i]
