"""Presets, embeddings, clones and the command line."""

from __future__ import annotations

import io
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from evisieve import cli, engine, server
from evisieve import config as cfg
from evisieve.operators import embedding, presets
from evisieve.sources import clone, remote, services

GOOD = {"name": "login-review", "task": "security", "instruction": "Review {{area}} {{more}}", "arguments": [{"name": "area"}, {"name": "more", "required": False}]}


def test_presets():
    good, bad = presets.load([GOOD, {**GOOD, "name": "twice"}, {**GOOD, "name": "twice"}, {**GOOD, "name": "Bad Name"}, {**GOOD, "name": "x", "instruction": "{{other}}"}, {**GOOD, "name": "y", "sources": ["none"]}], {"s"})
    assert list(good) == ["login-review"] and set(bad) == {"twice", "Bad Name", "x", "y"}
    assert good["login-review"].expand({"area": "{{more}}"}) == "Review {{more}} "
    for values in ({}, {"area": "a", "z": "b"}):
        with pytest.raises(cfg.ConfigError):
            good["login-review"].expand(values)


def test_embeddings(spark):
    chunks = spark.createDataFrame([("a", "h1", "x"), ("b", "h1", "x"), ("c", "h2", 'password = "hunter22x"'), ("d", "h3", "z")], "key string, hash string, text string")
    cache = spark.createDataFrame([("h3", [0.0, 1.0])], "hash string, embedding array<float>")

    def embed(texts):
        assert not any("hunter" in t for t in texts)
        return [[3.0, 4.0]] * len(texts)

    got = {r["key"]: [round(x, 3) for x in r["embedding"]] for r in embedding.embed_chunks(chunks, embed, 2, True, cache).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.6, 0.8], "c": [0.6, 0.8], "d": [0.0, 1.0]}
    with pytest.raises(PermissionError):
        embedding.embed_chunks(chunks, embed, 2, False)
    with pytest.raises(ValueError):
        embedding.normalised([[1.0]], 2)
    assert embedding.cache_key("p", "m", 2, "h") != embedding.cache_key("p", "m", 3, "h")


def test_clones_are_guarded(tmp_path):
    with pytest.raises(remote.EgressDenied):
        clone.git(None, "push")
    with pytest.raises(remote.EgressDenied):
        clone.clone({"id": "r", "repo": "o/r"}, str(tmp_path), ())
    for bad in ({"repo": "o/r", "ref": "--upload-pack=x"}, {"repo": "../r"}, {"repo": "o/r", "ref": "a..b"}):
        with pytest.raises(ValueError):
            clone.clone({"id": "r", **bad}, str(tmp_path), ("github.com",))
    with pytest.raises(remote.EgressDenied):
        clone.refuse_rewrites("url.http://evil/.insteadof=https://github.com/")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def refund():\n    print('x')\n")
    assert cli.main(["init"]) == 0 and cli.main(["doctor"]) == 1
    (tmp_path / "evisieve.json").write_text(json.dumps({"sources": [{"id": "s", "type": "local", "path": str(tmp_path / "src")}], "presets": [GOOD]}))
    for command in (["doctor"], ["privacy"], ["tasks"], ["presets"], ["resolve", "https://github.com/o/r"], ["sync"], ["build"], ["status"]):
        assert cli.main(command) == 0
    capsys.readouterr()
    assert cli.main(["search", "refund"]) == 0 and json.loads(capsys.readouterr().out)[0]["path"] == "a.py"
    assert cli.main(["scan"]) == 0 and json.loads(capsys.readouterr().out)[0]["rule_id"] == "REL-DEBUG-LEFTOVER"
    assert cli.main(["pack", "refund", "--effort", "low"]) == 0
    saved = json.loads(capsys.readouterr().out)["pack"]
    answer = tmp_path / "answer.json"
    answer.write_text(json.dumps({"summary": "s", "items": [], "open_questions": []}))
    assert cli.main(["verify", str(answer), f"{tmp_path}/.evisieve/packs/{saved}.json"]) == 0
    assert cli.main(["run", "refund"]) == 0 and "refund" in capsys.readouterr().out
    (tmp_path / "evisieve.json").write_text('{"projct": 1}')
    assert cli.main(["status"]) == 2


# Services


def test_embedding_requests_and_answers():
    own = {"provider": "voyage", "model": "m", "dimensions": 2}
    url, body = services.embedding_request(own, ["a"], "query")
    assert url == services.EMBEDDING_URLS["voyage"] and body == {"model": "m", "input": ["a"], "input_type": "query", "output_dimension": 2}
    url, body = services.embedding_request(own | {"provider": "openai", "base_url": "https://h/v1/"}, ["a"])
    assert url == "https://h/v1/embeddings" and body["dimensions"] == 2 and "input_type" not in body
    assert services.embedding_vectors({"data": [{"index": 1, "embedding": [3, 4]}, {"index": 0, "embedding": [1, 2]}]}, 2, 2) == [[1, 2], [3, 4]]
    for bad, n in (({}, 1), ({"data": []}, 1), ({"data": [{"embedding": [1]}]}, 1)):
        with pytest.raises(remote.RemoteError):
            services.embedding_vectors(bad, n, 2)
    with pytest.raises(remote.EgressDenied):
        services.embedder(own, ())(["a"])
    with pytest.raises(remote.EgressDenied):
        services.embedder(own, ("api.voyageai.com",), offline=True)(["a"])


def test_model_requests_and_answers(monkeypatch):
    schema = {"type": "object"}
    for provider, answer in (
        ("anthropic", {"content": [{"type": "text", "text": "t"}, {"type": "tool_use", "input": {"a": 1}}], "usage": {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 1}, "stop_reason": "max_tokens"}),
        ("openai", {"choices": [{"message": {"content": '{"a": 1}'}, "finish_reason": "length"}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": 1}}}),
    ):
        reply = services.model_reply(provider, answer)
        assert (reply.json, reply.usage, reply.cut) == ({"a": 1}, services.Usage(5, 2, 1, 0), True)
        url, _, body = services.model_request({"provider": provider, "model": "m"}, "system", "user", schema)
        assert url == services.MODEL_URLS[provider] and "user" in json.dumps(body["messages"]) and ("tools" in body) == (provider == "anthropic")
    sent = []

    def gate(self, url, params=None, body=None):
        sent.append(body.get("response_format", {}).get("type"))
        if sent[-1] == "json_schema":
            raise remote.RemoteError("HTTP 400 from h")
        return {"choices": [{"message": {"content": "{}"}}]}

    monkeypatch.setattr(remote.Gate, "__call__", gate)
    ask = services.model({"provider": "compatible", "model": "m", "base_url": "https://h/v1"}, ("h",))
    with pytest.raises(cfg.ConfigError):
        ask("s", "u", schema)
    monkeypatch.setenv("LLM_API_KEY", "k")
    assert ask("s", "u", schema).text == "{}" and sent == ["json_schema", "json_object"]
    assert services.Usage(1, 2) + services.Usage(3, 4, 5) == services.Usage(4, 6, 5, 0)


def test_hybrid_search_presets_and_runs(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name, text in (("cat.md", "cats purr"), ("dog.md", "dogs bark"), ("car.md", "engines roar")):
        (src / name).write_text(text)
    asked = []

    def embed(texts, purpose="document"):
        if purpose == "query":
            asked.append(texts)
        return [[float("cat" in t or "feline" in t), float("dog" in t), 1.0] for t in texts]

    settings = {"sources": [{"id": "s", "type": "local", "path": str(src)}], "security": {"allow_embedding_upload": True}, "retrieval": {"embedding": {"provider": "none", "dimensions": 3}}, "presets": [GOOD | {"sources": ["s"]}]}
    e = engine.Engine(spark, str(tmp_path / "ws"), settings, embed=embed)
    e.sync()
    assert [r["path"] for r in e.listing().collect()] == ["car.md", "cat.md", "dog.md"]
    e.build_index()
    e.build_index()  # vectors come from the workspace
    assert spark.read.parquet(f"{tmp_path}/ws/embeddings/buckets-64").count() == 3
    assert e.search("feline")[0]["path"] == "cat.md" and asked == [["feline"]]
    plain = engine.Engine(spark, str(tmp_path / "ws"), settings | {"security": {"allow_embedding_upload": False}}, embed=embed)
    assert plain.search("feline") == [] and len(asked) == 1
    replies = iter([services.Reply("no json", services.Usage(1, 1)), services.Reply('{"summary": "s", "items": [], "open_questions": []}', services.Usage(2, 1))])
    done = e.run_preset("login-review", {"area": "cats"}, model=lambda system, user: next(replies), save=True)
    assert done["verdict"].ok and done["usage"] == services.Usage(3, 2) and done["repairs"] == 1 and len(done["saved"]) == 6
    cut = e.run_task("bug", "cats", model=lambda system, user: services.Reply("{", cut=True))
    assert cut["cut"] and cut["repairs"] == 0 and not cut["verdict"].ok
    name = e.save_pack(cut["pack"])
    assert e.load_pack(name).items[0]["id"] == "E1"
    with pytest.raises(cfg.ConfigError):
        e.run_preset("none")


def test_clone_sources_reach_the_cache(spark, tmp_path, monkeypatch):
    def made(source, folder, hosts):
        target = Path(folder) / source["id"]
        target.mkdir(parents=True)
        (target / "a.py").write_text("print(1)")
        (target / "yarn.lock").write_text("x")
        return target, "abc"

    monkeypatch.setattr(clone, "clone", made)
    e = engine.Engine(spark, str(tmp_path / "ws"), {"sources": [{"id": "r", "type": "github", "repo": "o/r", "mode": "clone"}], "security": {"allow_hosts": ["github.com"]}})
    assert e.sync()["r"]["ok"] and [r["path"] for r in e.docs().collect()] == ["a.py"]
    e.offline = True
    assert not e.sync()["r"]["ok"]


def test_server(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def refund():\n    token = 'abcdefghijklmn'\n    eval(x)\n")
    settings = {"sources": [{"id": "s", "type": "local", "path": str(src)}], "presets": [GOOD | {"sources": ["s"], "description": "d"}]}
    own = server.Server(engine.Engine(spark, str(tmp_path / "ws"), settings))
    ask = lambda method, **params: own.handle({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})

    def call(name, **arguments):
        result = ask("tools/call", name=name, arguments=arguments)["result"]
        text = result["content"][0]["text"]
        return text if result["isError"] or name == "run_task" else json.loads(text)

    assert ask("initialize", protocolVersion="2025-03-26")["result"]["protocolVersion"] == "2025-03-26"
    assert ask("initialize", protocolVersion=7)["result"]["protocolVersion"] == server.VERSIONS[0]
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == set(server.TOOLS) and ask("ping")["result"] == {}
    assert not call("status")["indexed"] and call("sync")["generation"] == 1 and call("status")["indexed"]
    hit = call("search", query="refund", k=3)[0]
    assert hit["path"] == "a.py" and "abcdefghijklmn" not in hit["text"]
    pack = call("evidence_pack", instruction="refund", task="security")
    assert pack["labels"]["E1"].startswith("s/a.py") and pack["static"]["findings"][0]["rule_id"].startswith("SEC-")
    assert call("fetch", pack_id=pack["pack_id"], evidence_id="E1")["path"] == "a.py"
    assert call("fetch", path="a.py", start=2, end=2)["lines"] == "2-2" and "3" in call("fetch", path="a.py", start=9)
    assert "evidence_id" in call("fetch", pack_id="pack-1") and "no path" in call("fetch", path="b")
    assert call("verify", pack_id=pack["pack_id"], result={"summary": "s", "items": [], "open_questions": []})["passed"]
    deep = value = {}
    for _ in range(80):
        value["a"] = value = {}
    assert "deep" in call("verify", pack_id=pack["pack_id"], result=deep)
    assert {f["rule_id"] for f in call("static_scan", severity="high")["findings"]} >= {"SEC-SECRET-GENERIC"}
    assert "refund" in call("run_task", instruction="refund", dry_run=True)
    for bad in ({"query": " "}, {"query": "x", "k": 101}, {"query": "x", "z": 1}, {}):
        assert ask("tools/call", name="search", arguments=bad)["error"]["code"] == server.BAD_ARGUMENTS
    assert ask("prompts/list")["result"]["prompts"][0]["name"] == "login-review"
    assert "Review cats" in ask("prompts/get", name="login-review", arguments={"area": "cats"})["result"]["messages"][0]["content"]["text"]
    for method, params, code in (("prompts/get", {"name": "x"}, server.BAD_ARGUMENTS), ("prompts/get", {"name": "login-review"}, server.BAD_ARGUMENTS), ("nope", {}, server.NO_METHOD)):
        assert ask(method, **params)["error"]["code"] == code
    assert own.handle({"method": "notifications/initialized"}) is None and own.handle([1])["error"]["code"] == server.BAD_REQUEST
    out = io.StringIO()
    server.serve(own, io.StringIO('{"jsonrpc": "2.0", "id": 5, "method": "ping"}\n\nnot json\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [5, None]


def test_vector_cache_is_not_shuffled(spark, tmp_path):
    from evisieve.operators import embedding

    path = f"file://{tmp_path}/v"
    rows = lambda a, b: spark.range(a, b).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.array(F.col("id").cast("float")).alias("embedding"))
    cache = embedding.VectorCache(spark, path, 8)
    cache.append(rows(0, 300).unionByName(rows(100, 200)))
    cache.append(rows(250, 400))
    assert cache.read().count() == 400 and embedding.VectorCache(spark, path, 8).read().select("hash").distinct().count() == 400
    chunks = spark.range(350, 450).select(F.col("id").cast("string").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("hash"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = embedding.embed_chunks(chunks, lambda texts: [[float(t)] for t in texts], 1, True, cache.read())
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = [i for i, line in enumerate(plan.split("\n")) if "FileScan" in line]
    lines = plan.split("\n")
    above = lambda i: next(line for line in reversed(lines[:i]) if "Exchange" in line or "Join" in line or "Aggregate" in line)
    assert scans and not any("Exchange" in above(i) for i in scans), plan
    assert made.count() == 100
