"""The engine: sync sources, build the index, search, scan, pack evidence, verify answers and report."""

from __future__ import annotations

import inspect
import json
import logging
import uuid
from datetime import UTC, datetime
from hashlib import sha256
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as cfg
from .functions.jsonschema import extract_json
from .functions.redact import redact
from .functions.text import py_token_estimate
from .operators import chunking, embedding, gate, hybrid, index, packing, planning, presets, ranking, reading, report, scanning, segments
from .operators.files import Folder
from .operators.tables import kept
from .sources import cache, clone, egress, remote, services, sync, tables

log = logging.getLogger("evisieve")
SYSTEM = "Answer from the evidence alone. Cite evidence ids; quote verbatim. What the evidence doesn't show is an open question. Reply with JSON that follows the schema."


class Engine:
    """One workspace: a folder on any Hadoop file system with the document cache, the index, packs and runs.

    embed: texts and a purpose (document or query) to vectors; without it the embedding service of the settings, if
    one is set. Clones need a workspace that driver and executors mount.
    """

    def __init__(self, spark: SparkSession, workspace: str, settings: dict | None = None, tables_: dict[str, DataFrame] | None = None, embed: embedding.Embed | None = None):
        self.spark, self.workspace = spark, workspace.rstrip("/")
        self.config = cfg.load(settings)
        self.tables = tables_ or {}
        self.incremental = self.config["retrieval"]["incremental"]
        self.store = segments.SegmentStore(spark, f"{self.workspace}/segments") if self.incremental else index.IndexStore(spark, f"{self.workspace}/index")
        self.key = cfg.index_key(self.config)
        self._open: index.Snapshot | segments.SegmentSnapshot | None = None
        security, own = self.config["security"], self.config["retrieval"]["embedding"]
        self.offline, self.hosts = security["network_mode"] == "offline", tuple(security["allow_hosts"])
        self.embed = embed or (services.embedder(own, self.hosts, self.offline) if own["provider"] != "none" else None)

    # Ingestion

    def source_ids(self, ids: list[str] | None = None) -> list[str]:
        known = [s["id"] for s in self.config["sources"]]
        if unknown := [i for i in ids or () if i not in known]:
            raise cfg.ConfigError(f"no such source: {', '.join(unknown)}")
        return known if not ids else list(dict.fromkeys(ids))

    def sync(self, ids: list[str] | None = None, headers: dict[str, dict[str, str]] | None = None) -> dict[str, dict]:
        """Reads sources into the cache, one by one; one that fails leaves the others and its own cache alone.

        Of remote sources only what changed is fetched. What a source no longer has leaves the cache.
        """
        security, state, path = self.config["security"], {}, f"{self.workspace}/docs"
        wanted = self.source_ids(ids)
        for s in self.config["sources"]:
            if s["id"] not in wanted:
                continue
            try:
                told: dict[str, Any] = {"skipped": {}}
                if s["type"] == "local":
                    docs, left_out = tables.file_docs(self.spark, s["path"], s["id"], tuple(s.get("include", ())), tuple(s.get("exclude", ())), security["deny_sensitive_paths"], tuple(security["extra_deny_paths"]))
                    told["skipped"] = {r[0]: r[1] for r in left_out.collect()}
                elif s["type"] == "table":
                    docs = self.tables[s["table"]].withColumn("source_id", F.lit(s["id"])).withColumn("doc_id", F.concat_ws(":", "source_id", "path"))
                elif s["type"] == "github" and s.get("mode") == "clone":
                    if self.offline:
                        raise remote.EgressDenied("offline: nothing is cloned")
                    docs, left_out = clone.cloned_docs(self.spark, s, str(self._local("clones")), self.hosts)
                    told["skipped"] = {r[0]: r[1] for r in left_out.collect()}
                    if discussed := [p for p in ("issues", "pulls") if (s.get(p) or {}).get("enabled")]:
                        log.info("source %s: %s by the API", s["id"], " and ".join(discussed))
                        more = sync.refreshed(self.spark, s, sync.gate_of(self.hosts, (headers or {}).get(s["id"]), self.offline), cache.read_cache(self.spark, path, [s["id"]]).where("kind in ('issue', 'pr')"))
                        docs = docs.unionByName(more.docs)
                        self._note(s["id"], more.requests)
                        told |= {**more.counts, "failures": more.failed}
                else:
                    gate = sync.gate_of(self.hosts, (headers or {}).get(s["id"]), self.offline)
                    out = sync.refreshed(self.spark, s, gate, cache.read_cache(self.spark, path, [s["id"]]))
                    self._note(s["id"], out.requests)
                    docs, told = out.docs, told | {**out.counts, "failures": out.failed}
                    for reason, n in out.failed.items():
                        log.warning("source %s: %d not fetched: %s", s["id"], n, reason)
                cache.replace_source(docs.select(*[f.split()[0] for f in cache.DOC.split(", ")]), path, s["id"])
                state[s["id"]] = {"ok": True, **told}
                if told["skipped"]:
                    log.info("source %s left out: %s", s["id"], report.skipped_text(told["skipped"]))
            except Exception as e:  # a source's failure is reported, not raised: the others go on
                log.warning("source %s failed: %s", s["id"], redact(str(e))[0].split("\n")[0])
                state[s["id"]] = {"ok": False, "error": redact(str(e))[0].split("\n")[0]}
        return state

    def _note(self, source: str, requests: list[DataFrame]) -> None:
        """Adds the requests of a sync to the workspace's log (security.audit_log)."""
        if self.config["security"]["audit_log"]:
            for rows in requests:
                rows.withColumn("source_id", F.lit(source)).coalesce(1).write.mode("append").json(f"{self.workspace}/egress")

    def egress(self, *by: str) -> DataFrame:
        """Requests by host, and by source_id if asked for, over all syncs that were logged."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.workspace}/egress")
        there = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)
        schema = f"{egress.REQUEST}, source_id string"
        return egress.summarised(self.spark.read.schema(schema).json(root.toString()) if there else self.spark.createDataFrame([], schema), *by)

    def _local(self, name: str) -> Path:
        if "://" in self.workspace and not self.workspace.startswith("file:"):
            raise cfg.ConfigError("clones need a workspace that is mounted (file:)")
        folder = Path("/" + self.workspace.removeprefix("file:").lstrip("/")) / name
        folder.mkdir(parents=True, exist_ok=True)
        return folder

    def listing(self, ids: list[str] | None = None) -> DataFrame:
        """Cached documents without their texts, by source and path."""
        return self.docs(ids).drop("text").orderBy("source_id", "path")

    def docs(self, ids: list[str] | None = None) -> DataFrame:
        return cache.read_cache(self.spark, f"{self.workspace}/docs", self.source_ids(ids))

    def build_index(self, vectors: DataFrame | None = None) -> int:
        """Chunks all cached documents and publishes a generation; with retrieval.incremental only what changed since the last one."""
        if self.incremental:
            return self._update_index(vectors)
        chunks = self._chunked(self.docs())
        if vectors is None and self.embed is not None:
            chunks = kept(chunks, "chunks")
            vectors = self.vectors(chunks)
        return self.store.build(chunks, self.key, self.config["project"], vectors)

    def _chunked(self, docs: DataFrame) -> DataFrame:
        c = self.config["retrieval"]["chunk"]
        limits = chunking.Limits(c["code"]["max_lines"], c["code"]["overlap_lines"], c["code"]["max_chars"], c["doc"]["max_chars"], c["doc"]["overlap_chars"])
        return chunking.chunk_documents(docs, limits).withColumn("key", F.concat_ws("#", "doc_id", F.lpad("chunk_no", 6, "0")))

    def _update_index(self, vectors: DataFrame | None) -> int:
        """Other settings make every document a changed one; so do documents without chunks, which nothing remembers."""
        known, docs = self.store.documents(), self.docs()
        if self.store.newest().get("index_key", self.key) != self.key:
            known = known.withColumn("hash", F.lit(None).cast("string"))
        # A document's title and path are part of its postings, so they are part of what tells whether it changed.
        docs = docs.withColumn("hash", F.sha2(F.concat_ws("|", "hash", "title", "path", "kind", "url", "version"), 256))
        changed, gone = segments.changes(docs, known)
        changed = kept(changed, "changed")
        chunks = kept(self._chunked(changed).join(changed.select("doc_id", F.col("hash").alias("doc_hash")), "doc_id"), "chunks")
        if vectors is None and self.embed is not None:
            vectors = self.vectors(chunks)
        replaced = gone.unionByName(changed.select("doc_id"))  # also those that have no chunks any more
        return self.store.update(chunks, replaced, self.key, self.config["project"], vectors)

    def vectors(self, chunks: DataFrame) -> DataFrame:
        """Vectors of chunks, those of earlier builds from the workspace; new ones are kept there.

        A vector is known by its provider, model, dimensions and text.
        """
        own, cache_ = self.config["retrieval"]["embedding"], embedding.VectorCache(self.spark, f"{self.workspace}/embeddings")
        named = F.sha2(F.concat(F.lit(f"{own['provider']}|{own['model']}|{own['dimensions']}|"), F.col("hash")), 256)
        wanted = chunks.select("key", named.alias("hash"), "text")
        made = kept(embedding.embed_chunks(wanted, self.embed, own["dimensions"], self.config["security"]["allow_embedding_upload"], cache_.read()), "vectors")
        cache_.append(made)
        return made.select("key", "embedding")

    def snapshot(self) -> index.Snapshot:
        """The newest generation, opened once and held by a lease: what runs keeps the one it began with when a newer one appears.

        The lease of the one before isn't given back at once, as its frames may still be read: it runs out.
        """
        if self._open is None or self.store.generations()[-1:] != [self._open.number]:
            self._open = self.store.open(index.LEASE_SECONDS)
        self._open.lease.keep()
        return self._open

    def status(self) -> dict[str, Any]:
        now = self.snapshot()
        return now.manifest | {"generation": now.number, "stale": now.is_stale(self.key), "sources": [r.asDict(True) for r in index.source_stats(now.chunks).collect()]}

    # Retrieval

    def search(self, queries: str | list[str], k: int | None = None, sources: list[str] | None = None, kinds: list[str] | None = None, kind_priors: dict[str, float] | None = None, source_priority: dict[str, float] | None = None) -> list[dict]:
        """The best chunks for one information need, put as one or several query texts."""
        now = self.snapshot()
        if now.is_stale(self.key):
            log.warning("settings changed since the index was built; build it again")
        r = self.config["retrieval"]
        queries = [queries] if isinstance(queries, str) else queries
        chunks = now.chunks.where(F.col("source_id").isin(*self.source_ids(sources)))
        if kinds:
            chunks = chunks.where(F.col("kind").isin(*kinds))
        needs = self.spark.createDataFrame([("all", str(i), q) for i, q in enumerate(queries)], "need_id string, list_no string, text string")
        found = self._found(now, needs, chunks, self._query_vectors({str(i): q for i, q in enumerate(queries)}) if now.vectors is not None else [], k, kind_priors, source_priority)
        return [row.asDict(True) for row in found.drop("need_id").join(chunks, "key").orderBy("rank").collect()]  # k rows

    def _found(self, now: Any, needs: DataFrame, chunks: DataFrame, vectors: list[tuple[str, list[float]]], k: int | None, kind_priors: dict[str, float] | None, source_priority: dict[str, float] | None) -> DataFrame:
        r = self.config["retrieval"]
        asked = self.spark.createDataFrame([("all", i, v) for i, v in vectors], "need_id string, list_no string, embedding array<float>") if vectors else None
        return hybrid.hybrid(now, needs, k or r["hybrid"]["final"], r["hybrid"]["per_query_top"], r["hybrid"]["mmr_lambda"], r["glossary_bridge"], chunks, asked, kind_priors, source_priority)

    def search_all(self, needs: DataFrame, k: int | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """The best chunks for each of many needs (need_id, list_no, text), as rows of need_id, rank, score and the chunk's columns.

        vectors: need_id, list_no and embedding of queries, if the index has vectors.
        """
        now, r = self.snapshot(), self.config["retrieval"]
        found = hybrid.hybrid(now, needs, k or r["hybrid"]["final"], r["hybrid"]["per_query_top"], r["hybrid"]["mmr_lambda"], r["glossary_bridge"], None, vectors)
        return found.join(now.chunks, "key")

    def _query_vectors(self, queries: dict[str, str]) -> list[tuple[str, list[float]]]:
        """Vectors of query texts. Without consent, or if the service fails, words alone decide, and that is said once."""
        if self.embed is None:
            return []
        if not self.config["security"]["allow_embedding_upload"]:
            log.warning("queries aren't sent to the embedding service (security.allow_embedding_upload is off): words alone decide")
            return []
        try:
            texts = [(redact(q)[0] or "")[: services.QUERY_MOST] for q in queries.values()]
            found = embedding.normalised(self.embed(texts, "query"), self.config["retrieval"]["embedding"]["dimensions"])
        except Exception as e:  # ranking goes on without
            log.warning("no query vectors, words alone decide: %s", redact(str(e))[0].split("\n")[0])
            return []
        return list(zip(queries, found.tolist()))

    def evidence_pack(self, task: str, instruction: str, effort: str = "normal", sources: list[str] | None = None) -> packing.Pack:
        """Plans queries, searches and packs."""
        e = planning.EFFORTS[effort]
        queries, cut = planning.plan_queries(task, instruction, e.queries)
        if cut:
            log.info("left out of the plan: %s", ", ".join(cut))
        hits = self.search(queries, e.final, sources, kind_priors=planning.TASKS[task].kind_priors, source_priority=cfg.source_priority(self.config))
        return packing.build_pack(hits, e.evidence_tokens, masked=self.config["security"]["redact_secrets"])

    def save_pack(self, pack: packing.Pack, keep: int = 200, task: str | None = None) -> str:
        """Keeps a pack, and the task it is for, under a random id; of older packs the newest `keep`."""
        folder, name = Folder(self.spark, f"{self.workspace}/packs"), f"pack-{uuid.uuid4().hex[:10]}"
        folder.write(f"{name}.json", json.dumps({"items": pack.items, "tokens": pack.tokens, "task": task or pack.task}, ensure_ascii=False, default=str))
        folder.prune(keep, ".json")
        return name

    def load_pack(self, name: str) -> packing.Pack:
        if not name.startswith("pack-") or not name[5:].isalnum():
            raise KeyError(name)
        saved = json.loads(Folder(self.spark, f"{self.workspace}/packs").read(f"{name}.json"))
        return packing.Pack(saved["items"], saved["tokens"], task=saved.get("task"))

    def fetch(self, doc_id: str, start: int = 1, end: int | None = None, most: int = 201) -> list[str]:
        """Lines of a cached document, `most` at most, keys and credentials masked."""
        found = self.docs().where(F.col("doc_id") == doc_id)
        return self._shown(found, start, end, most, doc_id)["text"].split("\n")

    @staticmethod
    def _shown(found: DataFrame, start: int, end: int | None, most: int, name: str) -> Any:
        """The first of the documents, cut to its lines."""
        row = reading.line_window(found.orderBy("source_id").limit(1), start, end, most).first()
        if row is None:
            raise KeyError(name)
        if row["text"] is None:
            raise ValueError(f"no lines {start} to {end or start + most - 1} in {row['total_lines']}")
        return row

    def window(self, path: str, source: str | None = None, start: int = 1, end: int | None = None, most: int = 201) -> dict[str, Any]:
        """Lines of a document by its path, with what to cite."""
        row = self._shown(self.docs([source] if source else None).where(F.col("path") == path), start, end, most, f"no path {path}")
        return {"source_id": row["source_id"], "path": path, "url": row["url"], "version": row["version"], "lines": f"{start}-{start + row['shown'] - 1}", "total_lines": row["total_lines"], "text": row["text"]}

    # Analysis and answers

    def scan(self, ids: list[str] | None = None, least: str = "info") -> dict[str, DataFrame]:
        docs = self.docs(ids)
        found = scanning.findings(docs, least)
        return {"findings": scanning.ordered(found), "summary": scanning.summary(found), "facts": scanning.facts(docs), "endpoints": scanning.endpoints(docs)}

    def verify(self, answer: Any, pack: packing.Pack, task: str | None = None) -> gate.Verdict:
        answer = extract_json(answer) if isinstance(answer, str) else answer
        p = self.config["policy"]
        policy = gate.Policy(p["require_citations"], p["min_evidence"], p["verbatim_quotes"], p["drop_unverified"], p["forbid_speculation"])
        return gate.verify(answer, pack.items, planning.answer_schema(task) if task else None, policy)

    def run_task(self, task: str, instruction: str, effort: str = "normal", model: Any = None, sources: list[str] | None = None, save: bool = False) -> dict[str, Any]:
        """Evidence, static facts and prompt; with a model also its verified answer, report and usage.

        model: system text and prompt (and a schema, if it takes one) to a text or a services.Reply. Without one it is
        a dry run, and nothing leaves the engine. Arguments are checked before anything is read. save: the artefacts
        go to a folder of the workspace.
        """
        spec, _ = planning.TASKS[task], planning.EFFORTS[effort]
        self.source_ids(sources)
        began = datetime.now(UTC)
        pack = self.evidence_pack(task, instruction, effort, sources)
        scans = self.scan(sources)
        cited = self.spark.createDataFrame([(i["source_id"], i["path"]) for i in pack.items], "source_id string, path string")
        rows = lambda df, most: [r.asDict(True) for r in df.limit(most).collect()]
        findings = rows(scanning.evidence_first(scans["findings"], cited), 120) if "findings" in spec.needs else []
        facts = rows(scans["facts"], 60) if "facts" in spec.needs else []
        endpoints = rows(scans["endpoints"], 120) if "endpoints" in spec.needs else []
        static = report.static_facts(findings, facts, endpoints, self.config["budget"]["static_facts_tokens"])
        schema = planning.answer_schema(task)
        user = "\n\n".join([spec.instruction, f"# Instruction\n{instruction}", f"# Evidence\n{packing.evidence_block(pack.items)}", static, "# Schema\n" + json.dumps(schema)])
        out: dict[str, Any] = {"pack": pack, "bundle": report.bundle(SYSTEM, user), "tokens": py_token_estimate(SYSTEM + user)}
        if model is not None:
            if not self.config["security"]["allow_llm_upload"]:
                raise PermissionError("security.allow_llm_upload is off")
            if out["tokens"] > self.config["budget"]["max_total_tokens"]:
                raise ValueError("the prompt is over budget.max_total_tokens")
            out |= self._answered(model, user, schema, pack, task)
            out["report"] = report.markdown(out["verdict"].cleaned, pack.items, spec.label)
        out["meta"] = {"task": task, "effort": effort, "prompt_sha256": sha256(out["bundle"].encode()).hexdigest(), "began": began.isoformat(), "ended": datetime.now(UTC).isoformat(), "masked": pack.masked, "masked_kinds": pack.masked_kinds, **{k: out[k] for k in ("usage", "repairs", "cut") if k in out}}
        if save:
            out["saved"] = self._saved(task, began, out)
        return out

    def _answered(self, model: Any, user: str, schema: dict, pack: packing.Pack, task: str) -> dict[str, Any]:
        """A verified answer, asked for again with its violations while that may help: not after one that was cut off."""
        usage, repairs, note = services.Usage(), 0, ""
        takes_schema = len(inspect.signature(model).parameters) > 2
        while True:
            reply = model(SYSTEM, user + note, schema) if takes_schema else model(SYSTEM, user + note)
            if isinstance(reply, str):
                reply = services.Reply(reply)
            usage += reply.usage
            verdict = self.verify(reply.text if reply.json is None else reply.json, pack, task)
            if reply.cut:
                log.warning("the model's output limit cut the answer; asking again would meet the same limit")
            if verdict.ok or reply.cut or repairs == self.config["budget"]["max_repairs"]:
                return {"verdict": verdict, "usage": usage, "repairs": repairs, "cut": reply.cut}
            repairs, note = repairs + 1, "\n\n" + gate.repair_prompt(verdict.violations)

    def _saved(self, task: str, began: datetime, out: dict[str, Any]) -> list[str]:
        """Prompt, pack, meta data and, if there is one, answer and report of a run."""
        folder = Folder(self.spark, f"{self.workspace}/runs/{began:%Y%m%dT%H%M%S%f}-{task}")
        files = {"prompt.md": out["bundle"], "evidence.json": out["pack"].items, "meta.json": out["meta"]}
        if "verdict" in out:
            verdict = out["verdict"]
            files |= {"result.json": verdict.cleaned, "verification.json": {"ok": verdict.ok, "violations": verdict.violations, "stats": verdict.stats}, "report.md": out["report"]}
        text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, indent=2, default=lambda x: getattr(x, "__dict__", str(x)))
        return [folder.write(name, text(value)) for name, value in files.items()]

    def run_preset(self, name: str, values: dict[str, str] | None = None, model: Any = None, save: bool = False) -> dict[str, Any]:
        """A task by its preset, with arguments put into the instruction."""
        good, bad = presets.load(self.config["presets"], set(self.source_ids()))
        if name not in good:
            raise cfg.ConfigError(f"no preset {name}" + (f": {'; '.join(bad[name])}" if name in bad else ""))
        p = good[name]
        return self.run_task(p.task, p.expand(values or {}), p.effort, model, list(p.sources) or None, save)
