"""SQL functions and views against the operators behind them."""

from __future__ import annotations

from evisieve import surface
from evisieve.engine import Engine
from evisieve.functions.redact import redact


def test_views_and_functions(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.py").write_text("@app.get('/x')\ndef retry():\n    eval(y)\n")
    (tmp_path / "s" / "b.md").write_text("# Head\n\ntext\n")
    e = Engine(spark, f"file://{tmp_path}/w", {"sources": [{"id": "s", "type": "local", "path": str(tmp_path / "s")}]})
    e.sync()
    assert "t_chunks" not in surface.views(e, "t_")
    e.build_index()
    names = surface.views(e, "t_")
    assert set(names) == {f"t_{n}" for n in ("docs", "findings", "summary", "facts", "endpoints", "chunks", "postings", "lengths")}
    asked = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert asked("SELECT c.path FROM t_postings p JOIN t_chunks c USING (key) WHERE p.term = 'retry'") == [("a.py",)]
    chunks = asked("SELECT d.path, c.chunk_no, c.start, c.`end`, c.text FROM t_docs d, LATERAL chunks_of(d.text, d.kind, d.path, d.title) c ORDER BY 1, 2")
    assert chunks == [tuple(r) for r in e.snapshot().chunks.select("path", "chunk_no", "start", "end", "text").orderBy("path", "chunk_no").collect()]
    assert asked("SELECT r.method, r.route, r.line FROM t_docs d, LATERAL routes_of(d.text) r WHERE d.kind = 'code' AND r.framework = 'fastapi/flask'") == [("GET", "/x", 1)]
    secret = "password = 'abcdef123456'"
    assert asked(f'SELECT mask_text("{secret}"), html_text("<p>a&amp;b</p>"), mask_text(NULL)') == [(redact(secret)[0], "a&b", None)]
    assert asked("SELECT count(*) FROM chunks_of(CAST(NULL AS STRING), 'doc', 'p', 't')") == [(0,)]
