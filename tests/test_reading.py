"""Windows of lines: ends, masks and what isn't there."""

from __future__ import annotations

import pytest
from evisieve.engine import Engine
from evisieve.functions.redact import redact
from evisieve.operators import reading

KEY = "a\n-----BEGIN PRIVATE KEY-----\nMIIB\nxyz\n-----END PRIVATE KEY-----\nb"


@pytest.mark.parametrize(
    ("text", "start", "end", "want"),
    [
        ("a\nb\nc\n", 1, None, (3, 3, "a\nb\nc")),
        ("a\nb\nc", 2, 2, (3, 1, "b")),
        ("a\nb\nc", 3, 9, (3, 1, "c")),
        ("a\nb\nc", 4, None, (3, 0, None)),
        ("a\nb\nc", 3, 2, (3, 0, None)),
        ("", 1, None, (0, 1, "")),
        (None, 1, None, (0, 1, "")),
        (None, 2, None, (0, 0, None)),
        ("\n".join(map(str, range(500))), 100, 400, (500, 5, "99\n100\n101\n102\n103")),
        (KEY, 3, 4, (6, 2, "\n")),  # inside a key
        ('x\npassword = "abcdef123456"\ny', 2, 2, (3, 1, redact('password = "abcdef123456"')[0])),
    ],
)
def test_line_window(spark, text, start, end, want):
    rows = spark.createDataFrame([(7, text, "kept")], "doc_id long, text string, url string")
    r = reading.line_window(rows, start, end, 5 if text and len(text) > 1000 else 201).first()
    assert (r.total_lines, r.shown, r.text, r.url) == (*want, "kept")


def test_fetch_and_window(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.py").write_text("one\ntwo\nthree\n")
    e = Engine(spark, f"file://{tmp_path}/w", {"sources": [{"id": "s", "type": "local", "path": str(tmp_path / "s")}]})
    e.sync()
    assert e.fetch("s:a.py", 2) == ["two", "three"]
    own = e.window("a.py", None, 2, 2)
    assert (own["lines"], own["total_lines"], own["text"], own["source_id"]) == ("2-2", 3, "two", "s")
    for call, error in ((lambda: e.fetch("s:none"), KeyError), (lambda: e.window("none"), KeyError), (lambda: e.fetch("s:a.py", 9), ValueError)):
        with pytest.raises(error):
            call()
