"""The engine in SQL: functions for texts, and views of a workspace.

`register(spark)` adds, for SQL text in this session:

* chunks_of(text, kind, path, title): a row a chunk; use it with LATERAL
* routes_of(text): a row a route that code declares
* mask_text(text), html_text(html): texts masked, and HTML as text
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.html import html_to_text_udf
from .functions.redact import redact
from .functions.text import py_token_estimate
from .operators.chunking import pieces_of
from .operators.scanning import endpoints_of

if TYPE_CHECKING:
    from .engine import Engine


@F.udtf(returnType="chunk_no int, title string, start int, `end` int, hash string, n_tokens int, partial boolean, text string", useArrow=True)
class ChunksOf:
    """Chunks of one text, private keys masked; a null text has none."""

    def eval(self, text: str, kind: str, path: str, title: str) -> Iterator[tuple]:
        for i, p in enumerate(pieces_of(text, kind, path, title)):
            yield i, p.title, p.start, p.end, sha256(p.text.encode()).hexdigest(), py_token_estimate(p.text), p.partial, p.text


@F.udtf(returnType="method string, route string, framework string, line int, snippet string", useArrow=True)
class RoutesOf:
    """Routes that one code text declares, masked."""

    def eval(self, text: str) -> Iterator[tuple]:
        for method, route, framework, _, _, line, _, snippet in endpoints_of("", "", "", None, text or ""):
            yield method, route, framework, line, snippet


@F.pandas_udf(T.StringType())
def mask_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: redact(t)[0])


def register(spark: SparkSession) -> None:
    """Adds the functions to a session; once more does no harm."""
    spark.udtf.register("chunks_of", ChunksOf)
    spark.udtf.register("routes_of", RoutesOf)
    spark.udf.register("mask_text", mask_text)
    spark.udf.register("html_text", html_to_text_udf)


def views(engine: Engine, prefix: str = "") -> list[str]:
    """Temporary views of a workspace: docs, the index's chunks, postings and lengths, and the scan's findings, facts and endpoints."""
    frames = {"docs": engine.docs(), **engine.scan()}
    if engine.store.generations():
        now = engine.snapshot()
        frames |= {"chunks": now.chunks, "postings": now.postings, "lengths": now.lengths}
    for name, rows in frames.items():
        rows.createOrReplaceTempView(prefix + name)
    register(engine.spark)
    return [prefix + name for name in frames]
