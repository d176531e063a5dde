"""Hybrid search for many information needs at once: word and vector lists, fused, boosted and diversified.

A need is put as one or more query texts. Everything is a relation over all needs, so a batch of them costs one pass over
the postings of their terms; per need only the limits of the rankings reach a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking
from .index import Snapshot
from .segments import SegmentSnapshot


def hybrid(
    now: Snapshot | SegmentSnapshot, needs: DataFrame, k: int = 28, per_query: int = 60, balance: float = ranking.DIVERSITY, bridge: bool = True,
    chunks: DataFrame | None = None, asked: DataFrame | None = None, kind_priors: dict[str, float] | None = None, source_priority: dict[str, float] | None = None,
    most_tokens: int | None = ranking.MOST_TOKENS,
) -> DataFrame:
    """need_id, key, score and rank: the best k chunks of each need.

    needs: need_id, list_no and text, each pair of the first two once. asked: need_id, list_no and embedding of queries
    that have a vector. chunks: what may be found (all by default); counts stay those of the whole index. A need
    without a hit has no rows. Lists count towards the mean even where they are empty. most_tokens: see diversified.
    """
    filtered = chunks is not None
    chunks = now.chunks if chunks is None else chunks
    lists = needs.select(F.struct("need_id", "list_no").alias("q"), "text")
    terms = ranking.query_terms(lists, "q", "text", bridge)
    words = ranking.bm25(now.postings, now.lengths, terms, chunks.select("key") if filtered else None, per_query, now.totals)
    found = words.select(F.col("query_id.need_id").alias("query_id"), F.concat(F.lit("w"), "query_id.list_no").alias("list_no"), F.lit("bm25").alias("kind"), "key", "score")
    counts = needs.groupBy("need_id").agg(F.count("*").alias("n"))
    if asked is not None and now.vectors is not None:
        vectors = now.vectors.join(chunks.select("key"), "key", "left_semi") if filtered else now.vectors
        near = ranking.vector_search(vectors, asked.select(F.struct("need_id", "list_no").alias("query_id"), "embedding"), per_query)
        found = found.unionByName(near.select(F.col("query_id.need_id").alias("query_id"), F.concat(F.lit("v"), "query_id.list_no").alias("list_no"), F.lit("vector").alias("kind"), "key", "score"))
        more = asked.groupBy("need_id").agg(F.count("*").alias("n"))
        counts = counts.unionByName(more).groupBy("need_id").agg(F.sum("n").alias("n"))
    fused = ranking.fuse(found, counts.withColumnRenamed("need_id", "query_id"))
    every = terms.select(F.col("query_id.need_id").alias("query_id"), "term").distinct()
    scored = ranking.boosted(fused, chunks, every, kind_priors, source_priority)
    return ranking.diversified(scored, chunks, k, balance, now.vectors, most_tokens).withColumnRenamed("query_id", "need_id")
