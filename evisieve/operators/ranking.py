"""Ranking: BM25 over postings, vector search, score fusion, boosts and diversity.

A chunk is known by `key`; ties are broken by it, ascending. Rankings are frames of (query_id, key, score).
All queries of a batch run in one job: query terms are a small frame joined with the postings, sums are
combined before the shuffle, and per-query limits are rank filters that Spark applies before the exchange too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.glossary import weighted, weighted_terms
from .tables import kept

K1, B = 1.2, 0.75
COMMON_SHARE, SHORT = 0.6, 2
DIGITS = 9
PATH_BOOST, KIND_BOOST, SOURCE_BOOST, LEAST_FACTOR = 0.35, 0.2, 0.15, 0.01
DIVERSITY, SAME_DOC, DUPLICATE, MOST_TOKENS = 0.72, 0.08, 0.95, 900
#: Query terms and vectors are broadcast only up to so many rows; larger batches are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Query vectors that are broadcast at a time.
QUERY_BLOCK = 8192
#: Scores that a worker holds at a time.
MOST_SCORES = 1 << 20


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def term_frame(spark: SparkSession, queries: dict[str, str], bridge: bool = True) -> DataFrame:
    """query_id, term, weight of given query texts."""
    rows = [(q, t, w) for q, text in queries.items() for t, w in weighted_terms(text, bridge).items()]
    return small(spark.createDataFrame(rows, "query_id string, term string, weight double"), len(rows))


def query_terms(queries: DataFrame, id_col: str, text_col: str, bridge: bool = False) -> DataFrame:
    """The same for a frame of queries, without Python; `bridge` adds the glossary's terms that a query doesn't hold itself, by an Arrow function."""
    if bridge:
        return weighted(queries, id_col, text_col)
    term = F.explode(tx.tokens(F.col(text_col), stop_words=True)).alias("term")
    return queries.select(F.col(id_col).alias("query_id"), term).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))


def ranked(scores: DataFrame, top: int, per: str = "query_id") -> DataFrame:
    """The best `top` rows of each query with their rank; equal scores by key."""
    order = Window.partitionBy(per).orderBy(F.col("score").desc(), "key")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def bm25(postings: DataFrame, lengths: DataFrame, terms: DataFrame, allowed: DataFrame | None = None, top: int = 60, totals: tuple[int, float] | None = None) -> DataFrame:
    """query_id, key, score and rank. postings: term, key, tf; lengths: key, dl; terms: query_id, term, weight.

    Postings that have their chunk's dl themselves (index.scoring_postings) aren't joined with lengths.

    `allowed` (key) limits what is ranked; document counts and the mean length stay those of the whole corpus.
    totals: number of chunks and mean length, where an index keeps them; else lengths are counted.
    """
    if totals is None:
        counted = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.greatest("dl", F.lit(1))), F.lit(1.0)).alias("avgdl"))
    # Only the query's terms are counted and joined: the small side of both joins is the distinct query terms.
    wanted = terms.select("term").distinct()
    df = postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "term")
    weighed = weighed.join(F.broadcast(counted)) if totals is None else weighed.select("*", F.lit(totals[0]).cast("long").alias("n"), F.lit(float(totals[1])).alias("avgdl"))  # one row
    weighed = weighed.where((F.col("df") / F.col("n") <= COMMON_SHARE) | (F.length("term") > SHORT))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = weighed.select("query_id", "term", ((1 + F.log("weight")) * idf).alias("w"), "avgdl")
    hits = postings if allowed is None else postings.join(allowed.select("key").distinct(), "key", "left_semi")
    weighed = kept(weighed, "weights")
    if "dl" in postings.columns:
        # The weights of a batch are few, and a bucket of postings has all of its chunks: sums need no shuffle.
        hits = hits.where("key is not null").join(weighed, "term")
    else:
        # Postings of the batch's terms meet lengths by key, and each becomes a row per query only after that: sums need no other shuffle.
        n = weighed.count()
        hits = hits.join(small(weighed.select("term").distinct(), n), "term", "left_semi").join(lengths, "key").join(small(weighed, n), "term")
    tf, dl = F.col("tf"), F.greatest(F.col("dl"), F.lit(1))
    score = F.col("w") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    sums = hits.groupBy("query_id", "key").agg(F.round(F.sum(score), DIGITS).alias("score"))
    return ranked(sums, top)


def vector_search(vectors: DataFrame, queries: DataFrame, top: int = 60) -> DataFrame:
    """query_id, key, score and rank by inner product. vectors: key, embedding; queries: query_id, embedding.

    The query set is taken in blocks of about QUERY_BLOCK, so what is broadcast is bounded. Arrow batches of
    vectors are multiplied with a block as matrices, and each batch keeps its best `top` per query, so what is
    shuffled doesn't grow with the product.
    """
    queries = queries.select("query_id", "embedding").where("embedding is not null")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if blocks == 1:
        return _search_block(vectors, queries, top)
    parts = [_search_block(vectors, queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), top) for b in range(blocks)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _best(scores: np.ndarray, tie: np.ndarray, top: int) -> np.ndarray:
    """Where the `top` best scores are, in order; only those that can be among them are sorted."""
    able = np.arange(len(scores))
    if len(scores) > top:
        able = np.flatnonzero(scores >= np.partition(scores, len(scores) - top)[len(scores) - top])
    return able[np.lexsort((tie[able], -scores[able]))[:top]]


def _search_block(vectors: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    asked = queries.select("query_id", "embedding").where("embedding is not null").toArrow()  # about QUERY_BLOCK rows
    ids, own = asked.column(0).combine_chunks(), asked.column(1).combine_chunks()
    dims = len(own[0]) if len(own) else 0
    shared = vectors.sparkSession.sparkContext.broadcast((ids, own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dims)))
    kind, key = queries.schema["query_id"].dataType.simpleString(), vectors.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            fits = np.flatnonzero(pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False) == matrix.shape[1])
            if not len(ids) or not len(fits):
                continue
            keys, rows = batch.column(0).take(pa.array(fits)), batch.column(1).take(pa.array(fits))
            block = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
            tie = np.empty(len(fits), dtype=np.int64)
            tie[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(fits))
            # Scores of some queries at a time: the product of a block and a batch would be hundreds of megabytes.
            step = max(1, MOST_SCORES // len(fits))
            for at in range(0, len(ids), step):
                scores = np.round(matrix[at : at + step] @ block.T, DIGITS)
                best = [_best(row, tie, top) for row in scores]
                which = pa.array(at + np.repeat(np.arange(len(best)), [len(b) for b in best]))
                yield pa.RecordBatch.from_arrays([ids.take(which), keys.take(pa.array(np.concatenate(best))), pa.array(np.concatenate([row[b] for row, b in zip(scores, best)]))], names=["query_id", "key", "score"])

    return ranked(vectors.select("key", "embedding").mapInArrow(run, f"query_id {kind}, key {key}, score double"), top)


def fuse(lists: DataFrame, n_lists: DataFrame | None = None) -> DataFrame:
    """query_id, key, score: the mean of normalised scores over all lists of a query.

    lists: query_id, list_no, kind (bm25 or vector), key, score. BM25 scores are divided by the list's best
    one, vector scores spread from the list's worst to its best. n_lists (query_id, n) counts empty lists too.
    """
    own = Window.partitionBy("query_id", "list_no")
    high, low = F.max("score").over(own), F.min("score").over(own)
    lists = lists.withColumn("high", high).withColumn("low", low)
    spread = F.when(F.col("high") > F.col("low"), (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(1.0)
    part = F.when(F.col("kind") == "vector", spread).otherwise(F.when(F.col("high") > 0, F.col("score") / F.col("high")).otherwise(0.0))
    counts = n_lists if n_lists is not None else lists.groupBy("query_id").agg(F.countDistinct("list_no").alias("n"))
    sums = lists.groupBy("query_id", "key").agg(F.sum(part).alias("s"))
    return sums.join(counts, "query_id").select("query_id", "key", F.round(F.col("s") / F.col("n"), DIGITS).alias("score"))


def boosted(fused: DataFrame, chunks: DataFrame, terms: DataFrame, kind_priors: dict[str, float] | None = None, source_priority: dict[str, float] | None = None) -> DataFrame:
    """query_id, key, score with multiplicative boosts for path and title words, kind and source.

    chunks: key, path, title, kind, source_id; terms: query_id, term.
    """
    every = terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    known = lambda col, values: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), col), F.lit(0.0)) if values else F.lit(0.0)
    joined = fused.join(every, "query_id").join(chunks.select("key", "path", "title", "kind", "source_id"), "key")
    words = tx.tokens(F.concat_ws(" ", "path", "title"))
    factor = 1 + PATH_BOOST * tx.overlap_ratio(F.col("terms"), words) + KIND_BOOST * known(F.col("kind"), kind_priors) + SOURCE_BOOST * known(F.col("source_id"), source_priority)
    return joined.select("query_id", "key", F.round(F.col("score") * F.greatest(F.lit(LEAST_FACTOR), factor), DIGITS).alias("score"))


def mmr(candidates: list[dict], k: int, balance: float = DIVERSITY) -> list[dict]:
    """Greedy selection from candidates in rank order: score, doc_id, and tokens (a set) or vector.

    Relevance against the closest chosen one; the same document costs SAME_DOC, a near copy 1. Each candidate
    keeps its greatest similarity so far, so a step costs one comparison per candidate left.
    """
    pool = [dict(c) for c in candidates[: max(6 * k, 60)]]
    top = pool[0]["score"] if pool and pool[0]["score"] else 1.0
    near, chosen, docs = [0.0] * len(pool), [], set()
    left = list(range(len(pool)))
    while left and len(chosen) < k:
        value = lambda i: balance * pool[i]["score"] / top - (1 - balance) * near[i] - SAME_DOC * (pool[i]["doc_id"] in docs) - (near[i] >= DUPLICATE)
        best = max(left, key=lambda i: (value(i), -i))
        left.remove(best)
        chosen.append(pool[best])
        docs.add(pool[best]["doc_id"])
        for i in left:
            near[i] = max(near[i], similarity(pool[i], pool[best]))
    return chosen


def similarity(a: dict, b: dict) -> float:
    if a.get("vector") is not None and b.get("vector") is not None:
        return float(np.dot(a["vector"], b["vector"]))
    both = len(a["tokens"] & b["tokens"])
    return both / max(1, len(a["tokens"]) + len(b["tokens"]) - both)


def diversified(scores: DataFrame, chunks: DataFrame, k: int = 28, balance: float = DIVERSITY, vectors: DataFrame | None = None, most_tokens: int | None = MOST_TOKENS) -> DataFrame:
    """query_id, key, score and rank in order of selection. chunks: key, doc_id, text; vectors: key, embedding.

    Only the pool of max(6 k, 60) candidates per query is joined with texts and grouped. most_tokens: how many of
    a text's first tokens are compared (900 is the reference's rule); None: all. Each distinct one is sent once.
    """
    pool = ranked(scores, max(6 * k, 60))
    words = tx.tokens(F.col("text"))
    words = F.array_distinct(words if most_tokens is None else F.slice(words, 1, most_tokens))
    pool = pool.join(chunks.select("key", "doc_id", "text"), "key").withColumn("tokens", words).drop("text")
    pool = pool.join(vectors.select("key", "embedding"), "key", "left") if vectors is not None else pool.withColumn("embedding", F.lit(None).cast("array<float>"))
    types = {f.name: f.dataType.simpleString() for f in pool.schema}

    def pick(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        for r in rows:
            r["tokens"], r["vector"] = set(r["tokens"] or ()), None if r["embedding"] is None else np.array(r["embedding"], dtype=np.float64)
        chosen = mmr(rows, k, balance)
        return pa.table({"query_id": pa.array([r["query_id"] for r in chosen], table.schema.field("query_id").type), "key": pa.array([r["key"] for r in chosen], table.schema.field("key").type), "score": pa.array([r["score"] for r in chosen], pa.float64()), "rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    return pool.select("query_id", "key", "score", "rank", "doc_id", "tokens", "embedding").groupBy("query_id").applyInArrow(pick, f"query_id {types['query_id']}, key {types['key']}, score double, rank int")


def jaccard_pairs(pool: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of each query's candidates with their similarity. pool: query_id, key, terms (distinct)."""
    a = pool.select("query_id", F.col("key").alias("a"), F.col("terms").alias("terms_a"))
    b = pool.select("query_id", F.col("key").alias("b"), F.col("terms").alias("terms_b"))
    sim: Column = F.round(tx.jaccard(F.col("terms_a"), F.col("terms_b")), 6)
    return a.join(b, "query_id").where("a < b").select("query_id", "a", "b", sim.alias("similarity")).where(F.col("similarity") >= least)
