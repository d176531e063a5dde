"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet to the
shared folder and reads it again as the next stage's documents. All stages but the last return the columns of
`documents`; rows that a stage keeps are otherwise unchanged, but for redacted secrets and their n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisieve.llm import bpe, decontaminate, langid, neardup, secrets
from evisieve.llm.common import stored
from evisieve.llm.queries import table, vocabulary

#: Documents of which the predicted language holds less than this share of the n-grams are in no known language.
LEAST_SHARE = 0.15


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns named by position, so that no extra column clashes with an operator's, and these names."""
    safe = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))])
    return safe, {name: f"column_{i}" for i, name in reversed(list(enumerate(docs.columns)))}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best language holds too few of their n-grams."""
    filters = langid.train(docs, ~langid.held_out())
    safe, names = numbered(docs)
    found = langid.identify(safe, filters, names["doc_id"], names["text"], keep=tuple(c for c in safe.columns if c != names["doc_id"]))
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return found.select(safe.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document with the smallest id; rows without an id stay.

    Rows that share an id are one document: those with different texts all stay or all go, and of rows equal in
    id and text one stays.
    """
    safe, names = numbered(docs)
    known = safe.where(F.col(names["doc_id"]).isNotNull())
    found = neardup.near_duplicates(known, id_col=names["doc_id"], text_col=names["text"]).where("kept").select(names["doc_id"]).distinct()
    kept = known.join(found, names["doc_id"], "left_semi").withColumn("digest", F.sha2(names["text"], 256)).dropDuplicates([names["doc_id"], "digest"])
    return kept.select(safe.columns).unionByName(safe.where(F.col(names["doc_id"]).isNull())).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, however long they are.

    A passage is a run of hit words as long as a full window; where all hits are items shorter than that, a
    document goes if a twentieth of its words or more is hit. Rows that share an id go together.
    """
    safe, names = numbered(docs)
    found = decontaminate.decontaminate(safe, table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"], proximity=False)
    leaked = F.exists("runs", lambda r: r["ends"] - r["starts"] >= decontaminate.WINDOW)
    found = found.where(leaked | F.col("contaminated")).select(F.col(names["doc_id"]).alias("hit")).distinct()
    return safe.join(found, F.col(names["doc_id"]).eqNullSafe(F.col("hit")), "left_anti").select(safe.columns).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by their kind in brackets; n_chars follows the text."""
    safe, names = numbered(docs)
    rest = tuple(c for c in safe.columns if c not in (names["doc_id"], names["text"]))
    found = secrets.scan_secrets(safe, names["doc_id"], names["text"], redacted=True, keep=rest)
    length = F.when(F.size("spans") > 0, F.length("redacted")).otherwise(F.col(names["n_chars"])).cast(safe.schema[names["n_chars"]].dataType)
    new = {names["text"]: F.col("redacted"), names["n_chars"]: length}
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in safe.columns]).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_digests(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

#: Neither the trained stage nor tokenisation is expressible in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
