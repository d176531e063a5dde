"""The cache of documents: one folder per source, replaced source by source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import VERSION, html_to_text_udf
from ..schemas import DOC


def _file_system(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration())


def write_cache(docs: DataFrame, path: str, sources: list[str] | None = None) -> None:
    """Replaces the sources that occur in `docs`, and those in `sources` even by nothing; others stay."""
    docs.withColumn("source", F.col("source_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    if sources:
        there = {r[0] for r in docs.where(F.col("source_id").isin(*sources)).select("source_id").distinct().collect()}  # names in `sources`
        for source in set(sources) - there:
            drop_source(docs.sparkSession, path, source)


def _folder(spark: SparkSession, path: str, source: str) -> str:
    return f"{path}/source={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)}"


def drop_source(spark: SparkSession, path: str, source: str) -> None:
    """Takes a source out of the cache."""
    _file_system(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, path, source)), True)


def replace_source(docs: DataFrame, path: str, source: str) -> None:
    """Puts `docs` in place of all that the cache holds of a source, also if there are none.

    The new folder is written beside the old one, which may be what `docs` is read from, and moved there when it is whole.
    """
    spark = docs.sparkSession
    at, hadoop = _file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    own, new, old = _folder(spark, path, source), f"{path}/_new-{uuid.uuid4().hex}", f"{path}/_old-{uuid.uuid4().hex}"
    docs.write.parquet(new)
    moved = at.exists(hadoop(own)) and at.rename(hadoop(own), hadoop(old))
    if not at.rename(hadoop(new), hadoop(own)):
        if moved:
            at.rename(hadoop(old), hadoop(own))
        raise OSError(f"the cache of {source} couldn't be replaced")
    if moved:
        at.delete(hadoop(old), True)


def read_cache(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """All cached documents, or those of some sources: other folders aren't read. A cache without a folder is empty."""
    if not _file_system(spark, path).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], DOC)
    docs = spark.read.schema(f"{DOC}, source string").parquet(path)
    return (docs if sources is None else docs.where(F.col("source").isin(*sources))).drop("source")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Documents as JSON lines; lines that don't parse are left out."""
    return spark.read.schema(DOC).option("mode", "DROPMALFORMED").json(path).where("doc_id is not null and text is not null")


def write_json_lines(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def converted(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """doc_id, version, text_version and text of pages: texts of unchanged pages come from the cache.

    pages: doc_id, version, html; cache: doc_id, version, text_version, text.
    """
    old = cache.where(F.col("text_version") == VERSION).select("doc_id", "version", F.col("text").alias("old")).dropDuplicates(["doc_id", "version"])
    both = pages.join(old, ["doc_id", "version"], "left")
    kept = both.where("old is not null").select("doc_id", "version", F.lit(VERSION).alias("text_version"), F.col("old").alias("text"))
    new = both.where("old is null").select("doc_id", "version", F.lit(VERSION).alias("text_version"), html_to_text_udf(F.coalesce("html", F.lit(""))).alias("text"))
    return kept.unionByName(new)


def descendants(edges: DataFrame, roots: DataFrame, depth: int = 10) -> DataFrame:
    """id and depth of all pages below `roots` (id), level by level; edges: parent, child. Cycles end.

    One join per level, each level stored, so lineage doesn't grow; `depth` bounds the loop.
    """
    from ..operators.tables import kept

    level = kept(roots.select("id", F.lit(0).alias("depth")).distinct(), "level")
    seen = level
    for d in range(1, depth + 1):
        below = edges.join(level.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct()
        level = kept(below.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def embedded(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose text has a cached vector, with it, and chunks that have to be embedded. Both by hash."""
    known = cache.select("hash", "embedding").dropDuplicates(["hash"])
    return chunks.join(known, "hash"), chunks.join(known, "hash", "left_anti")
