"""Documents from tables: text tables, pages, conversations and raw files."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce
from pathlib import Path
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import html_to_text_udf
from ..functions.paths import SKIPPED_DIRS, is_binary, is_included, is_sensitive, kind_and_lang, strict_text
from ..operators.tables import kept

FILE_BYTES = 400_000


def as_docs(df: DataFrame, source_id: Column, path: Column, text: Column, kind: str | Column = "doc", source_type: str = "table", **more: Column) -> DataFrame:
    """Rows of schemas.DOC; columns that aren't given are null."""
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    doc_id = F.concat(source_id, F.lit(":"), path)
    title = F.coalesce(more.get("title", none), path)
    return df.select(
        doc_id.alias("doc_id"), source_id.alias("source_id"), F.lit(source_type).alias("source_type"), path.alias("path"), title.alias("title"), kind.alias("kind"),
        F.coalesce(more.get("lang", none), F.lit("txt")).alias("lang"), more.get("url", none).alias("url"), more.get("version", none).alias("version"),
        F.sha2(text, 256).alias("hash"), more.get("meta", F.create_map().cast("map<string,string>")).alias("meta"), text.alias("text"),
    ).where(F.col("text").isNotNull())


def first_seen(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Each distinct key (null is one) with its least `at`, and how many rows have it as `copies`; combined before the shuffle."""
    return rows.groupBy(key).agg(F.min(at).alias(at), F.count("*").alias("copies"))


def text_docs(docs: DataFrame, kind: str = "doc") -> DataFrame:
    """A table of doc_id, text, lang and source."""
    return as_docs(docs, F.coalesce("source", F.lit("table")), F.col("doc_id").cast("string"), F.col("text"), kind, lang=F.col("lang"))


def page_docs(pages: DataFrame) -> DataFrame:
    """A table of page_id, url and html: the title as a heading, then the page's text."""
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    body = html_to_text_udf(F.coalesce("html", F.lit("")))
    return as_docs(pages, F.lit("web"), F.col("page_id").cast("string"), F.concat(F.lit("# "), F.trim(title), F.lit("\n\n"), body), title=F.trim(title), url=F.col("url"))


def conversation_docs(turns: DataFrame) -> DataFrame:
    """A table of conv_id, turn, role and text: the turns of a conversation, in order, as one ticket.

    A conversation is one document, so its turns meet in one group.
    """
    line = F.concat(F.coalesce("role", F.lit("?")), F.lit(": "), F.coalesce("text", F.lit("")))
    joined = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: t["line"]), "\n")
    return as_docs(joined, F.lit("chat"), F.col("conv_id").cast("string"), text, "ticket")


#: Entries that a task lists before it gives the folders that are left to others; the first task starts all others.
FIRST_ENTRIES, TASK_ENTRIES = 2_000, 20_000
ENTRY = "path string, uri string, length long, modified long, folder boolean"


def entries(root: str, folder: str) -> Iterator[tuple[str, str, int, int, bool]]:
    """Rows of ENTRY right in a folder of the tree at `root` (a path or a URI); links are left out."""
    prefix = f"{folder}/" if folder else ""
    scheme, _, rest = root.partition(":")
    if not rest or scheme == "file":
        top = Path("/" + (rest or root).lstrip("/")) if rest or root.startswith("/") else Path(root).resolve()
        with os.scandir(top / folder) as found:
            for own in found:
                if own.is_symlink() or not (own.is_dir() or own.is_file()):
                    continue
                stat = own.stat()
                yield prefix + own.name, Path(own.path).as_uri(), stat.st_size, stat.st_mtime_ns // 1_000_000, own.is_dir()
        return
    system, top = pa_fs.FileSystem.from_uri(root)
    for own in system.get_file_info(pa_fs.FileSelector(f"{top.rstrip('/')}/{folder}".rstrip("/"))):
        if own.type in (pa_fs.FileType.File, pa_fs.FileType.Directory):
            yield prefix + own.base_name, f"{root.rstrip('/')}/{quote(prefix + own.base_name)}", own.size or 0, (own.mtime_ns or 0) // 1_000_000, own.type == pa_fs.FileType.Directory


def listed(spark: SparkSession, root: str, first: int = FIRST_ENTRIES, most: int = TASK_ENTRIES) -> DataFrame:
    """path below the root, uri, length and modified (ms) of all files, listed by tasks; SKIPPED_DIRS aren't entered.

    A task walks the folders it gets until it has met so many entries; folders that are left are dealt to more tasks in
    the next round. Names with a leading dot are files like all others, which Spark's own listing would leave out.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    names = [f.split()[0] for f in ENTRY.split(", ")]
    if "://" not in root and root.partition(":")[0] != "file" and not Path(root).is_dir():
        raise FileNotFoundError(f"no folder {root}")

    def walk(limit: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = 0
            for batch in batches:
                left, rows = list(reversed(batch.column("path").to_pylist())), []
                while left and met < limit:
                    for entry in entries(root, left.pop()):
                        met += 1
                        if not entry[4]:
                            rows.append(entry)
                        elif entry[0].rsplit("/", 1)[-1].lower() not in SKIPPED_DIRS:
                            left.append(entry[0])
                rows += [(folder, None, 0, 0, True) for folder in left]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        return run

    folders, files, limit = spark.createDataFrame([("",)], "path string"), [], first
    while True:
        found = kept(folders.mapInArrow(walk(limit), ENTRY), "listing")
        files.append(found.where("not folder").drop("folder"))
        n = found.where("folder").count()
        if not n:
            return reduce(DataFrame.unionByName, files)
        folders, limit = found.where("folder").select("path").repartition(n if n < 1024 else 1024), most


def with_content(files: DataFrame) -> DataFrame:
    """Files (columns before it stay) with the bytes behind `uri`, read by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                raw = []
                for uri in part.column("uri").to_pylist():
                    if uri.startswith("file:"):
                        raw.append(Path(unquote(uri.removeprefix("file:").replace("//", "", 1))).read_bytes())
                    else:
                        system, path = pa_fs.FileSystem.from_uri(uri)
                        with system.open_input_stream(path) as stream:
                            raw.append(stream.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*part.schema.names, "content"])

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", content binary")


def file_docs(spark: SparkSession, root: str, source_id: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), deny: bool = True, extra_deny: tuple[str, ...] = (), most_bytes: int = FILE_BYTES, unknown_types: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of a folder tree, and how many files were skipped for which reason (`skipped` and `count`).

    Paths and sizes are filtered before contents are read. Reasons are met in this order: sensitive (before
    anything else, so that nothing is said about files that aren't included), too_large, binary, unknown_type,
    bad_encoding.
    """
    files = listed(spark, root)
    if (n := files.count()) > 64:
        files = files.repartition(min(n // 32, 4096))
    kind, lang = kind_and_lang(F.col("path"))
    files = files.select("*", kind.alias("kind"), lang.alias("lang"), (is_sensitive(F.col("path"), extra_deny) if deny else F.lit(False)).alias("sensitive"))
    files = files.where(F.col("sensitive") | is_included(F.col("path"), include, exclude))
    early = F.when(F.col("sensitive"), "sensitive").when(F.col("length") > most_bytes, "too_large")
    files = files.withColumn("early", early)
    read = with_content(files.where("early is null").drop("early", "sensitive")).withColumn("text", strict_text(F.col("content")))
    late = F.when(is_binary(F.col("content")), "binary").when((F.col("kind") == "other") & ~F.lit(unknown_types), "unknown_type").when(F.col("text").isNull(), "bad_encoding")
    read = read.withColumn("late", late)
    meta = F.create_map(F.lit("root"), F.lit(root), F.lit("bytes"), F.col("length").cast("string"))
    docs = as_docs(read.where("late is null"), F.lit(source_id), F.col("path"), F.col("text"), F.col("kind"), "local", lang=F.col("lang"), url=F.col("uri"), version=F.col("modified").cast("string"), meta=meta)
    skipped = files.where("early is not null").select(F.col("early").alias("skipped")).unionByName(read.where("late is not null").select(F.col("late").alias("skipped")))
    return docs, skipped.groupBy("skipped").count()
