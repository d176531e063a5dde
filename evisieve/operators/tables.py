"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; in a session on one machine that names none, a temporary folder, set in the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='evisieve-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again; its lineage ends there and lost executors cost nothing.

    The table is removed when the driver ends.
    """
    path = f"{shared_folder(df.sparkSession)}/evisieve/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """kept() as a table in `buckets` buckets by `key`, sorted by it: sums and joins by that key need no shuffle."""
    spark, own = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/evisieve/{own}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(f"evisieve_{own}")
    _until_exit(spark, path)
    return spark.table(f"evisieve_{own}")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """`df` over all cores, at most about `rows` to a task: rows of a small file from which much is made would all be one task's."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def _until_exit(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
