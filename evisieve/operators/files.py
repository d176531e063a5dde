"""Small files in a folder on any Hadoop file system: packs, run artefacts, manifests."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Writes are exclusive: an existing file is never overwritten."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, name: str, text: str) -> str:
        target = f"{self.path}/{name}"
        out = self._fs.create(self._path(target), False)
        out.write(bytearray(text.encode()))
        out.close()
        return target

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def newest(self, suffix: str = "") -> list[str]:
        """Names from new to old; equal times by name."""
        root = self._path(self.path)
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return [n for _, n in sorted(found, reverse=True) if n.endswith(suffix)]

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def prune(self, keep: int, suffix: str = "") -> None:
        for name in self.newest(suffix)[keep:]:
            self.delete(name)
