"""Leases: which versions of an index somebody reads, so that builders don't delete them.

A lease is a small file that names a version and when it ends. Readers renew it while they read and drop it when they
are done; one whose time has passed, of a reader that is gone, counts for nothing and is cleared away.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

from .files import Folder

SECONDS = 3600.0


class Lease:
    """One reader's hold on a version."""

    def __init__(self, folder: Folder, version: int, seconds: float):
        self.folder, self.version, self.seconds, self.name = folder, version, seconds, None
        self.renew()

    def renew(self) -> None:
        """A new file with a later end, then the old one goes: the version is held all the time."""
        old, self.ends = self.name, time.time() + self.seconds
        self.name = f"{self.version:08d}-{uuid.uuid4().hex}.json"
        self.folder.write(self.name, json.dumps({"version": self.version, "ends": self.ends}))
        if old:
            self.folder.delete(old)

    def keep(self) -> None:
        """Renews a lease of which less than half is left."""
        if self.name and self.ends - time.time() < self.seconds / 2:
            self.renew()

    def release(self) -> None:
        if self.name:
            self.folder.delete(self.name)
            self.name = None


class Leases:
    """All leases of an index."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, f"{path}/leases")

    def take(self, version: int, seconds: float = SECONDS) -> Lease:
        return Lease(self.folder, version, seconds)

    def held(self) -> set[int]:
        """Versions that unexpired leases hold."""
        out, now = set(), time.time()
        for name in self.folder.newest(".json"):
            try:
                own = json.loads(self.folder.read(name))
            except Exception:  # released, or being written: its name tells the version
                out.add(int(name[:8]))
                continue
            if own["ends"] > now:
                out.add(own["version"])
            else:
                self.folder.delete(name)
        return out
