"""Tables that change by commits: data goes to new folders, and a numbered manifest, written last, says which folders make a version.

Readers take a manifest's folders, so they see a version whole or not at all, and an older one for as long as its folders stay.
A manifest is created only if its number is free: of two writers that start from one version, the second fails with
:class:`Conflict` and may try again on what the first has left. What a writer that fails has written is in no manifest.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed since the version that a commit starts from."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; one of our own only if all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Versions:
    """The manifests of the table at ``root``, in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> object:
        return self._path(f"{self.root}/manifests/{number:010d}.json")

    def numbers(self) -> list[int]:
        """Of the versions committed so far, in order."""
        folder = self._path(f"{self.root}/manifests")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        names = [f.getPath().getName() for f in found]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def state(self, number: int) -> dict:
        stream = self._fs.open(self._manifest(number))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """The last version's number and manifest; 0 and nothing where there is none."""
        known = self.numbers()
        return (known[-1], self.state(known[-1])) if known else (0, {})

    def commit(self, after: int, state: dict) -> int:
        """Make ``state`` the version that follows ``after``."""
        number = after + 1
        if self._fs.exists(self._manifest(number)):
            raise Conflict(f"version {number} of {self.root} is there already")
        # whole before it has its name: readers never see a part of it
        draft = self._path(f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(json.dumps(state, ensure_ascii=False).encode())
        out.close()
        if self._fs.exists(self._manifest(number)) or not self._fs.rename(draft, self._manifest(number)):
            self._fs.delete(draft, False)
            raise Conflict(f"version {number} of {self.root} is there already")
        return number

    def folder(self, kind: str) -> str:
        """A new folder for data of the table, not there yet."""
        return f"{self.root}/{kind}-{uuid.uuid4().hex}"

    def made(self, folder: str) -> None:
        """Make ``folder`` where it isn't there."""
        self._fs.mkdirs(self._path(folder))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the folders that none of the last ``keep`` versions names, and older manifests; how many folders went. For when no
        reader or writer is at work on others."""
        known = self.numbers()
        named = json.dumps([self.state(n) for n in known[-keep:]])
        gone = 0
        for f in self._fs.listStatus(self._path(self.root)):
            name = f.getPath().getName()
            if name != "manifests" and name not in named:
                self._fs.delete(f.getPath(), True)
                gone += 1
        for n in known[:-keep]:
            self._fs.delete(self._manifest(n), False)
        return gone
