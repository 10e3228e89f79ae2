"""Numbered manifests: the one atomic step by which a dataset changes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Files:
    """The few file-system calls that commits need, on any store Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Create the file with its whole text; False where another writer created it first."""
        part = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(text.encode())
        stream.close()
        target = self._path(f"{self.root}/{name}")
        self._fs.mkdirs(target.getParent())
        hadoop = self._jvm.org.apache.hadoop
        options = self._jvm.java.lang.reflect.Array.newInstance(hadoop.fs.Options.Rename.NONE.getClass(), 1)
        options[0] = hadoop.fs.Options.Rename.NONE
        try:
            hadoop.fs.FileContext.getFileContext(part.getFileSystem(self._conf).getUri(), self._conf).rename(self._fs.makeQualified(part), self._fs.makeQualified(target), options)
        except Exception as error:
            self._fs.delete(part, False)
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        return self._fs.getContentSummary(self._path(path)).getLength()

    def write_bytes(self, path: str, data: bytes) -> None:
        stream = self._fs.create(self._path(path), True)
        try:
            stream.write(data)
        finally:
            stream.close()

    def read_bytes(self, path: str) -> bytes:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()


class Manifests:
    """Versions of one dataset's state; a version is created once and never changed."""

    def __init__(self, files: Files, dataset: str):
        self.files, self.folder = files, f"{dataset}/manifests"

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names(self.folder) if n.endswith(".json") and not n.startswith(".")]

    def read(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{version:012d}.json"))

    def latest(self) -> dict | None:
        found = self.versions()
        return self.read(max(found)) if found else None

    def commit(self, change) -> dict:
        """Apply change(state) to the newest state until its version is created; change returns None to give up."""
        while True:
            now = self.latest()
            new = change(now)
            if new is None:
                return now
            new = new | {"version": (now["version"] if now else 0) + 1}
            if self.files.write_new(f"{self.folder}/{new['version']:012d}.json", json.dumps(new)):
                return new
