"""Folders and small files of the shared store, whatever file system it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    """The file system that holds ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.root = path.rstrip("/")
        self._files = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def names(self, *parts: str) -> list[str]:
        """Names of what a folder holds, none if there is no such folder."""
        folder = self._path("/".join([self.root, *parts]))
        return sorted(s.getPath().getName() for s in self._files.listStatus(folder)) if self._files.exists(folder) else []

    def matching(self, pattern: str) -> list[str]:
        """Paths below the root that match a pattern, relative to it."""
        base = self._path(self.root).toUri().getPath()
        found = self._files.globStatus(self._path(f"{self.root}/{pattern}")) or ()
        return sorted(s.getPath().toUri().getPath()[len(base):].strip("/") for s in found)

    def size(self, pattern: str) -> int:
        """Bytes below the folders that match a pattern."""
        found = self._files.globStatus(self._path(f"{self.root}/{pattern}")) or ()
        return sum(self._files.getContentSummary(s.getPath()).getLength() for s in found)

    def create(self, name: str) -> bool:
        """Make an empty file; false if it is there already. Of many that try, one succeeds."""
        try:
            self._files.create(self._path(f"{self.root}/{name}"), False).close()
        except Exception as error:
            if "AlreadyExists" not in str(error):
                raise
            return False
        return True

    def write(self, name: str, text: str) -> None:
        """Write a small file, visible only when it is whole."""
        draft = self._path(f"{self.root}/{name}.draft")
        out = self._files.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._files.rename(draft, self._path(f"{self.root}/{name}")):
            raise FileExistsError(f"{self.root}/{name}")

    def read(self, name: str) -> str:
        stream = self._files.open(self._path(f"{self.root}/{name}"))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._files.delete(self._path(f"{self.root}/{name}"), True)
