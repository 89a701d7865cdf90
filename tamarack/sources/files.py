"""Small files on any file system that Spark reaches, for logs beside the data."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from tamarack.errors import CommitConflict


class Folder:
    """A folder by Hadoop path; its files are small, or moved and deleted only."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._path().getFileSystem(conf)
        self._conf = conf
        self.local = self._fs.getScheme() == "file"

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _on_disk(self, name: str) -> str:
        return os.path.join(self._path().toUri().getPath(), name)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Files and folders right below, in order."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def entries(self) -> list[tuple[str, int, float]]:
        """(name, bytes, seconds since 1970 of the last change) of what is right below."""
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._path()))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"can't move {name} to {to} in {self.path}")

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)

    def publish(self, name: str, text: str) -> None:
        """Makes a whole file appear under a new name, or raises CommitConflict if the name is taken."""
        own = f"{name}.{uuid.uuid4().hex}.tmp"
        self.write(own, text)
        try:
            if self.local:  # a local rename would replace a file that is there; a link never does
                try:
                    os.link(self._on_disk(own), self._on_disk(name))
                except FileExistsError:
                    raise CommitConflict(f"{name} exists") from None
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
                try:
                    context.rename(self._path(own), self._path(name), self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0))
                except Exception as e:
                    if self.exists(name):
                        raise CommitConflict(f"{name} exists") from e
                    raise
        finally:
            self.delete(own)
