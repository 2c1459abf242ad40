"""The driver's few file operations, on any store that Spark knows.

A seam of its own, so tests can make single steps fail.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, jvm = spark, spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = str(self.fs.makeQualified(self._path(root)).toString())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), spark._jsc.hadoopConfiguration())
        self._overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.at(name)))

    def mkdirs(self, name: str) -> None:
        self.fs.mkdirs(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.at(name)))) if self.exists(name) else []

    def sizes(self, name: str) -> dict[str, int]:
        """Lengths of all files below, by path relative to name."""
        base, out = self.fs.makeQualified(self._path(self.at(name))).toString(), {}
        it = self.fs.listFiles(self._path(self.at(name)), True)
        while it.hasNext():
            s = it.next()
            out[s.getPath().toString()[len(base) + 1 :]] = s.getLen()
        return out

    def create(self, name: str, text: str) -> None:
        """Fails with FileExistsError if it is there: one of several callers at most gets it."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(self._path(self.at(name)), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception) or self.exists(name):
                raise FileExistsError(name) from e
            raise
        out.write(text.encode())
        out.close()

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise FileNotFoundError(self.at(name))
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.open(self._path(self.at(name)))
            try:
                return bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        except Py4JJavaError as e:
            raise OSError(f"can't be read: {self.at(name)}") from e

    def digest(self, name: str) -> str:
        """SHA-256 of a file, read in blocks."""
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Written beside, then put in place in one step."""
        tmp = f"{name}.tmp"
        self.remove(tmp)
        self.create(tmp, text)
        self.rename(tmp, name)

    def rename(self, a: str, b: str) -> None:
        self._context.rename(self._path(self.at(a)), self._path(self.at(b)), self._overwrite)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)

    def read_json(self, name: str) -> object:
        return json.loads(self.read(name))
