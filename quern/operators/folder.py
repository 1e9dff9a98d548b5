"""Small files and folders through the Hadoop file API, so that an index may lie on any storage that Spark reads."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """One folder, local or on any file system known to Hadoop."""

    def __init__(self, spark: SparkSession, path):
        self.spark = spark
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path(str(path))
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = str(path).rstrip("/")

    @property
    def name(self) -> str:
        return self._path.getName()

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def parent(self) -> Folder:
        return Folder(self.spark, self._path.getParent().toString())

    def make(self) -> None:
        self._fs.mkdirs(self._path)

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def names(self) -> list[str]:
        """Names of what lies in the folder itself; none where there is no folder."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path)) if self.exists() else []

    def read(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, text: str) -> None:
        """Replace the file by way of another one, so that no reader sees half of it."""
        self._fs.mkdirs(self._path.getParent())
        part = self._jvm.org.apache.hadoop.fs.Path(self._path.getParent(), f".{self._path.getName()}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._context().rename(part, self._qualified(self._path), self._rename("OVERWRITE"))

    def write_new(self, text: str) -> bool:
        """Write a file that must not exist yet; False, and nothing is changed, where it does."""
        import uuid

        self._fs.mkdirs(self._path.getParent())
        part = self._jvm.org.apache.hadoop.fs.Path(self._path.getParent(), f".{uuid.uuid4().hex}.part")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists():
            self._fs.delete(part, False)
            return False
        try:
            self._context().rename(self._qualified(part), self._qualified(self._path), self._rename("NONE"))
        except Exception:
            self._fs.delete(part, False)
            if self.exists():
                return False
            raise
        return True

    def json(self):
        return json.loads(self.read())

    def delete(self) -> None:
        self._fs.delete(self._path, True)

    def move(self, to: Folder) -> None:
        to._fs.mkdirs(to._path.getParent())
        if str(self._fs.getUri()) == str(to._fs.getUri()):
            if not self._fs.rename(self._path, to._path):
                raise OSError(f"could not move {self.path} to {to.path}")
            return
        util, conf = self._jvm.org.apache.hadoop.fs.FileUtil, self.spark._jsc.hadoopConfiguration()
        if not util.copy(self._fs, self._path, to._fs, to._path, True, conf):
            raise OSError(f"could not move {self.path} to {to.path}")

    def _qualified(self, path):
        return self._fs.makeQualified(path)

    def _context(self):
        return self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())

    def _rename(self, how: str):
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(kind, 1)
        array[0] = getattr(kind, how)
        return array
