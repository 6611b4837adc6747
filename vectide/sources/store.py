"""Files of any store that Spark reaches, by Hadoop's file system API on the driver: names, renames, first and last bytes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import conflict


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(self.path(name)))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.path(name))))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(self.path(name))).getLength() if self.exists(name) else 0

    def move_new(self, source: str, target: str) -> None:
        """Renames to a name that must be free: the commit point of an append."""
        if self.exists(target) or not self.fs.rename(self._path(self.path(source)), self._path(self.path(target))):
            raise conflict(f"{target} was written by someone else")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.path(name)), True)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(self.path(name)))

    def write_text(self, name: str, text: str) -> None:
        """Replaces a small file, by a rename."""
        temp = f"{name}.tmp"
        out = self.fs.create(self._path(self.path(temp)), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self._path(self.path(name)), False)
        self.fs.rename(self._path(self.path(temp)), self._path(self.path(name)))

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(self.path(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _data_files(self) -> list:
        """The root, a file, or the files with bytes of a folder, by name."""
        top = self.fs.getFileStatus(self._path(self.root))
        files = self.fs.listStatus(top.getPath()) if top.isDirectory() else [top]
        full = [f for f in files if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", "."))]
        return sorted(full, key=lambda f: f.getPath().getName())

    def first_file(self) -> str | None:
        files = self._data_files()
        return files[0].getPath().toString() if files else None

    def ends_with_newline(self) -> bool:
        """Whether the root, a file or the last file with bytes of a folder, ends its last line; true without any byte."""
        full = self._data_files()
        if not full:
            return True
        last = full[-1]
        stream = self.fs.open(last.getPath())
        try:
            stream.seek(last.getLen() - 1)
            return stream.read() == 10
        finally:
            stream.close()
