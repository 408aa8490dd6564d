"""Small files of a folder in any store that Spark reaches, by Hadoop's file system interface on the driver."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        return self._fs().exists(self._path(name))

    def make(self) -> None:
        self._fs().mkdirs(self._path())

    def sizes(self, pattern: str = "*", folder: str = "") -> dict[str, int]:
        """Names and sizes of the files of a folder (not below it) that match."""
        fs, p = self._fs(), self._path(folder)
        if not fs.exists(p):
            return {}
        return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.isFile() and fnmatch(s.getPath().getName(), pattern)}

    def read(self, name: str) -> bytes:
        source = self._fs().open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def put(self, name: str, data: bytes) -> None:
        """Writes a file under another name and renames it, over one that is there: readers see the old file or the new one."""
        fs, tmp = self._fs(), self._path(name + ".tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(tmp), fs.makeQualified(self._path(name)), over)

    def delete(self, name: str) -> bool:
        return self._fs().delete(self._path(name), True)
