"""Small files of a database, through Hadoop's file systems, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet: under another name, then renamed. False if it was there first."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        draft = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp")
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        done = not fs.exists(p) and fs.rename(draft, p)
        if not done:
            fs.delete(draft, False)
        return bool(done)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)
