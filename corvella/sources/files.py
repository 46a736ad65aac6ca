"""Small files and folders on whatever file system a path names (local, HDFS, object stores), by Hadoop's own API."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def read(self, path: str) -> str | None:
        """The whole text; None where there is no such file."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not exist yet; False if another writer made it first."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        new = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{self.jvm.java.util.UUID.randomUUID()}")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if fs.exists(p) or not fs.rename(new, p):
            fs.delete(new, False)
            return False
        return True

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, old: str, new: str) -> None:
        """One rename; the folder above the new place is made."""
        fs, p = self._at(new)
        fs.mkdirs(p.getParent())
        if not fs.rename(self.jvm.org.apache.hadoop.fs.Path(old), p):
            raise OSError(f"{old} can't be moved to {new}")

    def escaped(self, value: str) -> str:
        """A value as Spark writes it in the name of a partition's folder."""
        return self.jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
