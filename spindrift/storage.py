"""Files by way of Hadoop's file systems, so that a path means the same here as in Spark's own readers and writers."""

from __future__ import annotations

from py4j.java_gateway import is_instance_of
from pyspark.sql import SparkSession


class Place:
    """A path on the file system it belongs to: the one of its scheme, else the default one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, jvm, conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()
        raw = jvm.org.apache.hadoop.fs.Path(path)
        self.fs = raw.getFileSystem(conf)
        if is_instance_of(spark.sparkContext._gateway, self.fs, "org.apache.hadoop.fs.ChecksumFileSystem"):
            self.fs = self.fs.getRawFileSystem()  # without check sums beside each file, which break when a file is changed by other means
        self.at = self.fs.makeQualified(raw)

    def __str__(self) -> str:
        return self.at.toString()

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self}/{name}")

    @property
    def name(self) -> str:
        return self.at.getName()

    @property
    def parent(self) -> Place:
        return Place(self.spark, self.at.getParent().toString())

    def exists(self) -> bool:
        return self.fs.exists(self.at)

    def is_dir(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.at).isDirectory()

    def is_file(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.at).isFile()

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at)) if self.is_dir() else []

    def make(self) -> None:
        self.fs.mkdirs(self.at)

    def delete(self) -> None:
        self.fs.delete(self.at, True)

    def move(self, to: Place) -> None:
        """To a path that must not be there yet."""
        to.parent.make()
        if to.exists() or not self.fs.rename(self.at, to.at):
            raise OSError(f"{self} cannot be moved to {to}")

    def read(self) -> bytes:
        stream = self.fs.open(self.at)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, data: bytes) -> None:
        """The whole file, put in place when it is complete."""
        part = Place(self.spark, f"{self.parent}/.{self.name}.part")
        self.parent.make()
        out = self.fs.create(part.at, True)
        try:
            out.write(data, 0, len(data))
        finally:
            out.close()
        for old in (self, self.parent / f".{self.name}.crc"):
            if old.exists():
                old.delete()
        part.move(self)
