"""Small driver-side file operations on any file system Spark knows."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Text files, listing, renaming and deleting under one root through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file in one step: a new file is written beside it and renamed over it."""
        fresh = self.path(f"{name}.new")
        stream = self.fs.create(fresh, True)
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        kinds[0] = options.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri() if self.path("").toUri().getScheme() else self.fs.getUri(), self.conf)
        context.rename(fresh, self.path(name), kinds)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))
