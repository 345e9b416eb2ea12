"""Commits of stored tables: what is part of a table, and since which version."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class CommitLog:
    """The commits of a stored table in order: ``_log/<version>`` holds the commit's name. A file is written aside and
    renamed into place, which fails if the version is taken, so of two writers of one version one wins."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm, self.path = spark, spark._jvm, path.rstrip("/")
        self.fs = self.new_path().getFileSystem(spark._jsc.hadoopConfiguration())

    def new_path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def commits(self) -> list[str]:
        if not self.fs.exists(self.new_path("_log")):
            return []
        rows = self.spark.read.text(f"{self.path}/_log").select("value", F.col("_metadata.file_name").alias("version")).collect()
        return [r.value for r in sorted(rows, key=lambda r: r.version)]

    def put(self, version: int, commit: str) -> bool:
        """Whether ``commit`` has become this version."""
        aside = self.new_path("_log", f".{commit}")
        out = self.fs.create(aside, True)
        out.write(commit.encode())
        out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(aside, self.new_path("_log", f"{version:012d}"), plain)
        except Exception as taken:  # noqa: BLE001 - only "exists already" is expected here
            if "FileAlreadyExists" not in str(taken):
                raise
            return False
        return True

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.new_path(*parts), True)

    def unlogged(self) -> list[str]:
        """Folders of entries that were written without a log."""
        folder = self.new_path()
        names = [f.getPath() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return [p.toString() for p in names if not p.getName().startswith(("_", ".", "commit="))]
