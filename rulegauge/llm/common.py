"""Helpers the training-text operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.session import work_path

#: A word is a run of anything but ASCII white space; bytes.split() cuts UTF-8 text the same way.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession):
    """Shuffle files of the jobs inside go when their job has ended, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and fixes row ids."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with short_lived_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def drop_stored(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames. Only for tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scalar(df: DataFrame):
    """The one row of a global aggregate."""
    with short_lived_shuffles(df.sparkSession):
        return df.first()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """A row id that names one row even if doc ids are null or repeated. Store the result before using the ids twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def word_count(text: Column) -> Column:
    """Words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; NULL is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes``, one row at least."""
    for batch in rows:
        n = max(1, int(batch.num_rows * most_bytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def lists(values: np.ndarray, counts, kind: pa.DataType) -> pa.Array:
    """A list column: ``counts[i]`` values to row i."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
