"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM leaves methods above this size interpreted; let Spark split such stages instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "rulegauge", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Put the runtime-settable defaults on a session somebody else built."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the checkpoint folder the cluster names.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="rulegauge-"))
    return context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    base = shared_dir(spark)
    path = f"{name}-{uuid.uuid4().hex}"
    return os.path.join(base, path) if "://" not in base else f"{base.rstrip('/')}/{path}"


def materialize(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Cut lineage: write to the shared folder once, read back from there. ``by``: a folder per value of that column."""
    spark = df.sparkSession
    path = work_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of literal rows whose size the optimizer knows (so that it may broadcast it)."""
    shape = T.StructType.fromDDL(schema)
    columns = [pa.array(list(values), to_arrow_type(field.dataType)) for values, field in
               zip(zip(*rows) if rows else [[] for _ in shape], shape)]
    return spark.createDataFrame(pa.table(columns, names=shape.names), shape)
