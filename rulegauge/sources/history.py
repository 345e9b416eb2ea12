"""The telemetry history table: append-only, partitioned by tenant and day, with a manifest of its partitions.

Appends and retention are commits: a version of the table is the partitions that commits up to it added and none dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.sources.commits import CommitLog

SCHEMA_VERSION = "0.2.0"


def history_rows(records: DataFrame, *, received: str | None = None) -> DataFrame:
    """Records in the stored form. The payload is canonical JSON text, its hash comes from the same text."""
    payload = V.canonical_json(F.col("measurement"))
    return records.select(
        "tenant_id", "subject", F.col("measurement_id").alias("telemetry_id"), F.col("ts").alias("telemetry_ts"),
        (F.col(received) if received else F.col("ts")).alias("received_ts"),
        payload.alias("measurement"), F.sha2(payload, 256).alias("measurement_hash"),
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.to_date("ts").alias("day"))


STORED = ("tenant_id string, subject string, telemetry_id string, telemetry_ts timestamp, received_ts timestamp, measurement string, "
          "measurement_hash string, schema_version string, day date")
_PART = "folder string, tenant_id string, day date, n bigint, dropped boolean, commit string"


def append_history(records: DataFrame, path: str, *, received: str | None = None, by: tuple = ("tenant_id", "day")) -> None:
    """Append as one commit; repeated telemetry ids are kept. Rows are clustered by tenant and day so that files stay few.

    ``by=("day",)`` suits many small tenants; ``drop_expired`` leaves such commits alone.
    """
    spark, name = records.sparkSession, uuid.uuid4().hex
    rows = history_rows(records, received=received)
    (rows.repartitionByRange("tenant_id", "day", "telemetry_ts").write.partitionBy(*by).parquet(f"{path}/commit={name}"))
    # the folder below the table's, as it is named on disk
    file = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")
    folder = F.concat(F.lit(f"commit={name}/"), F.regexp_extract(file, f"/commit={name}/(.*)/[^/]*$", 1))
    written = spark.read.schema(STORED).parquet(f"{path}/commit={name}")
    _record(written.groupBy(folder.alias("folder"), "tenant_id", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("dropped", F.lit(False)),
            path, name)


def _record(parts: DataFrame, path: str, name: str) -> None:
    """Make a commit of what ``parts`` adds or drops."""
    spark = parts.sparkSession
    parts.withColumn("commit", F.lit(name)).coalesce(1).write.parquet(f"{path}/_parts/{name}")
    log = CommitLog(spark, path)
    while not log.put(len(log.commits()), name):
        pass


def manifest(spark: SparkSession, path: str, *, version: int | None = None) -> DataFrame:
    """All entries of the first ``version`` commits (all of them without it): partitions added and dropped, with their rows."""
    commits = CommitLog(spark, path).commits()[:version]
    if not commits:
        return spark.createDataFrame([], _PART)
    return spark.read.schema(_PART).parquet(*[f"{path}/_parts/{c}" for c in commits])


def live_parts(entries: DataFrame) -> DataFrame:
    """The partitions of a manifest that are part of the table."""
    return entries.filter("NOT dropped").join(entries.filter("dropped").select("folder"), "folder", "left_anti")


def read_history(spark: SparkSession, path: str, *, version: int | None = None) -> DataFrame:
    """The table, or an earlier version of it; ``tenant_id`` and ``day`` prune partitions."""
    folders = [f"{path}/{r.folder}" for r in live_parts(manifest(spark, path, version=version)).select("folder").distinct().collect()]
    rows = spark.read.schema(STORED).option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], STORED)
    return rows.withColumn("payload", F.try_parse_json("measurement"))


def drop_expired(spark: SparkSession, path: str, settings: DataFrame, now: str, *, default_days: int = 90) -> int:
    """Drop the partitions whose whole day ends at or before their tenant's cutoff; returns the number of rows dropped.

    Only the manifest is read and written: a new version without those partitions. Readers of earlier versions keep
    their files until ``vacuum``.
    """
    parts = retention_cut(live_parts(manifest(spark, path)).withColumn("telemetry_ts", F.col("day").cast("timestamp")), settings, now,
                          default_days=default_days).filter(F.col("expired") & F.col("folder").contains("/tenant_id="))
    gone = parts.select("folder", "tenant_id", "day", "n", F.lit(True).alias("dropped"))
    count = gone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if count:
        _record(gone, path, uuid.uuid4().hex)
    return count


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files of dropped partitions, and of no others; returns the number of partitions."""
    log, gone = CommitLog(spark, path), manifest(spark, path).filter("dropped").select("folder").distinct().collect()
    for row in gone:
        log.drop(row.folder)
    return len(gone)


def retention_cut(history: DataFrame, settings: DataFrame, now: str, *, default_days: int = 90) -> DataFrame:
    """Adds ``expired``: the row's whole day ends at or before its tenant's cutoff."""
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(
        days=F.coalesce(F.col("buffer_retention_days"), F.lit(default_days)))
    day_end = (F.date_add(F.to_date("telemetry_ts"), 1)).cast("timestamp")
    return (history.join(settings.select("tenant_id", "buffer_retention_days"), "tenant_id", "left")
            .withColumn("expired", day_end <= cutoff).drop("buffer_retention_days"))


def retained(history: DataFrame, settings: DataFrame, now: str, **kw) -> DataFrame:
    return retention_cut(history, settings, now, **kw).filter(~F.col("expired")).drop("expired")


def history_summary(history: DataFrame) -> DataFrame:
    """Per tenant: rows, first and last time, distinct subjects, payload bytes."""
    return history.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("telemetry_ts").alias("oldest_record"),
        F.max("telemetry_ts").alias("newest_record"), F.countDistinct("subject").alias("distinct_subjects"),
        F.sum(F.octet_length("measurement")).alias("total_measurement_bytes"))


def backfill_schema_version(rows: DataFrame, *, old: str = "0.1.0", new: str = SCHEMA_VERSION) -> DataFrame:
    """Rows written before the column existed get ``old``; a frame without the column gets it."""
    if "schema_version" not in rows.columns:
        return rows.withColumn("schema_version", F.lit(old))
    return rows.withColumn("schema_version", F.coalesce("schema_version", F.lit(old)))
