"""Streaming forms of the operators, and a runner that drains what is available into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.operators import ledger as L
from rulegauge.operators import routing as R
from rulegauge.operators import rules as E
from rulegauge.session import work_path
from rulegauge.streaming import processors as S

SUBJECT = ["tenant_id", "subject"]
# groups of keys that the processors of short keys take at a call; part of the state's layout
BUCKETS = 1024
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(stream: DataFrame, out: str, state: str) -> None:
    """Take an append-mode stream as far as its input goes. ``state`` carries over to the next call."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    query = (stream.writeStream.format("parquet").option("path", out).outputMode("append")
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over everything available and read the written table back."""
    spark = stream.sparkSession
    out = work_path(spark, f"{name}-out")
    advance(stream, out, work_path(spark, f"{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def advance_updates(stream: DataFrame, out: str, state: str) -> None:
    """As :func:`advance` in update mode: each batch's changed rows are written under the batch's number."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest row per key of a table written by :func:`advance_updates`."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def read_parquet_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    """``files_per_trigger`` bounds a micro-batch. It needs files that follow each other in time, else rows come late."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stateless(records: DataFrame, registry: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream-static join and the record-only rule operators, append mode."""
    return E.evaluate_stateless(R.route(records, registry, rules))


def _micros(records: DataFrame) -> DataFrame:
    return records.withColumn("us", V.micros(F.col("ts")))


def bucketed(rows: DataFrame, keys: list[str]) -> GroupedData:
    """Rows grouped by a bucket of their keys, for the processors that hold state per key themselves."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).groupBy("_bucket")


def _run(records: DataFrame, keys: list[str], processor, schema: str, mode: str = "None") -> DataFrame:
    grouped = bucketed(records, keys) if isinstance(processor, S.PerKey) else records.groupBy(*keys)
    return grouped.transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def trailing_windows(records: DataFrame, *, seconds: int, path: str) -> DataFrame:
    rows = _micros(records).withColumn("val", V.number_or_null(V.lookup(F.col("measurement"), F.lit(path))))
    rows = rows.filter("us IS NOT NULL").select(*SUBJECT, "measurement_id", "us", "val")
    schema = "measurement_id string, count bigint, sum_value double, avg_value double, late boolean, to_replay boolean, tenant_id string, subject string"
    return _run(rows, SUBJECT, S.TrailingWindow(SUBJECT, seconds), schema)


def since_last(records: DataFrame) -> DataFrame:
    rows = _micros(records).filter("us IS NOT NULL").select(*SUBJECT, "measurement_id", "us")
    schema = "measurement_id string, since_last double, late boolean, tenant_id string, subject string"
    return _run(rows, SUBJECT, S.LastRecord(SUBJECT), schema)


def debounce(records: DataFrame, *, seconds: int) -> DataFrame:
    """A late record has no verdict here: it is kept, marked ``late``, for the replay path."""
    gap = F.col("since_last")
    verdict = F.when(F.col("late"), F.lit(None).cast("string")).when(gap.isNull() | F.isnan(gap) | (gap > seconds), "CLEAR").otherwise("DISCRETIONARY")
    return since_last(records).withColumn("verdict", verdict)


def append_chain(verdicts: DataFrame, *, ledger: str = "tenant_id", version_key: str = "model_version") -> DataFrame:
    """Hash-chain a stream of verdicts; the text around the previous hash and the number is made beforehand."""
    hash_key, seq_key = '"previous_hash":"', '"sequence_number":'
    # a number no value can hold unquoted right after the key marks the place of the sequence number
    text = (verdicts.withColumn("previous_hash", F.lit("")).withColumn("sequence_number", F.lit(0).cast("bigint"))
            .withColumn("_text", L.entry_payload(version_key)))
    cut = F.instr("_text", hash_key) + len(hash_key)
    rest = text.withColumn("lead_text", F.substr("_text", F.lit(1), cut - 1)).withColumn("_rest", F.substr("_text", cut))
    at = F.instr("_rest", seq_key) + len(seq_key)
    rows = rest.select(ledger, "timestamp_iso", "telemetry_id", "lead_text",
                       F.substr("_rest", F.lit(1), at - 1).alias("middle_text"),
                       F.substr("_rest", at + 1).alias("tail_text"))
    schema = f"{ledger} string, telemetry_id string, sequence_number bigint, previous_hash string, entry_hash string"
    return _run(rows, [ledger], S.ChainAppend(ledger), schema)


def agreement(entries: DataFrame, *, n: int = 1000, threshold: float = 0.95, key: str = "tenant_id") -> DataFrame:
    rows = entries.select(key, "entry_id", "sequence_number", "verifier_status")
    schema = f"{key} string, entry_id string, observed bigint, agreement_rate double, is_healthy boolean"
    return _run(rows, [key], S.RollingAgreement(key, n, threshold), schema)


def silence(records: DataFrame, *, seconds: int = 300, key: str = "tenant_id", delay: str = "10 minutes") -> DataFrame:
    rows = _micros(records).withWatermark("ts", delay).select(key, "ts", "us")
    return _run(rows, [key], S.Silence(key, seconds), f"{key} string, silent_from_us bigint", "EventTime")


def lateness(records: DataFrame, *, allowed_seconds: int) -> DataFrame:
    """Marks the records that come too late for online state; they belong to the replay path and are not lost."""
    rows = _micros(records).filter("us IS NOT NULL").select(*SUBJECT, "measurement_id", "us")
    schema = "measurement_id string, behind_seconds double, to_replay boolean, tenant_id string, subject string"
    return _run(rows, SUBJECT, S.Lateness(SUBJECT, allowed_seconds), schema)


def daily_counts(verdicts: DataFrame) -> DataFrame:
    """Tumbling day counts per verdict, for update mode.

    Without a watermark: a row counts on its day however late it comes. State is one number per day and verdict.
    """
    return (verdicts.groupBy(F.window("ts", "1 day"), "verdict")
            .agg(F.count(F.lit(1)).alias("n_entries"))
            .select(F.col("window.start").alias("day"), "verdict", "n_entries"))
