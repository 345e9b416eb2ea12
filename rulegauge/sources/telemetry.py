"""Telemetry intake: JSON lines in, normalised records and a quarantine out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.functions import values as V

RECORD_COLUMNS = ["measurement_id", "tenant_id", "subject", "ts", "jurisdiction", "measurement"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Adds ``record`` (VARIANT) and ``reject_reason``; blank lines are left out.

    Reasons: ``invalid_json``, ``not_an_object``, ``pre_routed`` (the producer named a rule itself).
    """
    parsed = (lines.filter(V.strip(F.col("line")) != "")
              .withColumn("record", F.try_parse_json("line")))
    return parsed.withColumn(
        "reject_reason",
        F.when(F.col("record").isNull(), "invalid_json")
        .when(V.kind(F.col("record")) != "object", "not_an_object")
        .when(F.try_variant_get("record", F.lit("$.rule_id"), "variant").isNotNull(), "pre_routed"))


def normalize(parsed: DataFrame, *, default_tenant: str = "default") -> DataFrame:
    """Accepted lines as records. Both envelope spellings are read (``id`` and ``measurement_id``).

    The time stays NULL when the text is missing or unreadable: arrival time is never used instead.
    A missing id is made from the content, so that a re-read gives the same id.
    """
    def text(*names):
        return F.coalesce(*[F.try_variant_get("record", F.lit(f"$.{n}"), "string") for n in names])

    rest = [c for c in parsed.columns if c not in ("record", "reject_reason", "line")]
    raw_time = text("timestamp")
    return parsed.filter("reject_reason IS NULL").select(
        *rest,
        F.coalesce(text("measurement_id", "telemetry_id", "id"),
                   F.concat(F.lit("tel_"), F.sha2(F.to_json("record"), 256))).alias("measurement_id"),
        F.coalesce(text("tenant_id"), F.lit(default_tenant)).alias("tenant_id"),
        F.coalesce(text("subject"), F.lit("")).alias("subject"),
        V.parse_iso(raw_time).alias("ts"),
        text("jurisdiction").alias("jurisdiction"),
        F.try_variant_get("record", F.lit("$.measurement"), "variant").alias("measurement"),
    )


def quarantine_bad_time(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, set aside): records without a readable time do not enter evaluation."""
    return records.filter("ts IS NOT NULL"), records.filter("ts IS NULL")


def skewed_clock(records: DataFrame, settings: DataFrame, *, received: str = "received_ts",
                 default_skew: int = 60) -> DataFrame:
    """Adds ``clock_skew_seconds`` and ``rejected``: more than the tenant's allowance away from arrival."""
    gap = F.abs(V.micros(F.col(received)) - V.micros(F.col("ts"))) / V.MICROS
    allowed = F.coalesce(F.col("max_clock_skew_seconds"), F.lit(default_skew))
    return (records.join(settings.select("tenant_id", "max_clock_skew_seconds"), "tenant_id", "left")
            .withColumn("clock_skew_seconds", gap).withColumn("rejected", gap > allowed))
