"""Coverage, roll-ups and period reports over ledger entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegauge.functions.predicates import VERDICTS

GAP_VERDICTS = ("NULL_UNMAPPED", "NULL_STALE")


def between(entries: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Entries with ``start <= timestamp <= end``."""
    if start:
        entries = entries.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end:
        entries = entries.filter(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    return entries


def coverage_register(entries: DataFrame) -> DataFrame:
    """Entries that no rule covered, or that had no fresh data."""
    return entries.filter(F.col("verdict").isin(*GAP_VERDICTS)).select(
        "tenant_id", "sequence_number", "timestamp", "verdict", "telemetry_id", "rule_id", "kg_version", "reasoning")


def daily_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.date_trunc("day", "timestamp").alias("day"), "verdict").agg(
        F.count(F.lit(1)).alias("n_entries"), F.count("escalation_status").alias("escalated"))


def verdict_distribution(entries: DataFrame) -> DataFrame:
    return entries.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_entries"))


def verdict_summary(entries: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row: the five counts and their shares in percent; zeros when the period is empty."""
    chosen = between(entries, start, end)
    counts = chosen.agg(F.count(F.lit(1)).alias("total"),
                        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS])
    shares = [F.coalesce(F.try_divide(F.col(v.lower()) * 100.0, F.col("total")), F.lit(0.0)).alias(v.lower() + "_percent")
              for v in VERDICTS]
    return counts.select("*", *shares)


def violations_by_rule(entries: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    flagged = between(entries, start, end).filter("verdict = 'FLAG'")
    return flagged.groupBy("rule_id").agg(F.count(F.lit(1)).alias("violations")).orderBy(
        F.desc("violations"), "rule_id")


def top_rules(entries: DataFrame, n: int = 5, start: str | None = None, end: str | None = None) -> DataFrame:
    return violations_by_rule(entries, start, end).limit(n)


def violations_by_date(entries: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    flagged = between(entries, start, end).filter("verdict = 'FLAG'")
    return flagged.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("violations"))


def uncovered_subjects(entries: DataFrame) -> DataFrame:
    """Subjects that got NULL_UNMAPPED, with how often and when."""
    return entries.filter("verdict = 'NULL_UNMAPPED'").groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_entries"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))
