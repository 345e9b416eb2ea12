"""Rolling agreement, latency buckets and alert conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.functions.predicates import STATUSES
from rulegauge.operators.ordered import as_of, dense_index, previous_row, trailing

# Upper bounds in seconds of the latency buckets.
LATENCY_BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 15.0, 60.0)


def agreement(entries: DataFrame, *, n: int = 1000, threshold: float = 0.95, keys: tuple = ("tenant_id",),
              order: tuple = ("sequence_number",), index: str | None = None) -> DataFrame:
    """State of the rolling window of the last ``n`` statuses after each entry.

    Needs ``entry_id`` and ``verifier_status``. ``index`` names a gap-free running number per key if there
    is one; otherwise places are numbered first. Cost does not depend on ``n``.
    """
    keys = list(keys)
    if n <= 0:
        raise ValueError(f"window size must be positive, got {n}")
    placed = entries.withColumn("_at", F.col(index).cast("bigint")) if index else dense_index(
        entries, keys=keys, order=list(order), name="_at").withColumn("_at", F.col("_at").cast("bigint"))
    shown = [F.when(F.col("verifier_status") == s, 1.0).alias(s.lower()) for s in STATUSES]
    base = placed.select(*keys, "entry_id", "_at", F.lit(n).cast("bigint").alias("_n"), *shown)
    got = trailing(base, None, keys=keys, pos="_at", span="_n", id_col="entry_id",
                   values=[s.lower() for s in STATUSES])
    counts = [F.col(s.lower() + "_n").alias(s.lower()) for s in STATUSES]
    rate = F.col("agreed_n") / F.col("n")
    return got.select("entry_id", F.col("n").alias("observed"), *counts, rate.alias("agreement_rate"),
                      (rate >= threshold).alias("is_healthy"))


def verdict_counters(entries: DataFrame) -> DataFrame:
    return entries.groupBy("verdict").agg(F.count(F.lit(1)).alias("total"))


def latency_histogram(samples: DataFrame, column: str, *, keys: tuple = ()) -> DataFrame:
    """Cumulative bucket counts of a latency in seconds: one row per bucket, ``le`` = upper bound."""
    inf = float("inf")
    wide = samples.groupBy(*keys).agg(*[
        F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate((*LATENCY_BUCKETS, inf))])
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("samples"))
                     for i, b in enumerate((*LATENCY_BUCKETS, inf))])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.le", "r.samples")


def sustained_low(samples: DataFrame, *, value: str, threshold: float, for_seconds: int, keys: list[str],
                  id_col: str, ts: str = "ts", tile_seconds: int = 6 * 3600) -> DataFrame:
    """Stretches during which ``value`` stayed below ``threshold`` for at least ``for_seconds``.

    A stretch is the run of low samples after one healthy sample, so each low sample only has to find the last
    healthy one before it; runs are then grouped by that sample.
    """
    low = F.coalesce(F.col(value) < threshold, F.lit(False))
    base = samples.select(*keys, id_col, V.micros(F.col(ts)).alias("_us"), low.alias("_low"))
    # equal times: order by id, so that a run ends at the healthy sample that comes next
    placed = as_of(base.filter("_low"), base.filter("NOT _low").select(*keys, "_us"), keys=keys, pos="_us",
                   id_col=id_col, tile_width=tile_seconds * V.MICROS)
    runs = placed.groupBy(*keys, "seen_pos").agg(
        F.min("_us").alias("_from"), F.max("_us").alias("_to"), F.count(F.lit(1)).alias("n_samples"))
    long_enough = F.col("_to") - F.col("_from") >= for_seconds * V.MICROS
    return runs.filter(long_enough).select(
        *keys, F.timestamp_micros("_from").alias("started_at"), F.timestamp_micros("_to").alias("last_seen_at"),
        F.timestamp_micros(F.col("_from") + for_seconds * V.MICROS).alias("fires_at"), "n_samples")


def recent_gaps(gaps: DataFrame, probes: DataFrame, *, keys: list[str], id_col: str, seconds: int = 900) -> DataFrame:
    """For each probe row the number of gap rows within the last ``seconds``; ``firing`` when there is any."""
    span = F.lit(seconds).cast("bigint") * V.MICROS
    left = probes.select(*keys, id_col, V.micros(F.col("ts")).alias("_us"), span.alias("_span"))
    right = gaps.select(*keys, V.micros(F.col("ts")).alias("_us"), span.alias("_span"))
    got = trailing(left, right, keys=keys, pos="_us", span="_span", id_col=id_col)
    return got.select(id_col, F.col("n").alias("gaps"), (F.col("n") > 0).alias("firing"))


def silences(records: DataFrame, *, keys: list[str], id_col: str, seconds: int = 300,
             tile_seconds: int = 6 * 3600) -> DataFrame:
    """Pauses of more than ``seconds`` between a source's records."""
    base = records.select(*keys, id_col, V.micros(F.col("ts")).alias("_us"))
    linked = previous_row(base, keys=keys, order=["_us", id_col],
                          tile=F.floor(F.col("_us") / (tile_seconds * V.MICROS)).cast("bigint"), values=["_us"])
    gap = F.col("_us") - F.col("prev__us")
    return linked.filter(gap > seconds * V.MICROS).select(
        *keys, F.timestamp_micros("prev__us").alias("silent_from"), F.timestamp_micros("_us").alias("silent_to"),
        (gap / V.MICROS).alias("silent_seconds"))
