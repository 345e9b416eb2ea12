"""Scores of decided cases against expected ones, and latency statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def duplicate_cases(cases: DataFrame) -> DataFrame:
    """Case ids that appear more than once; must be empty before scoring."""
    return cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def ratio(hit: Column, of: Column) -> Column:
    """Rounded share of rows with ``hit`` among rows with ``of``; NULL when there are none."""
    return F.round(F.try_divide(F.count_if(of & hit).cast("double"), F.count_if(of).cast("double")), 4)


def assertions_correct() -> Column:
    """Every expected (obligation, satisfied) pair was emitted; NULL when none is expected."""
    expected, emitted = F.col("expected_assertions"), F.col("emitted_assertions")

    def pairs(a):
        return F.transform(F.coalesce(a, F.array().cast("array<struct<obligation_id:string,satisfied:boolean>>")),
                           lambda x: F.struct(x["obligation_id"].alias("o"), x["satisfied"].alias("s")))
    missing = F.size(F.array_except(pairs(expected), pairs(emitted)))
    return F.when(F.coalesce(F.size(expected), F.lit(0)) > 0, missing == 0)


def score(results: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """All headline scores in one pass over ``expected_verdict, predicted_verdict, expected_assertions,
    emitted_assertions, verifier_status, checked_assertions``."""
    exp, got = F.col("expected_verdict"), F.col("predicted_verdict")
    everything = F.lit(True)
    judged = results.withColumn("_a", assertions_correct())
    return judged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_cases"),
        ratio(exp == got, everything).alias("verdict_accuracy"),
        ratio(got == "FLAG", exp == "FLAG").alias("flag_recall"),
        ratio(exp == "FLAG", got == "FLAG").alias("flag_precision"),
        F.count_if((exp == "FLAG") & (got == "CLEAR")).alias("breaches_silently_cleared"),
        ratio(got == "NULL_UNMAPPED", exp == "NULL_UNMAPPED").alias("unmapped_recall"),
        ratio(F.col("_a"), F.col("_a").isNotNull()).alias("assertion_accuracy"),
        ratio(F.col("verifier_status") == "AGREED", F.col("checked_assertions") > 0).alias("verifier_agreement_rate"))


def confusion(results: DataFrame) -> DataFrame:
    return results.groupBy("expected_verdict", "predicted_verdict").agg(F.count(F.lit(1)).alias("n_cases"))


def accuracy_by_category(results: DataFrame) -> DataFrame:
    return results.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_cases"),
        ratio(F.col("expected_verdict") == F.col("predicted_verdict"), F.lit(True)).alias("accuracy"))


def mismatches(results: DataFrame) -> DataFrame:
    return results.filter("expected_verdict <> predicted_verdict").select(
        "case_id", F.col("expected_verdict").alias("expected"), F.col("predicted_verdict").alias("predicted"),
        "verifier_status", "notes")


def percentiles(samples: DataFrame, column: str, *, by: list[str] | None = None,
                qs: tuple = (50, 90, 95, 99)) -> DataFrame:
    """Exact nearest-rank percentiles ``p50_ms`` … per group.

    Equal values are counted first with map-side combining. The running count over the distinct values is
    taken in two steps, inside value ranges and across them, so that no group is sorted in one task.
    """
    if not all(0 <= q <= 100 for q in qs):
        raise ValueError("percentages lie between 0 and 100")
    by = by or []
    counted = samples.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"))
    # value ranges that keep the order: sign and power of two, split into 1024 steps
    size = F.abs(F.col("_x"))
    step = F.when(size == 0, 0).otherwise(
        F.floor((F.log2(size) + 1100) * 1024) + 1).cast("bigint") * F.signum("_x").cast("bigint")
    ranged = counted.withColumn("_r", step)
    inside = Window.partitionBy(*by, "_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    ranges = (ranged.groupBy(*by, "_r").agg(F.sum("_n").alias("_m"))
              .withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0)))
              .withColumn("_total", F.sum("_m").over(whole)).drop("_m"))
    placed = ranged.withColumn("_run", F.sum("_n").over(inside)).join(ranges, [*by, "_r"])
    reached = F.col("_run") + F.col("_before")
    return placed.groupBy(*by).agg(*[
        F.min(F.when(reached >= F.greatest(F.lit(1), F.ceil(F.col("_total") * q / 100)), F.col("_x"))).alias(f"p{q}_ms")
        for q in qs])


def latency_summary(samples: DataFrame, column: str, *, by: list[str]) -> DataFrame:
    """Ten statistics per group of a latency in milliseconds."""
    x = F.col(column)
    stats = samples.filter(x.isNotNull()).groupBy(*by).agg(
        F.count(x).alias("n"), F.round(F.avg(x), 3).alias("mean_ms"),
        F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 3).alias("stdev_ms"),
        F.round(F.min(x), 3).alias("min_ms"), F.round(F.max(x), 3).alias("max_ms"),
        F.round(F.coalesce(F.try_divide(F.count(x).cast("double"), F.sum(x) / 1000.0), F.lit(0.0)), 1)
        .alias("throughput_per_s"))
    return stats.join(percentiles(samples, column, by=by), by)
