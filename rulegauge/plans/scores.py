"""Queries over scores against expected verdicts, and latency statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.operators import scoring as M
from rulegauge.plans import base as B

# Labelled documents as cases: expected from the labels, decided by length.
_CASE_SQL = """
  j AS (SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
  c AS (SELECT *, 'doc-' || doc_id AS case_id, CASE WHEN toxic = 1 THEN 'FLAG' WHEN quality = 1 THEN 'CLEAR' ELSE 'NULL_UNMAPPED' END AS expected,
      CASE WHEN n_chars < 300 THEN 'NULL_UNMAPPED' WHEN n_chars < 900 THEN 'FLAG' WHEN n_chars < 12000 THEN 'CLEAR' ELSE 'DISCRETIONARY' END AS predicted,
      CASE WHEN toxic = 1 THEN false WHEN quality = 1 THEN true END AS want, CASE WHEN n_chars >= 300 THEN n_chars >= 900 END AS emitted,
      CASE WHEN doc_id % 7 = 0 THEN 'LLM_CONTRADICTION' ELSE 'AGREED' END AS status, CASE WHEN n_chars < 300 THEN 0 ELSE 1 END AS checked FROM j)"""


def cases(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = docs.join(B.table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    want = F.when(F.col("toxic") == 1, False).when(F.col("quality") == 1, True)
    shape = "array<struct<obligation_id:string,satisfied:boolean>>"

    def one(flag):
        return F.when(flag.isNull(), F.array().cast(shape)).otherwise(
            F.array(F.struct(F.lit("ob.len").alias("obligation_id"), flag.alias("satisfied"))).cast(shape))
    return j.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("case_id"), F.col("lang").alias("category"),
        F.when(F.col("toxic") == 1, "FLAG").when(F.col("quality") == 1, "CLEAR").otherwise("NULL_UNMAPPED").alias("expected_verdict"),
        F.when(n < 300, "NULL_UNMAPPED").when(n < 900, "FLAG").when(n < 12000, "CLEAR").otherwise("DISCRETIONARY").alias("predicted_verdict"),
        one(want).alias("expected_assertions"), one(F.when(n >= 300, n >= 900)).alias("emitted_assertions"),
        F.when(F.col("doc_id") % 7 == 0, "LLM_CONTRADICTION").otherwise("AGREED").alias("verifier_status"),
        F.when(n < 300, 0).otherwise(1).alias("checked_assertions"), F.lit("").alias("notes"))


def _ratio_sql(hit, of="true"):
    return f"round(count(*) FILTER (WHERE ({of}) AND ({hit}))::DOUBLE / nullif(count(*) FILTER (WHERE {of}), 0), 4)"


_PARTS = {
    "eval_accuracy": {"n_cases": "count(*)", "verdict_accuracy": _ratio_sql("expected = predicted")},
    "eval_flag_rates": {"flag_recall": _ratio_sql("predicted = 'FLAG'", "expected = 'FLAG'"),
                        "flag_precision": _ratio_sql("expected = 'FLAG'", "predicted = 'FLAG'")},
    "eval_silent_clears": {"breaches_silently_cleared": "count(*) FILTER (WHERE expected = 'FLAG' AND predicted = 'CLEAR')"},
    "eval_unmapped_recall": {"unmapped_recall": _ratio_sql("predicted = 'NULL_UNMAPPED'", "expected = 'NULL_UNMAPPED'")},
    "eval_assertions": {"assertion_accuracy": _ratio_sql("want = emitted", "want IS NOT NULL")},
    "eval_agreement": {"verifier_agreement_rate": _ratio_sql("status = 'AGREED'", "checked > 0")},
}
for _name, _cols in _PARTS.items():
    B.register(_name, lambda spark, sf, cols=tuple(_cols): M.score(cases(spark, sf)).select(*cols),
               f"WITH {_CASE_SQL} SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in _cols.items()) + " FROM c")


@B.query("eval_scores_by_category", f"WITH {_CASE_SQL} SELECT lang AS category, " + ", ".join(
    f"{sql} AS {c}" for cols in _PARTS.values() for c, sql in cols.items()) + " FROM c GROUP BY lang")
def _by(spark, sf_dir):
    return M.score(cases(spark, sf_dir), by=["category"])


@B.query("eval_confusion", f"WITH {_CASE_SQL} SELECT expected AS expected_verdict, predicted AS predicted_verdict, count(*) AS n_cases FROM c GROUP BY 1, 2")
def _confusion(spark, sf_dir):
    return M.confusion(cases(spark, sf_dir))


@B.query("eval_by_category", f"WITH {_CASE_SQL} SELECT lang AS category, count(*) AS n_cases, {_ratio_sql('expected = predicted')} AS accuracy FROM c GROUP BY 1")
def _category(spark, sf_dir):
    return M.accuracy_by_category(cases(spark, sf_dir))


@B.query("eval_mismatches", f"WITH {_CASE_SQL} SELECT case_id, expected, predicted, status AS verifier_status FROM c WHERE expected <> predicted")
def _mismatches(spark, sf_dir):
    return M.mismatches(cases(spark, sf_dir)).drop("notes")


@B.query("latency_percentiles", """SELECT l_returnflag AS stage, quantile_disc(l_extendedprice, 0.5) AS p50_ms, quantile_disc(l_extendedprice, 0.9) AS p90_ms,
  quantile_disc(l_extendedprice, 0.95) AS p95_ms, quantile_disc(l_extendedprice, 0.99) AS p99_ms FROM lineitem GROUP BY 1""")
def _percentiles(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_extendedprice").alias("ms"))
    return M.percentiles(lines, "ms", by=["stage"])


@B.query("latency_summary", """SELECT event_type AS stage, count(value) AS n, round(avg(value), 3) AS mean_ms, round(stddev_samp(value), 3) AS stdev_ms,
  round(min(value), 3) AS min_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.9) AS p90_ms, quantile_disc(value, 0.95) AS p95_ms,
  quantile_disc(value, 0.99) AS p99_ms, round(max(value), 3) AS max_ms, round(count(value) / (sum(value) / 1000.0), 1) AS throughput_per_s FROM events GROUP BY 1""")
def _latency(spark, sf_dir):
    samples = B.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return M.latency_summary(samples, "ms", by=["stage"])
