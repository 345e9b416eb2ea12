"""Queries over the rule grammar, stateless and over history."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.functions import values as V
from rulegauge.operators import history as H
from rulegauge.operators import routing as R
from rulegauge.operators import rules as E
from rulegauge.plans import base as B
from rulegauge.sources.rulesets import rules_frame


def _decide(spark, sf_dir, **rule):
    registry, rules = B.one_rule(spark, **rule)
    return E.evaluate_stateless(R.route(B.shaped_records(spark, sf_dir), registry, rules))


def _verdicts(spark, sf_dir, **rule):
    return _decide(spark, sf_dir, **rule).select("measurement_id", "verdict")


# The load reading as the rule grammar sees it: o is the number, NULL where none can be read.
_LOAD_SQL = f"""
  r AS ({B.RECORD_SQL}),
  s AS (SELECT *, CASE WHEN m IN (6, 9) THEN NULL WHEN m = 5 THEN 1.0 ELSE v END AS o FROM r)"""


def _numeric_sql(test: str) -> str:
    return f"""WITH {_LOAD_SQL}
  SELECT measurement_id, CASE WHEN m IN (4, 7) THEN 'NULL_UNMAPPED' WHEN m = 2 OR o IS NULL THEN 'DISCRETIONARY'
    WHEN {test} THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM s"""


for _name, _op, _value, _test in (
        ("pred_lte", "lte", "25.5", "o <= 25.5"), ("pred_gte", "gte", "25.5", "o >= 25.5"), ("pred_lt", "lt", "1", "o < 1"),
        ("pred_gt", "gt", "1.0", "o > 1"), ("pred_eq", "eq", "1", "o = 1")):
    B.register(_name, lambda spark, sf, op=_op, value=_value: _verdicts(
        spark, sf, operator=op, metric="load", unit="ms", value=value), _numeric_sql(_test))

B.register("pred_range", lambda spark, sf: _verdicts(
    spark, sf, operator="range", metric="load", unit="ms", low=1.0, high=40.0), _numeric_sql("o BETWEEN 1 AND 40"))
B.register("pred_between", lambda spark, sf: _verdicts(
    spark, sf, operator="between", metric="load", unit="ms", low=10.0, high=20.0), _numeric_sql("o BETWEEN 10 AND 20"))
B.register("pred_exists", lambda spark, sf: _verdicts(spark, sf, operator="exists", metric="load"), f"""WITH {_LOAD_SQL}
  SELECT measurement_id, CASE WHEN m IN (4, 7) THEN 'NULL_UNMAPPED' ELSE 'CLEAR' END AS verdict FROM s""")
B.register("pred_unknown", lambda spark, sf: _verdicts(spark, sf, operator="near", metric="load"), f"""WITH {_LOAD_SQL}
  SELECT measurement_id, CASE WHEN m IN (4, 7) THEN 'NULL_UNMAPPED' ELSE 'DISCRETIONARY' END AS verdict FROM s""")

_SET = "[1, 2.5, 6.55, 12.31, \"n/a\", \"20.0\", true]"
_IN_SET = "coalesce(CASE WHEN m IN (3, 8) THEN CAST(v AS VARCHAR) IN ('n/a', '20.0') WHEN m = 6 THEN true ELSE o IN (1, 2.5, 6.55, 12.31) END, false)"


def _set_sql(hit: str) -> str:
    return f"""WITH {_LOAD_SQL}
  SELECT measurement_id, CASE WHEN m IN (4, 7) THEN 'NULL_UNMAPPED' WHEN {hit} THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM s"""


B.register("pred_in_set", lambda spark, sf: _verdicts(spark, sf, operator="in_set", metric="load", value=_SET), _set_sql(_IN_SET))
B.register("pred_not_in_set", lambda spark, sf: _verdicts(spark, sf, operator="not_in_set", metric="load", value=_SET),
           _set_sql(f"NOT {_IN_SET}"))
B.register("pred_set_not_a_list", lambda spark, sf: _verdicts(spark, sf, operator="in_set", metric="load", value="7"),
           f"""WITH {_LOAD_SQL} SELECT measurement_id, CASE WHEN m IN (4, 7) THEN 'NULL_UNMAPPED' ELSE 'DISCRETIONARY' END AS verdict FROM s""")


@B.query("json_path", f"""WITH r AS ({B.RECORD_SQL})
  SELECT measurement_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k + 1 WHEN 3 THEN k + 2 END AS found FROM r""")
def _json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    payload = F.format_string('{"a":{"b":{"c":%s}},"k":%s,"x y":{"z":%s}}', k, k + 1, k + 2)
    path = F.element_at(F.array(*[F.lit(p) for p in ("a.b.c", "k", "a.x.c", "x y.z")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = B.envelope_of(B.table(spark, sf_dir, "events"), payload).withColumn("path", path)
    return rows.select("measurement_id", V.as_double(V.lookup(F.col("measurement"), F.col("path"))).cast("int").alias("found"))


@B.query("value_unit_split", f"""WITH {_LOAD_SQL}
  SELECT measurement_id, CASE WHEN m NOT IN (4, 7) THEN o END AS number,
         CASE m WHEN 0 THEN 'ms' WHEN 2 THEN 'sec' WHEN 8 THEN '' END AS unit FROM s""")
def _split(spark, sf_dir):
    at = V.lookup(F.col("measurement"), F.lit("load"))
    rows = B.shaped_records(spark, sf_dir).withColumn("at", at).withColumn("value", V.split_value(F.col("at")))
    return rows.select("measurement_id", V.parse_float(F.col("value")).alias("number"), V.split_unit(F.col("at")).alias("unit"))


@B.query("unit_guard", f"""WITH {_LOAD_SQL} SELECT verdict, count(*) AS n_records FROM (
  SELECT CASE WHEN m IN (4, 7) THEN 'NULL_UNMAPPED' WHEN m = 0 OR o IS NULL THEN 'DISCRETIONARY' WHEN o <= 5 THEN 'CLEAR' ELSE 'FLAG' END AS verdict
  FROM s) GROUP BY 1""")
def _unit(spark, sf_dir):
    return _decide(spark, sf_dir, operator="lte", metric="load", unit="sec", value="5").groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n_records"))


@B.query("reasoning_text", f"""WITH {_LOAD_SQL}
  SELECT measurement_id, CASE WHEN m IN (4, 7) THEN 'Rule ''r1'': metric ''load'' not present in telemetry.'
    WHEN m = 2 THEN 'Unit mismatch on rule ''r1'': predicate expects ''ms'', telemetry has ''sec''. No implicit conversion performed.'
    WHEN o IS NULL THEN 'Rule r1: predicate could not be evaluated; routed to human review.'
    WHEN o <= 25.5 THEN 'Rule r1 satisfied: load=' || CAST(o AS VARCHAR) || ' ≤ 25.5'
    ELSE 'Rule r1 BREACHED: load=' || CAST(o AS VARCHAR) || ' > 25.5' END AS reasoning FROM s""")
def _reasoning(spark, sf_dir):
    return _decide(spark, sf_dir, operator="lte", metric="load", unit="ms", value="25.5").select("measurement_id", "reasoning")


# ---- windows over history --------------------------------------------------------------------------

_S = 432_000
_HALF = f"(PARTITION BY user_id, subject ORDER BY ts RANGE BETWEEN to_microseconds({_S * 10**6 - 1}) PRECEDING AND CURRENT ROW)"
_CLOSED = f"(PARTITION BY user_id, subject ORDER BY ts RANGE BETWEEN to_microseconds({_S * 10**6}) PRECEDING AND CURRENT ROW)"
# x counts as a number in windows only where it is a JSON number
_X_SQL = f"r AS ({B.RECORD_SQL}), x AS (SELECT *, CASE WHEN m NOT IN (3, 5, 7, 9) THEN v END AS x FROM r)"


def _stats(spark, sf_dir, **kw):
    return H.window_stats(B.mixed_records(spark, sf_dir), seconds=_S, path="x", **kw)


@B.query("win_count", f"WITH {_X_SQL} SELECT measurement_id, count(*) OVER {_HALF} AS n FROM x")
def _win_count(spark, sf_dir):
    return _stats(spark, sf_dir).select("measurement_id", F.col("count").alias("n"))


@B.query("win_sum", f"WITH {_X_SQL} SELECT measurement_id, round(sum(x) OVER {_HALF}, 4) AS total FROM x")
def _win_sum(spark, sf_dir):
    return _stats(spark, sf_dir).select("measurement_id", F.round("sum_value", 4).alias("total"))


@B.query("win_avg", f"WITH {_X_SQL} SELECT measurement_id, round(avg(x) OVER {_HALF}, 4) AS mean FROM x")
def _win_avg(spark, sf_dir):
    return _stats(spark, sf_dir).select("measurement_id", F.round("avg_value", 4).alias("mean"))


@B.query("win_bounds", f"""WITH {_X_SQL} SELECT measurement_id, epoch_us(min(ts) OVER {_HALF}) AS oldest_us, epoch_us(max(ts) OVER {_HALF}) AS newest_us FROM x""")
def _win_bounds(spark, sf_dir):
    return _stats(spark, sf_dir).select("measurement_id", V.micros(F.col("oldest_ts")).alias("oldest_us"),
                                        V.micros(F.col("newest_ts")).alias("newest_us"))


@B.query("win_numeric_only", f"WITH {_X_SQL} SELECT measurement_id, x AS number FROM x")
def _numeric(spark, sf_dir):
    return B.mixed_records(spark, sf_dir).select(
        "measurement_id", V.number_or_null(V.lookup(F.col("measurement"), F.lit("x"))).alias("number"))


@B.query("win_per_rule_length", f"""WITH {_X_SQL}, w AS (SELECT measurement_id, subject,
    round(sum(x) OVER (PARTITION BY user_id, subject ORDER BY ts RANGE BETWEEN to_microseconds(86399999999) PRECEDING AND CURRENT ROW), 4) AS day,
    round(sum(x) OVER (PARTITION BY user_id, subject ORDER BY ts RANGE BETWEEN to_microseconds(604799999999) PRECEDING AND CURRENT ROW), 4) AS week FROM x)
  SELECT measurement_id, CASE WHEN subject IN ('click', 'view') THEN day ELSE week END AS total FROM w""")
def _per_rule(spark, sf_dir):
    records = B.mixed_records(spark, sf_dir)
    length = F.when(F.col("subject").isin("click", "view"), 86_400).otherwise(604_800)
    got = H.rule_window_stats(records.withColumns({"seconds": length, "metric": F.lit("x")}), records)
    return got.select("measurement_id", F.round("sum_value", 4).alias("total"))


@B.query("win_other_history", f"""WITH {_X_SQL}
  SELECT c.measurement_id, count(h.ts) AS n, round(sum(h.x), 4) AS total, max(h.x) AS peak FROM x c
  LEFT JOIN x h ON h.user_id = c.user_id AND h.subject = 'view' AND h.ts <= c.ts AND h.ts > c.ts - to_microseconds({_S * 10**6})
  WHERE c.subject = 'click' GROUP BY 1""")
def _other(spark, sf_dir):
    records = B.mixed_records(spark, sf_dir)
    clicks = records.filter("subject = 'click'")
    views = records.filter("subject = 'view'")
    got = H.window_stats(clicks, views, seconds=_S, path="x", keys=["tenant_id"])
    return got.select("measurement_id", F.col("count").alias("n"), F.round("sum_value", 4).alias("total"),
                      F.col("max_value").alias("peak"))


@B.query("since_last", f"""WITH r AS ({B.RECORD_SQL})
  SELECT measurement_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, subject ORDER BY ts, event_id))) / 1000000.0, 3) AS seconds FROM r""")
def _since(spark, sf_dir):
    seen = H.last_seen(B.mixed_records(spark, sf_dir))
    return seen.select("measurement_id", F.round(H.elapsed_seconds(F.col("ts"), F.col("last_ts")), 3).alias("seconds"))


@B.query("last_seen_other", f"""WITH r AS ({B.RECORD_SQL}), p AS (SELECT * FROM r WHERE subject = 'purchase'), c AS (SELECT * FROM r WHERE subject = 'click')
  SELECT p.measurement_id, epoch_us(c.ts) AS last_us FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def _seen_other(spark, sf_dir):
    records = B.mixed_records(spark, sf_dir)
    got = H.last_seen(records.filter("subject = 'purchase'").select("tenant_id", "measurement_id", "ts"),
                      records.filter("subject = 'click'").select("tenant_id", "ts"), keys=["tenant_id"])
    return got.select("measurement_id", V.micros(F.col("last_ts")).alias("last_us"))


_LAG_SQL = f"""r AS ({B.RECORD_SQL}), g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, subject ORDER BY ts, event_id)) AS gap FROM r)"""


def _full(spark, sf_dir, **rule):
    registry, rules = B.one_rule(spark, **rule)
    records = B.mixed_records(spark, sf_dir)
    return E.evaluate(R.route(records, registry, rules), records, needs=E.history_needs(rules)).select("measurement_id", "verdict")


B.register("debounce", lambda spark, sf: _full(spark, sf, operator="debounce", seconds=86_400), f"""WITH {_LAG_SQL}
  SELECT measurement_id, CASE WHEN gap IS NULL OR gap > 86400000000 THEN 'CLEAR' ELSE 'DISCRETIONARY' END AS verdict FROM g""")
B.register("since_last_rule", lambda spark, sf: _full(spark, sf, operator="since_last", value_seconds=172_800.0), f"""WITH {_LAG_SQL}
  SELECT measurement_id, CASE WHEN gap IS NULL THEN 'NULL_UNMAPPED' WHEN gap >= 172800000000 THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM g""")
B.register("null_stale", lambda spark, sf: _full(spark, sf, operator="lte", metric="x", value="30", fresh_seconds=_S), f"""WITH {_LAG_SQL}
  SELECT measurement_id, CASE WHEN gap IS NULL OR gap > {_S * 10**6} THEN 'NULL_STALE' WHEN m = 7 THEN 'NULL_UNMAPPED'
    WHEN m = 9 THEN 'DISCRETIONARY' WHEN (CASE WHEN m = 5 THEN 1.0 ELSE v END) <= 30 THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM g""")
B.register("win_sum_rule", lambda spark, sf: _full(spark, sf, operator="window_sum", metric="x", seconds=_S, cmp_op="lt", value="50"),
           f"""WITH {_X_SQL}, w AS (SELECT measurement_id, sum(x) OVER {_HALF} AS total FROM x)
  SELECT measurement_id, CASE WHEN total IS NULL THEN 'NULL_UNMAPPED' WHEN total < 50 THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM w""")


@B.query("win_compare", f"""WITH {_X_SQL}, w AS (SELECT measurement_id, event_id % 7 AS c, count(*) OVER {_HALF} AS n FROM x)
  SELECT measurement_id, CASE WHEN c IN (5, 6) THEN 'DISCRETIONARY' WHEN CASE c WHEN 0 THEN n <= 3 WHEN 1 THEN n < 3
    WHEN 2 THEN n >= 3 WHEN 3 THEN n > 3 ELSE n = 3 END THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM w""")
def _win_compare(spark, sf_dir):
    codes = F.element_at(F.array(*[F.lit(c) for c in ("lte", "lt", "gte", "gt", "eq", "near", "LTE")]),
                         (F.col("event_id") % 7 + 1).cast("int"))
    records = B.mixed_records(spark, sf_dir)
    rows = _stats(spark, sf_dir).join(records.select("measurement_id", "event_id"), "measurement_id").withColumn("cmp", codes)
    n = F.col("count").cast("double")
    out = P.compare_decision(rule_id=F.lit("r1"), cmp=F.col("cmp"), observed=n, target=F.lit(3.0), label=F.lit("count"),
                             observed_text=V.float_text(n), target_text=F.lit("3.0"))
    return rows.select("measurement_id", out["verdict"].alias("verdict"))


@B.query("rule_verdicts", f"""WITH {B._SEEN_SQL} SELECT coalesce(rule_id, 'none') AS rule_id, verdict, count(*) AS n_records FROM decided GROUP BY 1, 2""")
def _rule_verdicts(spark, sf_dir):
    registry, rules = B.ledger_rules(spark)
    records = B.mixed_records(spark, sf_dir)
    return E.evaluate(R.route(records, registry, rules), records, needs=E.history_needs(rules)).groupBy(
        F.coalesce("rule_id", F.lit("none")).alias("rule_id"), "verdict").agg(F.count(F.lit(1)).alias("n_records"))


@B.query("rules_without_history", """
  SELECT verdict, count(*) AS n_records FROM (SELECT CASE WHEN event_type = 'click' THEN 'DISCRETIONARY'
    WHEN event_type = 'view' THEN 'DISCRETIONARY' WHEN event_type = 'error' THEN 'CLEAR' ELSE 'NULL_UNMAPPED' END AS verdict FROM events) GROUP BY 1""")
def _blind(spark, sf_dir):
    from rulegauge.session import literal_frame
    rules = rules_frame(spark, [
        dict(rule_id="w", operator="window_count", seconds=60, value="5"),
        dict(rule_id="f", operator="lte", metric="k", value="200", fresh_seconds=60),
        dict(rule_id="s", operator="lte", metric="k", value="200")])
    registry = literal_frame(spark, [("click", "w", 0), ("view", "f", 1), ("error", "s", 2)], B.REGISTRY_SCHEMA)
    return E.evaluate(R.route(B.mixed_records(spark, sf_dir), registry, rules), None).groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n_records"))


@B.query("iso_parse", """
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN epoch_us(o_orderdate) WHEN 1 THEN epoch_us(o_orderdate) + 45296789000
    WHEN 2 THEN epoch_us(o_orderdate) + 45296000000 - 3600000000 * 2 END AS us FROM orders""")
def _iso(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = F.col("o_orderkey") % 5
    text = (F.when(n == 0, d).when(n == 1, F.concat(d, F.lit("T12:34:56.789Z"))).when(n == 2, F.concat(d, F.lit("T12:34:56+02:00")))
            .when(n == 3, F.concat(F.lit("due "), d)).otherwise(F.lit("2024-13-45")))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", V.micros(V.parse_iso(text)).alias("us"))
