"""Streaming queries: each drains what is available into a table and returns it. Batch SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.plans import base as B
from rulegauge.plans.obligations import STATEFUL, STATEFUL_SQL
from rulegauge.session import work_path
from rulegauge.sources.rulesets import rules_frame
from rulegauge.streaming import jobs as J
from rulegauge.streaming import verdicts as O


_WEEKS = ("ts < TIMESTAMP '2024-01-12'", "ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-20'", "ts >= TIMESTAMP '2024-01-20'")
_HALVES = ("timestamp_iso < '2024-01-12'", "timestamp_iso >= '2024-01-12'")


def _in_steps(spark, rows, parts, build, name, *, updates=False):
    """Feed ``rows`` part by part; the query stops after each part and resumes from its state. Returns the output path."""
    feed, out, state = (work_path(spark, f"{name}-{what}") for what in ("feed", "out", "state"))
    for part in parts:
        rows.filter(part).write.mode("append").parquet(feed)
        stream = build(J.read_parquet_stream(spark, feed, rows.schema))
        (J.advance_updates if updates else J.advance)(stream, out, state)
    return out if updates else spark.read.schema(stream.schema).parquet(out)


def _mixed(build):
    return lambda feed: build(B.envelope_of(feed, B.mixed_payload()))


@B.query("stream_stateless", f"""WITH {B._SEEN_SQL}, s AS (SELECT *, CASE subject WHEN 'signup' THEN 'NULL_UNMAPPED' WHEN 'purchase' THEN 'DISCRETIONARY' ELSE verdict END AS final FROM decided)
  SELECT measurement_id, final AS verdict FROM s""")
def _stateless(spark, sf_dir):
    """The ledger rules from the record alone; the gated one goes to a human (``stream_corrections`` decides such rules)."""
    registry, rules = B.ledger_rules(spark)
    return _in_steps(spark, B.events_of(spark, sf_dir), _WEEKS[:1] + ("ts >= TIMESTAMP '2024-01-12'",), _mixed(
        lambda r: J.stateless(r, registry, rules).select("measurement_id", "verdict")), "stateless")


@B.query("stream_window", f"""WITH r AS ({B.RECORD_SQL}), x AS (SELECT *, CASE WHEN m NOT IN (3, 5, 7, 9) THEN v END AS x FROM r)
  SELECT measurement_id, count(*) OVER w AS n, round(sum(x) OVER w, 4) AS total FROM x
  WINDOW w AS (PARTITION BY user_id, subject ORDER BY ts RANGE BETWEEN to_microseconds({432_000 * 10**6 - 1}) PRECEDING AND CURRENT ROW)""")
def _window(spark, sf_dir):
    got = _in_steps(spark, B.events_of(spark, sf_dir), _WEEKS, _mixed(
        lambda r: J.trailing_windows(r, seconds=432_000, path="x")), "window")
    return got.select("measurement_id", F.col("count").alias("n"), F.round(F.nanvl("sum_value", F.lit(None)), 4).alias("total"))


@B.query("stream_debounce", f"""WITH r AS ({B.RECORD_SQL}), g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, subject ORDER BY ts, event_id)) AS gap FROM r)
  SELECT measurement_id, CASE WHEN gap IS NULL OR gap > 86400000000 THEN 'CLEAR' ELSE 'DISCRETIONARY' END AS verdict FROM g""")
def _debounce(spark, sf_dir):
    return _in_steps(spark, B.events_of(spark, sf_dir), _WEEKS, _mixed(
        lambda r: J.debounce(r, seconds=86_400).select("measurement_id", "verdict")), "debounce")


@B.query("stream_ledger", f"""WITH RECURSIVE {B.CHAIN_SQL} SELECT tenant_id, seq AS sequence_number, telemetry_id, entry_hash FROM ledger""")
def _ledger(spark, sf_dir):
    """The decided entries as a stream give the chain that the batch build gives."""
    got = _in_steps(spark, B.decided_table(spark, sf_dir), _HALVES, J.append_chain, "chain")
    return got.select("tenant_id", "sequence_number", "telemetry_id", "entry_hash")


@B.query("stream_agreement", f"""WITH {B.LEDGER_SQL}, w AS (SELECT telemetry_id AS entry_id, count(*) OVER w AS observed, count(*) FILTER (WHERE verifier_status = 'AGREED') OVER w AS agreed
    FROM numbered WINDOW w AS (PARTITION BY tenant_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
  SELECT entry_id, observed, round(agreed / observed, 6) AS agreement_rate FROM w""")
def _agreement(spark, sf_dir):
    entries = B.entries_table(spark, sf_dir).withColumn("entry_id", F.col("telemetry_id"))
    got = _in_steps(spark, entries, _HALVES, lambda feed: J.agreement(feed, n=100), "agreement")
    return got.select("entry_id", "observed", F.round("agreement_rate", 6).alias("agreement_rate"))


@B.query("stream_silence", f"""WITH r AS ({B.RECORD_SQL}), g AS (SELECT subject, epoch_us(ts) AS from_us, epoch_us(lead(ts) OVER (PARTITION BY subject ORDER BY ts)) AS next_us FROM r)
  SELECT subject, from_us FROM g WHERE next_us - from_us > 3600000000""")
def _silence(spark, sf_dir):
    got = _in_steps(spark, B.events_of(spark, sf_dir), _WEEKS, _mixed(
        lambda r: J.silence(r, seconds=3600, key="subject")), "silence").select("subject", F.col("silent_from_us").alias("from_us"))
    # a source's last record may still be waiting for its timer or already be told; only closed silences count here
    newest = B.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("subject")).agg(
        F.max(V.micros(F.col("ts"))).alias("last_us"))
    return got.join(newest, "subject").filter("from_us < last_us").select("subject", "from_us")


@B.query("stream_late", f"""WITH r AS ({B.RECORD_SQL}), f AS (SELECT *, event_id % 10 = 3 AS second FROM r),
  n AS (SELECT user_id, subject, max(epoch_us(ts)) AS newest_us FROM f WHERE NOT second GROUP BY 1, 2)
  SELECT measurement_id, CASE WHEN second AND newest_us > epoch_us(ts) THEN round((newest_us - epoch_us(ts)) / 1000000.0, 3) ELSE 0.0 END::DOUBLE AS behind_seconds,
    second AND coalesce(newest_us - epoch_us(ts) > 86400000000, false) AS to_replay FROM f LEFT JOIN n USING (user_id, subject)""")
def _late(spark, sf_dir):
    got = _in_steps(spark, B.events_of(spark, sf_dir), ("event_id % 10 <> 3", "event_id % 10 = 3"), _mixed(
        lambda r: J.lateness(r, allowed_seconds=86_400)), "late")
    return got.select("measurement_id", F.round("behind_seconds", 3).alias("behind_seconds"), "to_replay")


@B.query("stream_daily", f"""WITH {B._SEEN_SQL}, s AS (SELECT *, CASE subject WHEN 'signup' THEN 'NULL_UNMAPPED' WHEN 'purchase' THEN 'DISCRETIONARY' ELSE verdict END AS final FROM decided)
  SELECT epoch_us(date_trunc('day', ts)) AS day_us, final AS verdict, count(*) AS n_entries FROM s GROUP BY 1, 2""")
def _daily(spark, sf_dir):
    registry, rules = B.ledger_rules(spark)
    out = _in_steps(spark, B.events_of(spark, sf_dir), _WEEKS, _mixed(
        lambda r: J.daily_counts(J.stateless(r, registry, rules).select("ts", "verdict"))), "daily", updates=True)
    got = J.latest_updates(spark, out, ["day", "verdict"])
    return got.select(V.micros(F.col("day")).alias("day_us"), "verdict", "n_entries")


# ---- rules over history, online ---------------------------------------------------------------------------

def _online(spark, rows, parts, decider, payload, name, initial=None):
    """Feed ``rows`` (events) part by part through the online verdicts; returns the path of the answers."""
    feed, out, past, state = (work_path(spark, f"{name}-{what}") for what in ("feed", "out", "history", "state"))
    for part in parts:
        rows.filter(part).write.mode("append").parquet(feed)
        records = B.envelope_of(J.read_parquet_stream(spark, feed, rows.schema), payload)
        O.run(records, decider, out, history=past, state=state, initial=initial)
    return out


@B.query("stream_verdicts", STATEFUL_SQL)
def _verdicts(spark, sf_dir):
    """All obligations online, state started from the first week's history: what ``verdict_all_stateful`` gives."""
    from rulegauge.operators import envelope as E
    from rulegauge.operators import history as H
    events, rules = B.events_of(spark, sf_dir), rules_frame(spark, STATEFUL)
    week = B.envelope_of(events.filter(_WEEKS[0]), B.metric_payload())
    before = E.verdict_all(week, rules, history=week.select(*H.SUBJECT, "measurement_id", "ts", "measurement"))
    out = _online(spark, events, _WEEKS[1:], O.AllObligations(rules), B.metric_payload(), "verdicts", week)
    columns = ["measurement_id", "n_mapped", "verdict"]
    return O.current(spark, out).select(*columns).unionByName(before.select(*columns))


_ONLINE_RULES = [
    dict(rule_id="o.click", metric="x", operator="window_sum", seconds=432_000, cmp_op="lt", value="50"),
    dict(rule_id="o.view", operator="debounce", seconds=86_400),
    dict(rule_id="o.error", operator="since_last", value_seconds=172_800.0),
    dict(rule_id="o.purchase", metric="x", operator="gte", value="5", fresh_seconds=432_000),
]


@B.query("stream_corrections", f"""WITH r AS ({B.RECORD_SQL}),
  g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, subject ORDER BY ts, event_id::VARCHAR)) AS gap,
      sum(CASE WHEN m NOT IN (3, 5, 7, 9) THEN v END) OVER (PARTITION BY user_id, subject ORDER BY ts
        RANGE BETWEEN to_microseconds({432_000 * 10**6 - 1}) PRECEDING AND CURRENT ROW) AS total FROM r)
  SELECT measurement_id, CASE subject
    WHEN 'click' THEN CASE WHEN total IS NULL THEN 'NULL_UNMAPPED' WHEN total < 50 THEN 'CLEAR' ELSE 'FLAG' END
    WHEN 'view' THEN CASE WHEN gap IS NULL OR gap > 86400000000 THEN 'CLEAR' ELSE 'DISCRETIONARY' END
    WHEN 'error' THEN CASE WHEN gap IS NULL THEN 'NULL_UNMAPPED' WHEN gap >= 172800000000 THEN 'CLEAR' ELSE 'FLAG' END
    WHEN 'purchase' THEN CASE WHEN gap IS NULL OR gap > 432000000000 THEN 'NULL_STALE' WHEN m = 7 THEN 'NULL_UNMAPPED'
      WHEN m = 9 THEN 'DISCRETIONARY' WHEN (CASE WHEN m = 5 THEN 1.0 ELSE v END) >= 5 THEN 'CLEAR' ELSE 'FLAG' END
    ELSE 'NULL_UNMAPPED' END AS verdict FROM g""")
def _corrections(spark, sf_dir):
    """A tenth of the records comes late, by seconds, hours or days; the answers end as if none had."""
    from rulegauge.session import literal_frame
    events = B.events_of(spark, sf_dir)
    delay = F.when(F.col("event_id") % 10 == 3, F.element_at(F.array(F.lit(30), F.lit(5 * 3600), F.lit(5 * 86_400)), (F.floor(F.col("event_id") / 10) % 3 + 1).cast("int"))).otherwise(0)
    arrived = F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + delay)
    registry = literal_frame(spark, [("click", "o.click", 0), ("view", "o.view", 1), ("error", "o.error", 2), ("purchase", "o.purchase", 3)], B.REGISTRY_SCHEMA)
    rows = events.withColumn("arrived", arrived)
    parts = [w.replace("ts", "arrived") for w in ("ts < TIMESTAMP '2024-01-09'", "ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-17'", "ts >= TIMESTAMP '2024-01-17'")]
    out = _online(spark, rows, parts, O.OneRule(registry, rules_frame(spark, _ONLINE_RULES)), B.mixed_payload(), "corrections")
    return O.current(spark, out).select("measurement_id", "verdict")
