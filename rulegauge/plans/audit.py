"""Queries over replay, rolling agreement, latency buckets and alert conditions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.operators import ledger as L
from rulegauge.operators import monitor as M
from rulegauge.operators import replay as Y
from rulegauge.plans import base as B
from rulegauge.session import literal_frame

# ---- replay ---------------------------------------------------------------------------------------------
# The stored ledger against a registry that moved "view" and a history without every nineteenth record; entry
# verdicts of every twenty-third event were altered.

def _history(spark, sf_dir):
    """History rows under the ledger's own tenant names, some records missing."""
    rows = B.history_table(spark, sf_dir)
    n = F.split_part("telemetry_id", F.lit("-"), F.lit(2)).cast("bigint")
    return rows.filter(n % 19 != 0)


def _entries(spark, sf_dir):
    """Entries booked per source tenant, with their payload hashes; some verdicts altered afterwards."""
    entries = B.decided_table(spark, sf_dir).drop("tenant_id")
    users = B.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tenant_id"))
    return entries.join(users, "event_id").withColumns({
        "verdict": F.when(F.col("event_id") % 23 == 0, "FLAG").otherwise(F.col("verdict")),
        "sequence_number": F.col("event_id") + 1})


_RANGE = (101, 1_000_000_000)
_ENTRIES_SQL = f"""{B.LEDGER_SQL},
  e AS (SELECT 't' || user_id AS tenant_id, event_id + 1 AS seq, event_id, telemetry_hash, rule_id, track, schema_version, subject, ts, m, v, k,
          verdict AS original, CASE WHEN event_id % 23 = 0 THEN 'FLAG' ELSE verdict END AS verdict FROM entries),
  h AS (SELECT tenant_id, telemetry_hash, event_id, subject, ts, original, rule_id FROM e WHERE event_id % 19 <> 0),
  latest AS (SELECT tenant_id, telemetry_hash, arg_max(event_id, ts) AS found FROM h GROUP BY 1, 2),
  chosen AS (SELECT e.*, l.found FROM e LEFT JOIN latest l USING (tenant_id, telemetry_hash) WHERE seq BETWEEN {_RANGE[0]} AND {_RANGE[1]}),
  skips AS (SELECT *, CASE WHEN coalesce(schema_version, '0.1.0') = '0.1.0' THEN 'pre_buffer_version' WHEN track = 'llm' THEN 'model_track'
      WHEN found IS NULL THEN 'record_missing' END AS skip_reason FROM chosen)"""


@B.query("replay_range", f"WITH {B.LEDGER_SQL} SELECT tenant_id, seq AS sequence_number FROM numbered WHERE seq BETWEEN 20 AND 60")
def _range(spark, sf_dir):
    return Y.replay_range(B.entries_table(spark, sf_dir), 20, 60).select("tenant_id", "sequence_number")


@B.query("replay_fetch", f"WITH {_ENTRIES_SQL} SELECT tenant_id, seq AS sequence_number, 'ev-' || found AS found FROM chosen")
def _fetch(spark, sf_dir):
    got = Y.fetch(Y.replay_range(_entries(spark, sf_dir), *_RANGE), _history(spark, sf_dir))
    return got.select("tenant_id", "sequence_number", F.col("record.telemetry_id").alias("found"))


@B.query("replay_skips", f"""WITH {_ENTRIES_SQL} SELECT coalesce(skip_reason, 'none') AS skip_reason, count(*) AS n_entries FROM skips GROUP BY 1""")
def _skips(spark, sf_dir):
    got = Y.skip_reason(Y.fetch(Y.replay_range(_entries(spark, sf_dir), *_RANGE), _history(spark, sf_dir)))
    return got.groupBy(F.coalesce("skip_reason", F.lit("none")).alias("skip_reason")).agg(F.count(F.lit(1)).alias("n_entries"))


def _replayed(spark, sf_dir):
    """The rule set lost the freshness gate and 'view' now goes to the click rule."""
    from rulegauge.sources.rulesets import rules_frame
    rules = rules_frame(spark, [{k: v for k, v in r.items() if k != "fresh_seconds"} for r in B.LEDGER_RULES])
    registry = literal_frame(spark, [("Click", "r.click", 0), ("view", "r.click", 1), ("error", "r.error", 2),
                                     ("purchase", "r.purchase", 3)], B.REGISTRY_SCHEMA)
    return Y.replay(_entries(spark, sf_dir), _history(spark, sf_dir), registry, rules, *_RANGE)


# found records carry the same payload as the entry, so the replayed verdict follows from the entry's own reading
_OUTCOME_SQL = f"""{_ENTRIES_SQL},
  told AS (SELECT s.*, f.subject AS f_subject FROM skips s LEFT JOIN e f ON f.event_id = s.found),
  again AS (SELECT *, CASE f_subject WHEN 'click' THEN 'r.click' WHEN 'view' THEN 'r.click' WHEN 'error' THEN 'r.error' WHEN 'purchase' THEN 'r.purchase' END AS new_rule,
      CASE WHEN f_subject = 'error' THEN CASE WHEN k % 2 = 0 THEN 'CLEAR' ELSE 'FLAG' END WHEN m = 7 THEN 'NULL_UNMAPPED' WHEN m = 9 THEN 'DISCRETIONARY'
           WHEN f_subject = 'purchase' THEN CASE WHEN (CASE WHEN m = 5 THEN 1.0 ELSE v END) >= 5 THEN 'CLEAR' ELSE 'FLAG' END
           ELSE CASE WHEN (CASE WHEN m = 5 THEN 1.0 ELSE v END) <= 40 THEN 'CLEAR' ELSE 'FLAG' END END AS new_verdict FROM told),
  outcomes AS (SELECT tenant_id, seq, rule_id, verdict, CASE WHEN skip_reason IS NOT NULL THEN 'skipped'
      WHEN new_rule IS NULL OR rule_id IS DISTINCT FROM new_rule THEN 'mismatched' WHEN new_verdict <> verdict THEN 'mismatched' ELSE 'matched' END AS outcome,
      coalesce(skip_reason, CASE WHEN new_rule IS NULL OR rule_id IS DISTINCT FROM new_rule THEN 'tag_registry_divergence'
        WHEN new_verdict <> verdict THEN 'verdict_divergence' END) AS reason FROM again)"""


@B.query("replay_routing", f"WITH {_OUTCOME_SQL} SELECT tenant_id, seq AS sequence_number FROM outcomes WHERE reason = 'tag_registry_divergence'")
def _routing(spark, sf_dir):
    return _replayed(spark, sf_dir).filter("reason = 'tag_registry_divergence'").select("tenant_id", "sequence_number")


@B.query("replay_verdicts", f"WITH {_OUTCOME_SQL} SELECT tenant_id, seq AS sequence_number, outcome, reason FROM outcomes")
def _verdicts(spark, sf_dir):
    return _replayed(spark, sf_dir).select("tenant_id", "sequence_number", "outcome", "reason")


@B.query("replay_report", f"""WITH {_OUTCOME_SQL} SELECT count(*) AS total_entries, count(*) FILTER (WHERE outcome <> 'skipped') AS replayed_entries,
  count(*) FILTER (WHERE outcome = 'skipped') AS skipped_entries, count(*) FILTER (WHERE outcome = 'matched') AS matched_entries,
  count(*) FILTER (WHERE outcome = 'mismatched') AS mismatched_entries, count(*) FILTER (WHERE outcome = 'mismatched') = 0 AS is_clean FROM outcomes""")
def _report(spark, sf_dir):
    return Y.replay_report(_replayed(spark, sf_dir))


# ---- monitoring -------------------------------------------------------------------------------------------

@B.query("agreement_rolling", f"""WITH {B.LEDGER_SQL}, w AS (SELECT telemetry_id AS entry_id, count(*) OVER w AS observed,
    count(*) FILTER (WHERE verifier_status = 'AGREED') OVER w AS agreed, count(*) FILTER (WHERE verifier_status = 'LLM_CONTRADICTION') OVER w AS llm_contradiction
    FROM numbered WINDOW w AS (PARTITION BY tenant_id ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
  SELECT entry_id, observed, agreed, llm_contradiction, round(agreed / observed, 6) AS agreement_rate, agreed / observed >= 0.78 AS is_healthy FROM w""")
def _agreement(spark, sf_dir):
    entries = B.entries_table(spark, sf_dir).withColumn("entry_id", F.col("telemetry_id"))
    got = M.agreement(entries, n=100, threshold=0.78, index="sequence_number")
    return got.select("entry_id", "observed", "agreed", "llm_contradiction", F.round("agreement_rate", 6).alias("agreement_rate"), "is_healthy")


@B.query("agreement_unnumbered", f"""WITH r AS ({B.RECORD_SQL}), w AS (SELECT measurement_id AS entry_id, count(*) OVER w AS observed,
    count(*) FILTER (WHERE event_id % 13 > 2) OVER w AS agreed FROM r WINDOW w AS (PARTITION BY subject ORDER BY ts, measurement_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW))
  SELECT entry_id, observed, agreed FROM w""")
def _agreement_plain(spark, sf_dir):
    n = F.col("event_id") % 13
    rows = B.mixed_records(spark, sf_dir).select(
        F.col("measurement_id").alias("entry_id"), "subject", "ts",
        F.when(n == 0, "LLM_CONTRADICTION").when(n == 1, "NEURO_SYMBOLIC_DIVERGENCE").when(n == 2, "UNVERIFIABLE").otherwise("AGREED")
        .alias("verifier_status"))
    return M.agreement(rows, n=1000, keys=("subject",), order=("ts", "entry_id")).select("entry_id", "observed", "agreed")


@B.query("verdict_counters", f"WITH {B.LEDGER_SQL} SELECT verdict, count(*) AS total FROM numbered GROUP BY 1")
def _counters(spark, sf_dir):
    return M.verdict_counters(B.entries_table(spark, sf_dir))


_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in (*M.LATENCY_BUCKETS,)) + ", ('Infinity'::DOUBLE)"


@B.query("latency_histogram", f"""SELECT CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, event_type, count(*) FILTER (WHERE value / 10.0 <= le) AS samples
  FROM events, (VALUES {_BOUNDS}) b(le) GROUP BY 1, 2""")
def _histogram(spark, sf_dir):
    samples = B.table(spark, sf_dir, "events").select("event_type", (F.col("value") / 10.0).alias("seconds"))
    got = M.latency_histogram(samples, "seconds", keys=("event_type",))
    return got.select(F.when(F.col("le") == float("inf"), "+Inf").otherwise(V.float_text(F.col("le"))).alias("le"), "event_type", "samples")


@B.query("alert_agreement", f"""WITH r AS ({B.RECORD_SQL}), s AS (SELECT *, v < 30 AS low FROM r),
  n AS (SELECT *, max(CASE WHEN NOT low THEN epoch_us(ts) END) OVER (PARTITION BY tenant_id ORDER BY ts) AS healthy_us FROM s),
  runs AS (SELECT tenant_id, min(epoch_us(ts)) AS from_us, max(epoch_us(ts)) AS to_us, count(*) AS n_samples FROM n WHERE low GROUP BY tenant_id, healthy_us)
  SELECT tenant_id, from_us, to_us, from_us + 86400000000 AS fires_us, n_samples FROM runs WHERE to_us - from_us >= 86400000000""")
def _alert_agreement(spark, sf_dir):
    got = M.sustained_low(B.mixed_records(spark, sf_dir), value="value", threshold=30, for_seconds=86_400, keys=["tenant_id"],
                          id_col="measurement_id")
    return got.select("tenant_id", V.micros(F.col("started_at")).alias("from_us"), V.micros(F.col("last_seen_at")).alias("to_us"),
                      V.micros(F.col("fires_at")).alias("fires_us"), "n_samples")


@B.query("alert_seq_gap", f"""WITH {B.LEDGER_SQL}, kept AS (SELECT *, seq - lag(seq, 1, 0) OVER (PARTITION BY tenant_id ORDER BY seq) - 1 AS missing
    FROM numbered WHERE seq % 41 NOT IN (7, 8))
  SELECT telemetry_id, count(*) FILTER (WHERE missing <> 0) OVER w AS gaps, count(*) FILTER (WHERE missing <> 0) OVER w > 0 AS firing FROM kept
  WINDOW w AS (PARTITION BY tenant_id ORDER BY ts RANGE BETWEEN to_microseconds({43_200 * 10**6 - 1}) PRECEDING AND CURRENT ROW)""")
def _alert_gap(spark, sf_dir):
    kept = B.entries_table(spark, sf_dir).filter("sequence_number % 41 NOT IN (7, 8)").withColumn("ts", F.col("timestamp"))
    gaps = L.sequence_gaps(kept, tile=64).withColumn("ts", V.parse_iso(F.col("timestamp_iso")))
    return M.recent_gaps(gaps, kept, keys=["tenant_id"], id_col="telemetry_id", seconds=43_200)


@B.query("alert_silence", f"""WITH r AS ({B.RECORD_SQL}), g AS (SELECT subject, epoch_us(lag(ts) OVER (PARTITION BY subject ORDER BY ts, measurement_id)) AS from_us,
    epoch_us(ts) AS to_us FROM r)
  SELECT subject, from_us, to_us, round((to_us - from_us) / 1000000.0, 3) AS silent_seconds FROM g WHERE to_us - from_us > 3600000000""")
def _alert_silence(spark, sf_dir):
    got = M.silences(B.mixed_records(spark, sf_dir), keys=["subject"], id_col="measurement_id", seconds=3600)
    return got.select("subject", V.micros(F.col("silent_from")).alias("from_us"), V.micros(F.col("silent_to")).alias("to_us"),
                      F.round("silent_seconds", 3).alias("silent_seconds"))
