"""Queries over the hash-chained ledger and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.operators import ledger as L
from rulegauge.operators import reports as R
from rulegauge.plans import base as B
from rulegauge.session import work_path
from rulegauge.sources import history as S

_REC = "WITH RECURSIVE "


@B.query("ledger_build", f"""{_REC}{B.CHAIN_SQL}
  SELECT tenant_id, seq AS sequence_number, telemetry_id, previous_hash, entry_hash FROM ledger""")
def _build(spark, sf_dir):
    built = L.build_chain(B.decided_table(spark, sf_dir))
    return built.select("tenant_id", "sequence_number", "telemetry_id", "previous_hash", "entry_hash")


@B.query("ledger_continue", f"""{_REC}{B.CHAIN_SQL}
  SELECT tenant_id, seq AS sequence_number, entry_hash FROM ledger""")
def _continue(spark, sf_dir):
    """Two appends give the same chain as one: the first half of January, then the rest on its heads."""
    entries = B.decided_table(spark, sf_dir)
    first = L.build_chain(entries.filter("timestamp_iso < '2024-01-15'"))
    rest = L.build_chain(entries.filter("timestamp_iso >= '2024-01-15'"), heads=L.heads_of(first))
    return first.unionByName(rest).select("tenant_id", "sequence_number", "entry_hash")


@B.query("entry_hash", f"""{_REC}{B.CHAIN_SQL}
  SELECT tenant_id, seq AS sequence_number, entry_hash AS recomputed FROM ledger""")
def _entry_hash(spark, sf_dir):
    return B.ledger_table(spark, sf_dir).select("tenant_id", "sequence_number", L.entry_hash().alias("recomputed"))


@B.query("measurement_hash", f"WITH r AS ({B.RECORD_SQL}) SELECT measurement_id, sha256({B.MIXED_JSON_SQL}) AS hash FROM r")
def _measurement(spark, sf_dir):
    return B.mixed_records(spark, sf_dir).select("measurement_id", L.measurement_hash(F.col("measurement")).alias("hash"))


@B.query("envelope_hash", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'sha256:' || sha256('{"a":' || l_linenumber || ',"b":{"c":"é","d":[1,2.50]},"t":'
    || CAST(l_tax AS VARCHAR) || '}') AS hash FROM lineitem""")
def _envelope(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem")
    text = F.format_string('{ "t": %s, "b": {"d": [1, 2.50], "c": "\\u00e9"}, "a": %s}', F.col("l_tax").cast("string"),
                           F.col("l_linenumber"))
    # numbers stay as written except that 2.50 is re-read as 2.5 by a JSON round trip
    got = L.envelope_hash(text, exact=True)
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", got.alias("hash"))


B.ORACLES["envelope_hash"] = B.ORACLES["envelope_hash"].replace("2.50", "2.5")


@B.query("chain_linkage", f"""{_REC}{B.CHAIN_SQL}
  SELECT tenant_id, seq AS sequence_number, lag(entry_hash) OVER w AS expected_previous_hash,
         seq = 1 OR lag(entry_hash) OVER w = previous_hash AS chain_link_valid
  FROM ledger WHERE seq % 41 <> 7 WINDOW w AS (PARTITION BY tenant_id ORDER BY seq)""")
def _linkage(spark, sf_dir):
    kept = B.ledger_table(spark, sf_dir).filter("sequence_number % 41 <> 7")
    return L.chain_linkage(kept, tile=64).select("tenant_id", "sequence_number", "expected_previous_hash", "chain_link_valid")


# The ledger after tampering: rows removed, a verdict changed, a link cut, times swapped.
_TAMPERED_SQL = f"""{B.CHAIN_SQL},
  bad AS (SELECT tenant_id, seq, CASE WHEN seq % 53 = 5 THEN 'CLEAR' ELSE verdict END AS verdict,
      CASE WHEN seq % 67 = 9 THEN repeat('f', 64) ELSE previous_hash END AS previous_hash, entry_hash,
      CASE WHEN seq % 71 = 3 THEN '2023' || substr(timestamp_iso, 5) ELSE timestamp_iso END AS timestamp_iso,
      rule_id, kg_version, reasoning, track, telemetry_id, telemetry_hash
    FROM ledger WHERE seq % 41 <> 7),
  prior AS (SELECT *, lag(seq) OVER w AS p_seq, lag(entry_hash) OVER w AS p_hash, lag(timestamp_iso) OVER w AS p_time FROM bad
    WINDOW w AS (PARTITION BY tenant_id ORDER BY seq)),
  marked AS (SELECT *, seq <> coalesce(p_seq, 0) + 1 AS seq_gap, previous_hash <> coalesce(p_hash, repeat('0', 64)) AS link_broken,
      sha256({B.payload_sql("previous_hash", "seq")}) <> entry_hash AS hash_broken,
      coalesce(timestamp_iso < p_time, false) AS time_back FROM prior)"""


def tampered(spark, sf_dir):
    seq = F.col("sequence_number")
    return (B.ledger_table(spark, sf_dir).filter("sequence_number % 41 <> 7")
            .withColumn("verdict", F.when(seq % 53 == 5, "CLEAR").otherwise(F.col("verdict")))
            .withColumn("previous_hash", F.when(seq % 67 == 9, "f" * 64).otherwise(F.col("previous_hash")))
            .withColumn("timestamp_iso", F.when(seq % 71 == 3, F.concat(F.lit("2023"), F.substr("timestamp_iso", F.lit(5))))
                        .otherwise(F.col("timestamp_iso"))))


@B.query("ledger_verify", f"""{_REC}{_TAMPERED_SQL}
  SELECT tenant_id, count(*) AS total_entries, min(seq) AS first_sequence, max(seq) AS last_sequence,
    count(*) FILTER (WHERE seq_gap) = 0 AS chain_continuity, count(*) FILTER (WHERE NOT link_broken) AS chain_link_verified_count,
    count(*) FILTER (WHERE NOT hash_broken) AS entry_hash_verified_count, count(*) FILTER (WHERE time_back) = 0 AS timestamp_ordering,
    CAST(sum(seq_gap::INT + link_broken::INT + hash_broken::INT + time_back::INT) AS BIGINT) AS issue_count,
    sum(seq_gap::INT + link_broken::INT + hash_broken::INT + time_back::INT) = 0 AS is_valid FROM marked GROUP BY tenant_id""")
def _verify(spark, sf_dir):
    return L.verify_chain(tampered(spark, sf_dir), tile=64)


@B.query("ledger_verify_clean", f"""WITH {B.LEDGER_SQL}
  SELECT tenant_id, count(*) AS total_entries, CAST(0 AS BIGINT) AS issue_count, true AS is_valid FROM numbered GROUP BY 1""")
def _verify_clean(spark, sf_dir):
    return L.verify_chain(B.ledger_table(spark, sf_dir)).select("tenant_id", "total_entries", "issue_count", "is_valid")


@B.query("ledger_issues", f"""{_REC}{_TAMPERED_SQL}
  SELECT tenant_id, coalesce(p_seq, 0) + 1 AS sequence_number, 'SEQUENCE_GAP' AS issue_type FROM marked WHERE seq_gap
  UNION ALL SELECT tenant_id, seq, 'HASH_MISMATCH' FROM marked WHERE link_broken
  UNION ALL SELECT tenant_id, seq, 'ENTRY_HASH_MISMATCH' FROM marked WHERE hash_broken
  UNION ALL SELECT tenant_id, seq, 'TIMESTAMP_ORDER' FROM marked WHERE time_back""")
def _issues(spark, sf_dir):
    return L.chain_issues(tampered(spark, sf_dir), tile=64).select("tenant_id", "sequence_number", "issue_type")


@B.query("seq_gaps", f"""WITH {B.LEDGER_SQL}, kept AS (SELECT tenant_id, seq, seq - lag(seq, 1, 0) OVER (PARTITION BY tenant_id ORDER BY seq) - 1 AS missing
    FROM numbered WHERE seq % 41 NOT IN (7, 8))
  SELECT tenant_id, seq AS sequence_number, missing FROM kept WHERE missing <> 0""")
def _gaps(spark, sf_dir):
    kept = B.entries_table(spark, sf_dir).filter("sequence_number % 41 NOT IN (7, 8)")
    return L.sequence_gaps(kept, tile=64).select("tenant_id", "sequence_number", "missing")


@B.query("append_guard", f"""WITH {B.LEDGER_SQL}
  SELECT tenant_id, seq AS sequence_number, CASE WHEN seq % 50 = 1 THEN 'REMOVED' ELSE 'REWRITTEN' END AS change FROM numbered
  WHERE seq % 50 = 1 OR seq % 60 = 2""")
def _guard(spark, sf_dir):
    before = B.ledger_table(spark, sf_dir)
    after = before.filter("sequence_number % 50 <> 1").withColumn(
        "entry_hash", F.when(F.col("sequence_number") % 60 == 2, F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash")))
    return L.history_changes(before, after)


@B.query("ledger_append", f"WITH {B.LEDGER_SQL} SELECT tenant_id, count(*) AS n_entries, max(seq) AS head FROM numbered GROUP BY 1")
def _append(spark, sf_dir):
    path = work_path(spark, "stored")
    ledger = B.ledger_table(spark, sf_dir).drop("timestamp")
    L.append_ledger(ledger.filter("timestamp_iso < '2024-01-15'"), path)
    L.append_ledger(ledger.filter("timestamp_iso >= '2024-01-15'"), path)
    return L.read_ledger(spark, path).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_entries"),
                                                               F.max("sequence_number").alias("head"))


@B.query("ledger_zones", f"""WITH {B.LEDGER_SQL}, h AS (SELECT *, timestamp_iso >= '2024-01-15' AS second FROM numbered)
  SELECT tenant_id, second::INT AS part, min(seq) AS first_number, max(seq) AS last_number, count(*) AS n FROM h GROUP BY 1, 2""")
def _zones(spark, sf_dir):
    path = work_path(spark, "zoned")
    ledger = B.ledger_table(spark, sf_dir).drop("timestamp")
    L.append_ledger(ledger.filter("timestamp_iso < '2024-01-15'"), path)
    first = L.CommitLog(spark, path).commits()[0]
    L.append_ledger(ledger.filter("timestamp_iso >= '2024-01-15'"), path)
    return L.zones(spark, path).select("tenant_id", (F.col("commit") != first).cast("int").alias("part"), "first_number", "last_number", "n")


@B.query("ledger_constraints", f"""WITH {B.LEDGER_SQL}
  SELECT tenant_id, seq AS sequence_number, 'verdict' AS constraint_name FROM numbered WHERE seq % 40 = 1
  UNION ALL SELECT tenant_id, seq, 'verifier_status' FROM numbered WHERE seq % 45 = 2
  UNION ALL SELECT tenant_id, seq, 'track' FROM numbered WHERE seq % 50 = 3
  UNION ALL SELECT tenant_id, seq, 'unique_sequence_number' FROM numbered WHERE seq % 60 = 4
  UNION ALL SELECT tenant_id, seq, 'unique_entry_hash' FROM numbered WHERE seq % 60 = 4""")
def _constraints(spark, sf_dir):
    seq = F.col("sequence_number")
    rows = (B.ledger_table(spark, sf_dir)
            .withColumn("verdict", F.when(seq % 40 == 1, "MAYBE").otherwise(F.col("verdict")))
            .withColumn("verifier_status", F.when(seq % 45 == 2, "FINE").otherwise(F.col("verifier_status")))
            .withColumn("track", F.when(seq % 50 == 3, "").otherwise(F.col("track"))))
    twice = rows.filter("sequence_number % 60 = 4").withColumns(
        {"verdict": F.lit("CLEAR"), "verifier_status": F.lit(None).cast("string"), "track": F.lit(None).cast("string")})
    return L.constraint_issues(rows.unionByName(twice))


@B.query("transcript_hashes", """WITH t AS (SELECT conv_id, turn, text, conv_id * 8 + turn AS n FROM conversations)
  SELECT conv_id, turn, n % 5 <> 1 AND n % 7 <> 2 AS hashes_match,
    CASE WHEN n % 5 = 1 THEN 'sha256:' || repeat('0', 64) ELSE 'sha256:' || sha256(text) END AS request_hash FROM t""")
def _transcripts(spark, sf_dir):
    n = F.col("conv_id") * 8 + F.col("turn")
    response = F.to_json(F.struct(F.col("role").alias("z"), F.length("text").alias("a")))
    canonical = F.to_json(F.struct(F.length("text").alias("a"), F.col("role").alias("z")))
    rows = B.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("request"),
        F.when(n % 7 == 2, F.lit('{"a":0}')).otherwise(response).alias("response"),
        F.concat(F.lit("sha256:"), F.when(n % 5 == 1, "0" * 64).otherwise(F.sha2("text", 256))).alias("request_hash"),
        F.concat(F.lit("sha256:"), F.sha2(canonical, 256)).alias("response_hash"))
    return L.transcript_hashes(rows).select("conv_id", "turn", "hashes_match", "request_hash")


@B.query("schema_backfill", f"""WITH {B.LEDGER_SQL}
  SELECT coalesce(schema_version, '0.1.0') AS schema_version, count(*) AS n_entries FROM numbered GROUP BY 1""")
def _backfill(spark, sf_dir):
    return S.backfill_schema_version(B.entries_table(spark, sf_dir)).groupBy("schema_version").agg(F.count(F.lit(1)).alias("n_entries"))


# ---- reports ------------------------------------------------------------------------------------------

def _report(name, sql):
    return B.query(name, f"WITH {B.LEDGER_SQL} {sql}")


@_report("coverage_register", """SELECT tenant_id, seq AS sequence_number, verdict, telemetry_id, rule_id, reasoning FROM numbered
  WHERE verdict IN ('NULL_UNMAPPED', 'NULL_STALE')""")
def _coverage(spark, sf_dir):
    return R.coverage_register(B.entries_table(spark, sf_dir)).select(
        "tenant_id", "sequence_number", "verdict", "telemetry_id", "rule_id", "reasoning")


@_report("daily_summary", """SELECT epoch_us(date_trunc('day', ts)) AS day_us, verdict, count(*) AS n_entries,
  count(*) FILTER (WHERE escalation_status IS NOT NULL) AS escalated FROM numbered GROUP BY 1, 2""")
def _daily(spark, sf_dir):
    return R.daily_summary(B.entries_table(spark, sf_dir)).select(V.micros(F.col("day")).alias("day_us"), "verdict",
                                                                  "n_entries", "escalated")


@_report("verdict_distribution", "SELECT verdict, count(*) AS n_entries FROM numbered GROUP BY 1")
def _distribution(spark, sf_dir):
    return R.verdict_distribution(B.entries_table(spark, sf_dir))


_SUMMARY_SQL = "SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE verdict = '{v}') AS {v.lower()}" for v in R.VERDICTS) + ", " + ", ".join(
    f"coalesce(round(count(*) FILTER (WHERE verdict = '{v}') * 100.0::DOUBLE / nullif(count(*), 0), 6), 0.0::DOUBLE) AS {v.lower()}_percent"
    for v in R.VERDICTS) + " FROM numbered WHERE ts >= TIMESTAMP '{lo}' AND ts <= TIMESTAMP '{hi}'"


def _summary(spark, sf_dir, lo, hi):
    got = R.verdict_summary(B.entries_table(spark, sf_dir), lo, hi)
    return got.select(*[F.round(c, 6).alias(c) if c.endswith("_percent") else F.col(c) for c in got.columns])


for _name, _lo, _hi in (("verdict_summary", "2024-01-03", "2024-01-18"), ("verdict_summary_empty", "1990-01-01", "1990-02-01")):
    B.register(_name, lambda spark, sf, lo=_lo, hi=_hi: _summary(spark, sf, lo, hi),
               f"WITH {B.LEDGER_SQL} {_SUMMARY_SQL.replace('{lo}', _lo).replace('{hi}', _hi)}")


@_report("violations_by_rule", "SELECT rule_id, count(*) AS violations FROM numbered WHERE verdict = 'FLAG' AND ts >= TIMESTAMP '2024-01-03' GROUP BY 1")
def _by_rule(spark, sf_dir):
    return R.violations_by_rule(B.entries_table(spark, sf_dir), "2024-01-03")


@B.query("top_rules", """SELECT l_suppkey AS rule_id, count(*) AS violations FROM lineitem WHERE l_quantity > 45 GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 5""")
def _top(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("rule_id"), F.when(F.col("l_quantity") > 45, "FLAG").otherwise("CLEAR").alias("verdict"),
        F.col("l_shipdate").alias("timestamp"))
    return R.top_rules(lines)


@_report("violations_by_date", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS violations FROM numbered WHERE verdict = 'FLAG' GROUP BY 1")
def _by_date(spark, sf_dir):
    return R.violations_by_date(B.entries_table(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "violations")


@_report("uncovered_subjects", """SELECT subject, count(*) AS n_entries, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us
  FROM numbered WHERE verdict = 'NULL_UNMAPPED' GROUP BY 1""")
def _uncovered(spark, sf_dir):
    return R.uncovered_subjects(B.entries_table(spark, sf_dir)).select(
        "subject", "n_entries", V.micros(F.col("first_seen")).alias("first_us"), V.micros(F.col("last_seen")).alias("last_us"))
