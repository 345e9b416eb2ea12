"""Registry of queries, and the records, rules and ledgers they draw from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.operators import ledger as L
from rulegauge.operators import routing as R
from rulegauge.operators import rules as E
from rulegauge.session import apply_defaults, literal_frame, materialize
from rulegauge.sources.rulesets import rules_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered twice")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return fn(spark, sf_dir)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def wrap(fn):
        register(name, fn, sql)
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# ---- records ------------------------------------------------------------------------------------

def envelope_of(events: DataFrame, payload) -> DataFrame:
    """Events as measurement records with the given payload JSON text."""
    place = F.when(F.col("user_id") % 3 == 0, "us.federal").when(F.col("user_id") % 3 == 1, "ca.alberta")
    return events.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("measurement_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tenant_id"),
        F.col("event_type").alias("subject"), F.col("ts").cast("timestamp").alias("ts"),
        place.alias("jurisdiction"), F.try_parse_json(payload).alias("measurement"), "event_id", "user_id", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"))


RECORD_SQL = """
  SELECT 'ev-' || event_id AS measurement_id, 't' || user_id AS tenant_id, event_type AS subject, ts,
         CASE user_id % 3 WHEN 0 THEN 'us.federal' WHEN 1 THEN 'ca.alberta' END AS jurisdiction,
         event_id, user_id, value AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_id % 10 AS m
  FROM events"""


def _k_text():
    return F.get_json_object("props", "$.k")


def _by_shape(shapes: dict[int, object], default):
    out = default
    for shape, text in shapes.items():
        out = F.when(F.col("event_id") % 10 == shape, text).otherwise(out)
    return out


def shaped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten payload shapes of ``load``: with units, bare, as text, boolean, null, missing, without value."""
    v = F.col("value").cast("string")

    def text(pattern):
        return F.format_string(pattern, v)
    load = _by_shape({
        0: text('"load":{"value":%s,"unit":"ms"},'), 2: text('"load":{"value":%s,"unit":"sec"},'),
        3: text('"load":"%s",'), 4: F.lit(""), 5: F.lit('"load":true,'), 6: F.lit('"load":"n/a",'),
        7: F.lit('"load":null,'), 8: text('"load":{"value":"%s","unit":""},'), 9: text('"load":{"raw":%s},'),
    }, text('"load":%s,'))
    return envelope_of(events_of(spark, sf_dir), F.concat(F.lit("{"), load, F.lit('"k":'), _k_text(), F.lit("}")))


def mixed_payload():
    """``x`` mostly a number; text, boolean, null or object in four of ten records."""
    v = F.col("value").cast("string")
    x = _by_shape({3: F.concat(F.lit('"'), v, F.lit('"')), 5: F.lit("true"), 7: F.lit("null"),
                   9: F.concat(F.lit('{"raw":'), v, F.lit("}"))}, v)
    return F.concat(F.lit('{"x":'), x, F.lit(',"k":'), _k_text(), F.lit("}"))


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope_of(events_of(spark, sf_dir), mixed_payload())


def metric_payload():
    """Flat keys as the obligations name them: ``<event type>_v`` and ``k``."""
    return F.concat(F.lit('{"'), F.col("event_type"), F.lit('_v":'), F.col("value").cast("string"), F.lit(',"k":'),
                    _k_text(), F.lit("}"))


def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope_of(events_of(spark, sf_dir), metric_payload())


# ---- rule sets -----------------------------------------------------------------------------------

REGISTRY_SCHEMA = "subject string, rule_id string, ord int"
SUBJECTS = ("click", "view", "error", "purchase", "signup")


def one_rule(spark: SparkSession, **fields) -> tuple[DataFrame, DataFrame]:
    """(registry, rules) that send every subject to one rule."""
    rules = rules_frame(spark, [{"rule_id": "r1", **fields}])
    registry = literal_frame(spark, [(s, "r1", i) for i, s in enumerate(SUBJECTS)], REGISTRY_SCHEMA)
    return registry, rules


OBLIGATIONS = [
    dict(rule_id="ob.click.cap", metric="click_v", operator="must_not_exceed", value="100",
         jurisdiction='"us.federal"', effective_date="2024-01-05", risk_tier="standard"),
    dict(rule_id="ob.view.range", metric="view_v", operator="must_be_within", value="[5, 150]",
         jurisdiction='"global"', risk_tier="low"),
    dict(rule_id="ob.error.cap", metric="error_v", operator="must_be_below", value="80",
         jurisdiction='["US.Federal", "ca.alberta"]', risk_tier="high"),
    dict(rule_id="ob.purchase.min", metric="purchase_v", operator="must_be_at_least", value="10"),
    dict(rule_id="ob.purchase.cap", metric="purchase_v", operator="must_not_exceed", value="200",
         jurisdiction='"ca.alberta"', sunset_date="2024-01-20", risk_tier="low-risk"),
    dict(rule_id="ob.k.ban", metric="k", operator="must_not_be_one_of", value="[13, 66, 77]", jurisdiction='"*"',
         risk_tier="tier3"),
    dict(rule_id="ob.signup.floor", metric="signup_v", operator="must_be_above", value="1.5",
         jurisdiction='"us.federal"', effective_date="2024-01-15T12:00:00Z", sunset_date="2024-02-01T00:00:00Z"),
    dict(rule_id="ob.k.not50", metric="k", operator="must_not_equal", value="50", jurisdiction='""'),
    dict(rule_id="ob.click.future", metric="click_v", operator="must_not_exceed", value="10",
         effective_date="2030-01-01"),
    dict(rule_id="ob.view.text", metric="view_v", operator="must", value='"judge"', jurisdiction='"us.federal"',
         effective_date="not a date"),
    dict(rule_id="ob.click.wish", metric="click_v", operator="should", value="1", jurisdiction='["ca.alberta"]'),
]

# The same obligations for the SQL side: bounds, places and dates spelled out.
OBLIGATION_SQL = """
  SELECT * FROM (VALUES
    (1, 'ob.click.cap', 'click_v', 'must_not_exceed', NULL, 100.0, ['us.federal'], TIMESTAMP '2024-01-05', NULL, 2),
    (2, 'ob.view.range', 'view_v', 'must_be_within', 5.0, 150.0, ['*'], NULL, NULL, 3),
    (3, 'ob.error.cap', 'error_v', 'must_be_below', NULL, 80.0, ['us.federal', 'ca.alberta'], NULL, NULL, 1),
    (4, 'ob.purchase.min', 'purchase_v', 'must_be_at_least', 10.0, NULL, ['*'], NULL, NULL, 2),
    (5, 'ob.purchase.cap', 'purchase_v', 'must_not_exceed', NULL, 200.0, ['ca.alberta'], NULL, TIMESTAMP '2024-01-20', 3),
    (6, 'ob.k.ban', 'k', 'must_not_be_one_of', NULL, NULL, ['*'], NULL, NULL, 3),
    (7, 'ob.signup.floor', 'signup_v', 'must_be_above', 1.5, NULL, ['us.federal'], TIMESTAMP '2024-01-15 12:00:00', TIMESTAMP '2024-02-01', 2),
    (8, 'ob.k.not50', 'k', 'must_not_equal', NULL, NULL, ['*'], NULL, NULL, 2),
    (9, 'ob.click.future', 'click_v', 'must_not_exceed', NULL, 10.0, ['*'], TIMESTAMP '2030-01-01', NULL, 2),
    (10, 'ob.view.text', 'view_v', 'must', NULL, NULL, ['us.federal'], NULL, NULL, 2),
    (11, 'ob.click.wish', 'click_v', 'should', NULL, NULL, ['ca.alberta'], NULL, NULL, 2)
  ) o(ord, rule_id, metric, op, lo, hi, places, eff, sunset, tier)"""

# Records with the two readings, obligations in scope, and the check of each pair.
PAIRS_SQL = f"""
  r AS ({RECORD_SQL}), o AS ({OBLIGATION_SQL}),
  readings AS (SELECT r.*, subject || '_v' AS metric, v AS x FROM r UNION ALL
               SELECT r.*, 'k' AS metric, CAST(k AS DOUBLE) AS x FROM r),
  pairs AS (
    SELECT d.measurement_id, d.subject, d.jurisdiction, d.ts, d.x, o.ord, o.rule_id, o.metric, o.op, o.lo, o.hi, o.tier,
           CASE o.op WHEN 'must_not_exceed' THEN d.x <= o.hi WHEN 'must_be_within' THEN d.x BETWEEN o.lo AND o.hi
                     WHEN 'must_be_below' THEN d.x < o.hi WHEN 'must_be_at_least' THEN d.x >= o.lo
                     WHEN 'must_be_above' THEN d.x > o.lo WHEN 'must_not_be_one_of' THEN d.x NOT IN (13, 66, 77)
                     WHEN 'must_not_equal' THEN d.x <> 50 END AS ok
    FROM readings d JOIN o ON d.metric = o.metric
     AND (o.eff IS NULL OR o.eff <= d.ts) AND (o.sunset IS NULL OR o.sunset >= d.ts)
     AND (d.jurisdiction IS NULL OR list_contains(o.places, '*') OR list_contains(o.places, d.jurisdiction)))"""

SCOPE_SQL = f"""
  r AS ({RECORD_SQL}), o AS ({OBLIGATION_SQL}),
  scoped AS (
    SELECT r.measurement_id, r.ts, r.jurisdiction, o.* FROM r JOIN o
      ON (o.eff IS NULL OR o.eff <= r.ts) AND (o.sunset IS NULL OR o.sunset >= r.ts)
     AND (r.jurisdiction IS NULL OR list_contains(o.places, '*') OR list_contains(o.places, r.jurisdiction)))"""


def obligations(spark: SparkSession) -> DataFrame:
    return rules_frame(spark, OBLIGATIONS)


LEDGER_RULES = [
    dict(rule_id="r.click", metric="x", operator="lte", value="40"),
    dict(rule_id="r.view", metric="x", operator="range", low=2.0, high=60.0),
    dict(rule_id="r.error", metric="k", operator="in_set",
         value="[" + ",".join(str(i) for i in range(0, 100, 2)) + "]"),
    dict(rule_id="r.purchase", metric="x", operator="gte", value="5", fresh_seconds=432_000),
]
LEDGER_REGISTRY = [("Click", "r.click", 0), ("view", "r.view", 1), ("  ERROR ", "r.error", 2),
                   ("purchase", "r.purchase", 3)]


def ledger_rules(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    registry = literal_frame(spark, LEDGER_REGISTRY, REGISTRY_SCHEMA)
    return registry, rules_frame(spark, LEDGER_RULES)


# ---- the ledger the audit queries read --------------------------------------------------------------

def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One undecorated entry per event: decided by the ledger rules over the subjects' histories."""
    registry, rules = ledger_rules(spark)
    records, needs = mixed_records(spark, sf_dir), E.history_needs(rules)
    probes = E.record_before(records) if needs[1] else records
    decided = E.evaluate(R.route(probes, registry, rules), records, needs=needs)
    n, user = F.col("event_id"), F.col("user_id")
    status = (F.when(n % 13 == 0, "LLM_CONTRADICTION").when(n % 13 == 1, "NEURO_SYMBOLIC_DIVERGENCE")
              .when(n % 13 == 2, "UNVERIFIABLE").otherwise("AGREED"))
    return decided.select(
        F.when(user % 10 == 0, "t-hot").otherwise(F.concat(F.lit("t"), (user % 40).cast("string"))).alias("tenant_id"),
        V.iso_text(F.col("ts")).alias("timestamp_iso"), F.col("ts").alias("timestamp"), "verdict", "subject",
        F.col("measurement_id").alias("telemetry_id"), L.measurement_hash(F.col("measurement")).alias("telemetry_hash"),
        "rule_id", F.lit("kg-1").alias("kg_version"), F.lit("0.1.0").alias("model_version"),
        F.concat(F.coalesce("rule_id", F.lit("none")), F.lit(" → "), F.col("verdict")).alias("reasoning"),
        F.when(n % 11 == 0, "llm").otherwise("v3-evaluator").alias("track"), status.alias("verifier_status"),
        F.when((F.col("verdict") == "DISCRETIONARY") & (n % 2 == 0), "open").alias("escalation_status"),
        F.when(n % 17 != 0, "0.2.0").alias("schema_version"), "event_id")


# The x reading as a float parser sees it: text and booleans count, null and objects do not.
_SEEN_SQL = f"""
  r AS ({RECORD_SQL}),
  seen AS (SELECT *, CASE WHEN m IN (7, 9) THEN NULL WHEN m = 5 THEN 1.0 ELSE v END AS x,
                  lag(ts) OVER (PARTITION BY user_id, subject ORDER BY ts, event_id) AS last_ts FROM r),
  decided AS (SELECT *,
    CASE subject WHEN 'click' THEN 'r.click' WHEN 'view' THEN 'r.view' WHEN 'error' THEN 'r.error'
                 WHEN 'purchase' THEN 'r.purchase' END AS rule_id,
    CASE WHEN subject = 'signup' THEN 'NULL_UNMAPPED'
         WHEN subject = 'error' THEN CASE WHEN k % 2 = 0 THEN 'CLEAR' ELSE 'FLAG' END
         WHEN subject = 'purchase' AND (last_ts IS NULL OR epoch_us(ts) - epoch_us(last_ts) > 432000000000) THEN 'NULL_STALE'
         WHEN m = 7 THEN 'NULL_UNMAPPED' WHEN m = 9 THEN 'DISCRETIONARY'
         WHEN subject = 'click' THEN CASE WHEN x <= 40 THEN 'CLEAR' ELSE 'FLAG' END
         WHEN subject = 'view' THEN CASE WHEN x BETWEEN 2 AND 60 THEN 'CLEAR' ELSE 'FLAG' END
         ELSE CASE WHEN x >= 5 THEN 'CLEAR' ELSE 'FLAG' END END AS verdict
    FROM seen)"""

_NUMBER_TEXT_SQL = "CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END"
MIXED_JSON_SQL = (
    "'{\"k\":' || k || ',\"x\":' || CASE m WHEN 3 THEN '\"' || CAST(v AS VARCHAR) || '\"' WHEN 5 THEN 'true' "
    f"WHEN 7 THEN 'null' WHEN 9 THEN '{{\"raw\":' || {_NUMBER_TEXT_SQL} || '}}' ELSE {_NUMBER_TEXT_SQL} END || '}}'")

LEDGER_SQL = f"""{_SEEN_SQL},
  entries AS (SELECT
    CASE WHEN user_id % 10 = 0 THEN 't-hot' ELSE 't' || (user_id % 40) END AS tenant_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp_iso, ts, verdict, subject,
    measurement_id AS telemetry_id, sha256({MIXED_JSON_SQL}) AS telemetry_hash, rule_id, 'kg-1' AS kg_version,
    coalesce(rule_id, 'none') || ' → ' || verdict AS reasoning,
    CASE WHEN event_id % 11 = 0 THEN 'llm' ELSE 'v3-evaluator' END AS track,
    CASE event_id % 13 WHEN 0 THEN 'LLM_CONTRADICTION' WHEN 1 THEN 'NEURO_SYMBOLIC_DIVERGENCE'
                       WHEN 2 THEN 'UNVERIFIABLE' ELSE 'AGREED' END AS verifier_status,
    CASE WHEN verdict = 'DISCRETIONARY' AND event_id % 2 = 0 THEN 'open' END AS escalation_status,
    CASE WHEN event_id % 17 <> 0 THEN '0.2.0' END AS schema_version, event_id, user_id, m, v, k
    FROM decided),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY timestamp_iso, telemetry_id) AS seq
    FROM entries)"""

def payload_sql(prev: str, seq: str, verdict: str = "verdict") -> str:
    """Canonical entry text on the SQL side."""
    return (f"""'{{"kg_version":"' || kg_version || '","model_version":"0.1.0","previous_hash":"' || {prev} ||
  '","reasoning":"' || reasoning || '","rule_id":' || coalesce('"' || rule_id || '"', 'null') || ',"sequence_number":' ||
  {seq} || ',"telemetry_hash":"' || telemetry_hash || '","telemetry_id":"' || telemetry_id || '","timestamp":"' ||
  timestamp_iso || '","track":"' || track || '","verdict":"' || {verdict} || '"}}'""")


CHAIN_SQL = LEDGER_SQL + f""",
  chain AS (
    SELECT n.tenant_id, n.seq, repeat('0', 64) AS previous_hash,
           sha256({payload_sql("repeat('0', 64)", "n.seq")}) AS entry_hash FROM numbered n WHERE n.seq = 1
    UNION ALL
    SELECT n.tenant_id, n.seq, c.entry_hash, sha256({payload_sql("c.entry_hash", "n.seq")})
    FROM chain c JOIN numbered n ON n.tenant_id = c.tenant_id AND n.seq = c.seq + 1),
  ledger AS (SELECT n.*, c.previous_hash, c.entry_hash FROM numbered n JOIN chain c USING (tenant_id, seq))"""

_BUILT: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def decided_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided entries without a place, written once per session and scale: for what numbers them itself. Entries of no
    ledger have no place and are left out, as they are where entries are numbered."""
    return _once(spark, sf_dir, "decided", lambda: materialize(
        ledger_entries(spark, sf_dir).filter("tenant_id IS NOT NULL"), "decided"))


def entries_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided entries with their place in the ledger, written once per session and scale."""
    from rulegauge.operators.ordered import dense_index
    # written before they are numbered, so that the pass for the ranges does not decide them once more
    return _once(spark, sf_dir, "entries", lambda: materialize(dense_index(
        decided_table(spark, sf_dir), keys=["tenant_id"], order=["timestamp_iso", "telemetry_id"],
        name="sequence_number"), "entries"))


def ledger_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained ledger, written once per session and scale (by ``build_chain``); the audit queries read it."""
    return _once(spark, sf_dir, "ledger", lambda: L.build_chain(decided_table(spark, sf_dir)))


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry history of the same events, as a store would hold it."""
    from rulegauge.sources.history import history_rows
    rows = history_rows(mixed_records(spark, sf_dir))
    return rows.withColumn("payload", F.try_parse_json("measurement"))

