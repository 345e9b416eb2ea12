"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.operators import ledger as L
from rulegauge.operators import scoring as M
from rulegauge.plans import base as B
from rulegauge.session import work_path
from rulegauge.sources import history as S
from rulegauge.sources import rulesets as K
from rulegauge.sources import telemetry as T

# JSON lines as producers send them: good, broken, blank, not an object, pre-routed, without id or time.
_LINE_SQL = """
  l AS (SELECT event_id, event_id % 8 AS f, event_type, ts, value AS v FROM events),
  kept AS (SELECT * FROM l WHERE f <> 2)"""


def _lines(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.format_string('"subject":"%s","measurement":{"x":%s}', F.col("event_type"), F.col("value").cast("string"))
    ident = F.col("event_id").cast("string")
    full = F.format_string('{"id":"e%s","timestamp":"%sZ",%s}', ident, ts, body)
    line = (
        F.when(F.col("event_id") % 8 == 1, F.concat(F.lit("{broken "), ident))
        .when(F.col("event_id") % 8 == 2, F.lit("   "))
        .when(F.col("event_id") % 8 == 3, F.concat(F.lit("["), ident, F.lit("]")))
        .when(F.col("event_id") % 8 == 4, F.format_string('{"id":"e%s","rule_id":"r9",%s}', ident, body))
        .when(F.col("event_id") % 8 == 5, F.format_string('{"telemetry_id":"e%s","timestamp":"yesterday",%s}', ident, body))
        .when(F.col("event_id") % 8 == 6, F.format_string(
            '{"measurement_id":"e%s","timestamp":"%s+00:00","tenant_id":"acme","jurisdiction":"us.federal",%s}',
            ident, ts, body)).otherwise(full))
    return e.select("event_id", line.alias("line"))


@B.query("src_telemetry_parse", f"""WITH {_LINE_SQL}
  SELECT event_id, CASE f WHEN 1 THEN 'invalid_json' WHEN 3 THEN 'not_an_object' WHEN 4 THEN 'pre_routed' END AS reject_reason
  FROM kept""")
def _parse(spark, sf_dir):
    return T.parse_lines(_lines(spark, sf_dir)).select("event_id", "reject_reason")


@B.query("src_normalize", f"""WITH {_LINE_SQL}
  SELECT event_id, 'e' || event_id AS measurement_id, CASE WHEN f = 6 THEN 'acme' ELSE 'default' END AS tenant_id,
         event_type AS subject, CASE WHEN f <> 5 THEN epoch_us(ts) END AS ts_us,
         CASE WHEN f = 6 THEN 'us.federal' END AS jurisdiction, v AS x
  FROM kept WHERE f NOT IN (1, 3, 4)""")
def _normalize(spark, sf_dir):
    got = T.normalize(T.parse_lines(_lines(spark, sf_dir)))
    return got.select("event_id", "measurement_id", "tenant_id", "subject", V.micros(F.col("ts")).alias("ts_us"),
                      "jurisdiction", F.try_variant_get("measurement", F.lit("$.x"), "double").alias("x"))


@B.query("src_reject_prerouted", "SELECT event_id, 'pre_routed' AS reject_reason FROM events WHERE event_id % 8 = 4")
def _prerouted(spark, sf_dir):
    return T.parse_lines(_lines(spark, sf_dir)).filter("reject_reason = 'pre_routed'").select("event_id", "reject_reason")


def _documents(spark, sf_dir):
    """One flat rule document per part: two rules and two spellings of a subject; every tenth part has no rules."""
    p = B.table(spark, sf_dir, "part")
    text = F.format_string(
        '{"metadata":{"version":"v%s"},"rules":%s,"tag_registry":{"Part %s":"cap.%s","size %s":"size.%s"}}',
        F.col("p_size"),
        F.when(F.col("p_partkey") % 10 == 9, F.lit("[]")).otherwise(F.format_string(
            '[{"id":"cap.%s","metric":"price","predicate":"must_not_exceed","value":%s,"jurisdiction":["us.federal","global"]},'
            '{"id":"size.%s","predicate":{"operator":"range","metric":"size","min":1,"max":%s,"unit":"cm"},"risk_tier":"high"}]',
            F.col("p_partkey"), F.col("p_retailprice").cast("string"), F.col("p_partkey"), F.col("p_size"))),
        F.col("p_partkey"), F.col("p_partkey"), F.col("p_partkey"), F.col("p_partkey"))
    return p.select(F.col("p_partkey").cast("string").alias("source"), text.alias("text"))


@B.query("kg_rules_flat", """
  SELECT CAST(p_partkey AS VARCHAR) AS source, 'cap.' || p_partkey AS rule_id, 1 AS ord, 'must_not_exceed' AS operator,
         'price' AS metric, p_retailprice AS operand, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
         CAST(NULL AS VARCHAR) AS unit, 'v' || p_size AS version, 2 AS tier, '*' AS places
  FROM part WHERE p_partkey % 10 <> 9
  UNION ALL
  SELECT CAST(p_partkey AS VARCHAR), 'size.' || p_partkey, 2, 'range', 'size', NULL, 1.0, CAST(p_size AS DOUBLE), 'cm',
         'v' || p_size, 1, '*' FROM part WHERE p_partkey % 10 <> 9""")
def _flat(spark, sf_dir):
    rules = K.prepare_rules(K.flat_rules(_documents(spark, sf_dir)))
    return rules.select("source", "rule_id", "ord", "operator", "metric", F.col("operand.number").alias("operand"), "low",
                        "high", "unit", "version", "tier", F.concat_ws(",", "tokens").alias("places"))


@B.query("kg_registry_flat", """
  SELECT CAST(p_partkey AS VARCHAR) AS source, 'Part ' || p_partkey AS subject, 'cap.' || p_partkey AS rule_id FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'size ' || p_partkey, 'size.' || p_partkey FROM part""")
def _flat_registry(spark, sf_dir):
    return K.flat_registry(_documents(spark, sf_dir)).select("source", "subject", "rule_id")


@B.query("kg_empty_documents", "SELECT CAST(p_partkey AS VARCHAR) AS source FROM part WHERE p_partkey % 10 = 9")
def _empty(spark, sf_dir):
    return K.empty_documents(_documents(spark, sf_dir))


def _graph_documents(spark, sf_dir):
    """One rule-graph document per supplier."""
    s = B.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    text = F.format_string(
        '{"metadata":{"schema_version":"3.0"},"nodes":{"subjects":[{"id":"s%s","version":"1","name":"%s"}],'
        '"rules":[{"id":"r%s","version":"1","name":"rule","risk_tier":"low"}],'
        '"obligations":[{"id":"o%s","version":"1","obligation_type":"must_not_exceed","metric":"balance","value":%s,'
        '"effective_date_start":"2024-01-01"}]},"edges":[{"type":"applies_to","from":"r%s","to":"s%s"},'
        '{"type":"consists_of","from":"r%s","to":"o%s"}]}',
        key, F.col("s_name"), key, key, F.col("s_acctbal").cast("string"), key, key, key, key)
    return s.select(key.cast("string").alias("source"), text.alias("text"))


@B.query("kg_nodes_edges", """
  SELECT 'node' AS part, 'Subject' AS type, 's' || s_suppkey AS id, s_name AS label FROM supplier
  UNION ALL SELECT 'node', 'Rule', 'r' || s_suppkey, 'rule' FROM supplier
  UNION ALL SELECT 'node', 'Obligation', 'o' || s_suppkey, 'must_not_exceed' FROM supplier
  UNION ALL SELECT 'edge', 'applies_to', 'r' || s_suppkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT 'edge', 'consists_of', 'r' || s_suppkey, 'o' || s_suppkey FROM supplier""")
def _nodes_edges(spark, sf_dir):
    docs = _graph_documents(spark, sf_dir)
    nodes = K.graph_nodes(docs).select(F.lit("node").alias("part"), "type", "id",
                                       F.coalesce("obligation_type", "name").alias("label"))
    edges = K.graph_edges(docs).select(F.lit("edge").alias("part"), "type", F.col("from_id").alias("id"),
                                       F.col("to_id").alias("label"))
    return nodes.unionByName(edges)


@B.query("hist_append", f"""WITH r AS ({B.RECORD_SQL})
  SELECT tenant_id, count(*) AS n_rows, count(DISTINCT ts::DATE) AS n_days,
         CAST(max(epoch_us(ts)) AS BIGINT) AS newest_us FROM r GROUP BY tenant_id""")
def _append(spark, sf_dir):
    path = work_path(spark, "history")
    S.append_history(B.mixed_records(spark, sf_dir), path, by=("day",))
    return S.read_history(spark, path).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("day").alias("n_days"),
        F.max(V.micros(F.col("telemetry_ts"))).alias("newest_us"))


def _settings(spark, sf_dir):
    users = B.table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tenant_id"),
                        F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.col("user_id") % 20 + 1).cast("int")
                        .alias("buffer_retention_days"), (F.col("user_id") % 3 * 30).cast("int").alias("max_clock_skew_seconds"))


@B.query("hist_retention", f"""WITH r AS ({B.RECORD_SQL})
  SELECT tenant_id, count(*) FILTER (WHERE NOT expired) AS kept, count(*) FILTER (WHERE expired) AS dropped
  FROM (SELECT *, date_trunc('day', ts) + INTERVAL 1 DAY <=
               TIMESTAMP '2024-01-25 06:00:00' - to_days(CAST(CASE WHEN user_id % 4 = 0 THEN 10 ELSE user_id % 20 + 1 END AS INTEGER)) AS expired
        FROM r) GROUP BY tenant_id""")
def _retention(spark, sf_dir):
    marked = S.retention_cut(B.history_table(spark, sf_dir), _settings(spark, sf_dir), "2024-01-25 06:00:00", default_days=10)
    return marked.groupBy("tenant_id").agg(F.count_if(~F.col("expired")).alias("kept"),
                                           F.count_if(F.col("expired")).alias("dropped"))


@B.query("hist_summary", f"""WITH r AS ({B.RECORD_SQL})
  SELECT tenant_id, count(*) AS row_count, epoch_us(min(ts)) AS oldest_us, epoch_us(max(ts)) AS newest_us,
         count(DISTINCT subject) AS distinct_subjects, CAST(sum(strlen({B.MIXED_JSON_SQL})) AS BIGINT) AS total_measurement_bytes
  FROM r GROUP BY tenant_id""")
def _summary(spark, sf_dir):
    return S.history_summary(B.history_table(spark, sf_dir)).select(
        "tenant_id", "row_count", V.micros(F.col("oldest_record")).alias("oldest_us"),
        V.micros(F.col("newest_record")).alias("newest_us"), "distinct_subjects", "total_measurement_bytes")


@B.query("skew_reject", f"""WITH r AS ({B.RECORD_SQL})
  SELECT measurement_id, CAST(event_id % 100 AS DOUBLE) AS clock_skew_seconds, event_id % 100 > user_id % 3 * 30 AS rejected FROM r""")
def _skew(spark, sf_dir):
    late = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 100)
    records = B.mixed_records(spark, sf_dir).withColumn("received_ts", late)
    return T.skewed_clock(records, _settings(spark, sf_dir)).select("measurement_id", "clock_skew_seconds", "rejected")


@B.query("ledger_export", f"""WITH {B.LEDGER_SQL}
  SELECT tenant_id, seq AS sequence_number, verdict, rule_id, telemetry_id FROM numbered
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND verdict = 'FLAG' AND rule_id = 'r.error'""")
def _export(spark, sf_dir):
    path = work_path(spark, "export")
    L.export(B.entries_table(spark, sf_dir), path, "jsonl", start="2024-01-05", end="2024-01-20 12:00:00",
             verdict="FLAG", rule_id="r.error",
             fields=["tenant_id", "sequence_number", "verdict", "rule_id", "telemetry_id"])
    return spark.read.schema("tenant_id string, sequence_number bigint, verdict string, rule_id string, "
                             "telemetry_id string").json(path)


@B.query("ledger_page", f"""WITH {B.LEDGER_SQL}
  SELECT tenant_id, seq AS sequence_number, telemetry_id, verdict FROM numbered
  ORDER BY timestamp_iso, telemetry_id LIMIT 50 OFFSET 120""")
def _page(spark, sf_dir):
    return L.page(B.entries_table(spark, sf_dir), limit=50, offset=120, order=["timestamp_iso", "telemetry_id"]).select(
        "tenant_id", "sequence_number", "telemetry_id", "verdict")


@B.query("eval_cases_dups", """
  SELECT 'o' || l_orderkey || '-' || l_linenumber AS case_id, count(*) AS n_rows FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _dups(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("case_id"))
    return M.duplicate_cases(lines)
