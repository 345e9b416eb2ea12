"""Queries over typed obligations, guards, the cross-check and the risk policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.operators import envelope as E
from rulegauge.operators import history as H
from rulegauge.plans import base as B
from rulegauge.sources.rulesets import rules_frame

# ---- one obligation on one observation -------------------------------------------------------------

# observed: number, integer, true, text, null, list; operand: 50, "50", [10, 60], null, [], a mixed list
_OBS_SQL = f"""
  r AS ({B.RECORD_SQL}),
  d AS (SELECT measurement_id, v, k, event_id % 6 AS o, (event_id // 6) % 6 AS p,
               CASE event_id % 6 WHEN 0 THEN v WHEN 1 THEN k WHEN 2 THEN 1.0 END AS x FROM r)"""


def _observed(spark, sf_dir):
    e = B.events_of(spark, sf_dir)
    k, v = F.get_json_object("props", "$.k"), F.col("value").cast("string")
    o, p = (F.col("event_id") % 6).cast("int"), (F.floor(F.col("event_id") / 6) % 6).cast("int")
    text = F.when(k.cast("int") < 50, F.lit('"n/a"')).otherwise(F.concat(F.lit('"'), v, F.lit('"')))
    seen = F.element_at(F.array(v, k, F.lit("true"), text, F.lit("null"), F.concat(F.lit("["), v, F.lit("]"))), o + 1)
    operand = F.element_at(F.array(*[F.lit(x) for x in (
        "50", '"50"', "[10, 60]", "null", "[]", '[1, 10, 33, 50.0, "n/a"]')]), p + 1)
    return e.select(F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("measurement_id"),
                    P.observation(F.try_parse_json(seen)).alias("seen"),
                    P.obligation_operand(F.try_parse_json(operand)).alias("duty"))


def _check(kind):
    return lambda spark, sf: _observed(spark, sf).select(
        "measurement_id", P.satisfied(F.lit(kind), F.col("seen"), F.col("duty")).alias("satisfied"))


def _obl_sql(test: str) -> str:
    return f"WITH {_OBS_SQL} SELECT measurement_id, {test} AS satisfied FROM d"


_MEMBER = "coalesce(CASE WHEN o = 3 THEN k < 50 WHEN x IS NULL THEN false ELSE x IN (1, 10, 33, 50) END, false)"
_PAIR_MEMBER = "coalesce(x IN (10, 60), false)"
_SAME = "CASE p WHEN 0 THEN coalesce(x = 50, false) WHEN 3 THEN o = 4 ELSE false END"
for _name, _kind, _test in (
        ("obl_not_exceed", "must_not_exceed", "CASE WHEN p = 0 THEN x <= 50 END"),
        ("obl_at_least", "must_be_at_least", "CASE WHEN p = 0 THEN x >= 50 END"),
        ("obl_below", "must_be_below", "CASE WHEN p = 0 THEN x < 50 END"),
        ("obl_above", "must_be_above", "CASE WHEN p = 0 THEN x > 50 END"),
        ("obl_within", "must_be_within", "CASE WHEN p = 2 THEN x BETWEEN 10 AND 60 END"),
        ("obl_equal", "must_equal", _SAME), ("obl_not_equal", "must_not_equal", f"NOT ({_SAME})"),
        ("obl_one_of", "must_be_one_of", f"CASE p WHEN 2 THEN {_PAIR_MEMBER} WHEN 5 THEN {_MEMBER} END"),
        ("obl_not_one_of", "must_not_be_one_of", f"CASE p WHEN 2 THEN NOT {_PAIR_MEMBER} WHEN 5 THEN NOT {_MEMBER} END"),
        ("obl_unknown", "must", "CAST(NULL AS BOOLEAN)")):
    B.register(_name, _check(_kind), _obl_sql(_test))


def _outcome(kind):
    return lambda spark, sf: _observed(spark, sf).select(
        "measurement_id", E.obligation_outcome(F.lit(kind), F.col("seen"), F.col("duty")).alias("verdict"))


B.register("obl_should", _outcome("should"), f"""WITH {_OBS_SQL}
  SELECT measurement_id, CASE WHEN p = 3 THEN 'CLEAR' WHEN p = 0 AND x = 50 THEN 'CLEAR' ELSE 'DISCRETIONARY' END AS verdict FROM d""")
B.register("obl_discretionary", _outcome("discretionary"),
           f"WITH {_OBS_SQL} SELECT measurement_id, 'DISCRETIONARY' AS verdict FROM d")


@B.query("obl_recorded_within", f"""WITH r AS ({B.RECORD_SQL}),
  g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, subject ORDER BY ts, event_id)) AS gap FROM r)
  SELECT measurement_id, CASE WHEN gap <= 259200000000 THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM g""")
def _recorded(spark, sf_dir):
    seen = H.last_seen(B.mixed_records(spark, sf_dir))
    blank = P.observation(F.try_parse_json(F.lit("null")))
    rows = seen.withColumn("seen", blank).withColumn("duty", P.obligation_operand(F.try_parse_json(F.lit("null"))))
    recorded = H.fresh(F.col("ts"), F.col("last_ts"), F.lit(259_200))
    return rows.select("measurement_id", E.obligation_outcome(
        F.lit("must_be_recorded_within"), F.col("seen"), F.col("duty"), recorded=recorded).alias("verdict"))


_W = 345_600
_X_SQL = f"r AS ({B.RECORD_SQL}), x AS (SELECT *, CASE WHEN m NOT IN (3, 5, 7, 9) THEN v END AS x FROM r)"
_CLOSED = f"(PARTITION BY user_id, subject ORDER BY ts RANGE BETWEEN to_microseconds({_W * 10**6}) PRECEDING AND CURRENT ROW)"


def _window_duty(spark, sf_dir, kind, operand):
    stats = H.window_stats(B.mixed_records(spark, sf_dir), seconds=_W, path="x", bounds="[]")
    duty = P.obligation_operand(F.try_parse_json(F.lit(operand)))
    return stats.withColumn("duty", duty).select("measurement_id", P.satisfied_in_window(
        F.lit(kind), mean=F.col("avg_value"), peak=F.col("max_value"), operand=F.col("duty")).alias("satisfied"))


B.register("obl_avg_window", lambda spark, sf: _window_duty(spark, sf, "must_average_within", "[5, 30]"),
           f"WITH {_X_SQL} SELECT measurement_id, avg(x) OVER {_CLOSED} BETWEEN 5 AND 30 AS satisfied FROM x")
B.register("obl_peak_window", lambda spark, sf: _window_duty(spark, sf, "must_not_exceed_in_window", "60"),
           f"WITH {_X_SQL} SELECT measurement_id, max(x) OVER {_CLOSED} <= 60 AS satisfied FROM x")

# ---- verdicts over all obligations ------------------------------------------------------------------

_ALL_SQL = f"""{B.PAIRS_SQL},
  judged AS (SELECT *, CASE WHEN op = 'should' THEN CASE WHEN x = 1 THEN 'CLEAR' ELSE 'DISCRETIONARY' END
      WHEN ok IS NULL THEN 'DISCRETIONARY' WHEN ok THEN 'CLEAR' ELSE 'FLAG' END AS outcome FROM pairs),
  verdicts AS (SELECT r.measurement_id, r.subject, r.jurisdiction, count(j.rule_id) AS n_mapped, count(*) FILTER (WHERE j.outcome = 'FLAG') AS n_breached,
      CASE WHEN count(j.rule_id) = 0 THEN 'NULL_UNMAPPED' WHEN count(*) FILTER (WHERE j.outcome = 'FLAG') > 0 THEN 'FLAG'
           WHEN count(*) FILTER (WHERE j.outcome = 'DISCRETIONARY') > 0 THEN 'DISCRETIONARY' ELSE 'CLEAR' END AS verdict
    FROM r LEFT JOIN judged j USING (measurement_id) GROUP BY ALL)"""


@B.query("verdict_all_obligations", f"WITH {_ALL_SQL} SELECT measurement_id, n_mapped, n_breached, verdict FROM verdicts")
def _all(spark, sf_dir):
    return E.verdict_all(B.metric_records(spark, sf_dir), B.obligations(spark)).select(
        "measurement_id", "n_mapped", "n_breached", "verdict")


STATEFUL = [
    dict(rule_id="st.click", metric="click_v", operator="must_average_within", value="[5, 30]", seconds=_W),
    dict(rule_id="st.view", metric="view_v", operator="must_not_exceed_in_window", value="60", seconds=_W),
    dict(rule_id="st.error", metric="error_v", operator="must_be_recorded_within", value="null", seconds=259_200),
    dict(rule_id="st.purchase", metric="purchase_v", operator="must_be_at_least", value="10", fresh_seconds=432_000),
    dict(rule_id="st.k", metric="k", operator="must_not_be_one_of", value="[13, 66, 77]"),
]


STATEFUL_SQL = f"""WITH r AS ({B.RECORD_SQL}),
  w AS (SELECT *, avg(v) OVER {_CLOSED} AS mean, max(v) OVER {_CLOSED} AS peak,
      epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, subject ORDER BY ts, event_id)) AS gap FROM r),
  o AS (SELECT *, CASE subject WHEN 'click' THEN CASE WHEN mean BETWEEN 5 AND 30 THEN 'CLEAR' ELSE 'FLAG' END
      WHEN 'view' THEN CASE WHEN peak <= 60 THEN 'CLEAR' ELSE 'FLAG' END
      WHEN 'error' THEN CASE WHEN gap <= 259200000000 THEN 'CLEAR' ELSE 'FLAG' END
      WHEN 'purchase' THEN CASE WHEN gap IS NULL OR gap > 432000000000 THEN 'NULL_STALE' WHEN v >= 10 THEN 'CLEAR' ELSE 'FLAG' END END AS own,
      k IN (13, 66, 77) AS banned FROM w)
  SELECT measurement_id, CASE WHEN subject = 'signup' THEN 1 ELSE 2 END::BIGINT AS n_mapped,
      CASE WHEN banned OR own = 'FLAG' THEN 'FLAG' WHEN own = 'NULL_STALE' THEN own ELSE 'CLEAR' END AS verdict FROM o"""


@B.query("verdict_all_stateful", STATEFUL_SQL)
def _stateful(spark, sf_dir):
    """Windows, recency and a freshness gate in one verdict per record, over the subjects' own histories."""
    records = B.metric_records(spark, sf_dir)
    history = records.select(*H.SUBJECT, "measurement_id", "ts", "measurement")
    return E.verdict_all(records, rules_frame(spark, STATEFUL), history=history).select("measurement_id", "n_mapped", "verdict")


@B.query("verdict_counts", f"""WITH {_ALL_SQL}
  SELECT subject, coalesce(jurisdiction, 'none') AS place, verdict, count(*) AS n_records FROM verdicts GROUP BY 1, 2, 3""")
def _counts(spark, sf_dir):
    got = E.verdict_all(B.metric_records(spark, sf_dir), B.obligations(spark), carry=["subject", "jurisdiction"])
    return got.groupBy("subject", F.coalesce("jurisdiction", F.lit("none")).alias("place"), "verdict").agg(
        F.count(F.lit(1)).alias("n_records"))


def _line_rules(spark):
    return rules_frame(spark, [
        dict(rule_id="ln.discount", metric="discount", operator="must_be_within", value="[0.01, 0.09]"),
        dict(rule_id="ln.quantity", metric="quantity", operator="must_not_exceed", value="45", effective_date="1996-01-01"),
        dict(rule_id="ln.tax", metric="tax", operator="must_be_below", value="0.08", sunset_date="2000-12-31"),
        dict(rule_id="ln.flag", metric="returnflag", operator="must_be_one_of", value='["A", "N"]', jurisdiction='"status.O"')])


_LINES_SQL = """
  WITH l AS (SELECT *, (l_discount NOT BETWEEN 0.01 AND 0.09)::INT
      + (l_quantity > 45 AND l_shipdate >= TIMESTAMP '1996-01-01')::INT
      + (l_tax >= 0.08 AND l_shipdate <= TIMESTAMP '2000-12-31')::INT
      + (l_returnflag NOT IN ('A', 'N') AND l_linestatus = 'O')::INT AS breaches FROM lineitem)
  SELECT l_linestatus AS line_status, CASE WHEN breaches > 0 THEN 'FLAG' ELSE 'CLEAR' END AS verdict,
         count(*) AS n_records, CAST(sum(breaches) AS BIGINT) AS n_breaches FROM l GROUP BY 1, 2"""


@B.query("verdict_lineitem", _LINES_SQL)
def _lineitem(spark, sf_dir):
    """High-volume telemetry: four readings per line item, four obligations, verdict counts per status.

    Order and line number repeat in the data, so each line item is decided under a row number of its own.
    """
    lines = B.table(spark, sf_dir, "lineitem")
    payload = F.format_string('{"discount":%s,"quantity":%s,"tax":%s,"returnflag":"%s"}', F.col("l_discount").cast("string"),
                              F.col("l_quantity").cast("string"), F.col("l_tax").cast("string"), F.col("l_returnflag"))
    records = lines.select(
        F.monotonically_increasing_id().alias("measurement_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("status."), F.col("l_linestatus")).alias("jurisdiction"), F.try_parse_json(payload).alias("measurement"), "l_linestatus")
    got = E.verdict_all(records, _line_rules(spark), carry=["l_linestatus"])
    return got.groupBy(F.col("l_linestatus").alias("line_status"), "verdict").agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("n_breached").alias("n_breaches"))


# ---- proposals and guards ---------------------------------------------------------------------------

_FIRST_SQL = f"""{B.PAIRS_SQL},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY measurement_id ORDER BY ord) AS n FROM pairs),
  picked AS (SELECT *, CASE WHEN op IN ('must_not_exceed', 'must_be_within') THEN ok ELSE true END AS claimed FROM ranked WHERE n = 1)"""


@B.query("propose_first_match", f"""WITH {_FIRST_SQL}
  SELECT r.measurement_id, CASE WHEN p.rule_id IS NULL THEN 'NULL_UNMAPPED' WHEN claimed THEN 'CLEAR' ELSE 'FLAG' END AS verdict,
         p.rule_id, p.claimed FROM r LEFT JOIN picked p USING (measurement_id)""")
def _propose(spark, sf_dir):
    got = E.propose_first_match(B.metric_records(spark, sf_dir), B.obligations(spark))
    first = F.try_element_at("assertions", F.lit(1))
    return got.select("measurement_id", "verdict", E.rule_of(F.col("citations")).alias("rule_id"), first["satisfied"].alias("claimed"))


def raw_proposals(spark, sf_dir):
    """Proposal texts as a model would send them; eighteen kinds by event number, most of them off contract."""
    e = B.events_of(spark, sf_dir)
    v = F.col("value").cast("string")
    met = F.when(F.col("value") <= 100, "true").otherwise("false")
    wrong = F.when(F.col("value") <= 100, "false").otherwise("true")
    word = F.when(F.col("value") <= 100, "CLEAR").otherwise("FLAG")
    cite = '[{"node_id":"%s","version":"v1","role":"%s"}]'
    claim = '[{"predicate":"%s","metric":"%s","value":%s,"observed":%s,"satisfied":%s,"obligation_id":"%s"%s}]'

    def doc(verdict, cites, claims):
        return F.concat(F.lit('{"verdict":"'), verdict, F.lit('","reasoning":"because","kg_citations":'), cites,
                        F.lit(',"formalizable_assertions":'), claims, F.lit("}"))

    def cites(node="ob.load.cap", role="obligation"):
        return F.lit(cite % (node, role))

    def claims(observed=v, flag=met, predicate="must_not_exceed", metric="load", value="100", node="ob.load.cap", extra=""):
        return F.format_string(claim, F.lit(predicate), F.lit(metric), F.lit(value), observed, flag, F.lit(node), F.lit(extra))
    none = F.lit("[]")
    good = doc(word, cites(), claims())
    kinds = {
        1: doc(word, cites(), claims(flag=wrong)),                                # wrong flag, corrected
        2: doc(F.lit("CLEAR"), cites(), claims(observed=F.lit("-1"), flag=F.lit("true"))),  # invented reading
        3: doc(word, cites(), claims(value="999", flag=F.lit("true"))),           # invented cap
        4: doc(word, cites("ob.none"), claims()),                                 # cites what is not there
        5: F.concat(F.lit("verdict: "), word),                                    # not JSON
        6: F.lit('{"verdict":"CLEAR","kg_citations":[],"formalizable_assertions":[]}'),  # no reasoning
        7: doc(F.lit("PROBABLY"), none, none),                                    # a sixth verdict
        8: doc(F.lit("CLEAR"), none, none),                                       # nothing to check, nothing cited
        9: doc(F.lit("CLEAR"), cites(), none),                                    # nothing to check
        10: doc(word, cites(), claims(value='{"min":1,"max":100}')),              # object operand
        11: doc(word, cites(role="hint"), claims()),                              # unknown role
        12: doc(F.when(F.col("value") <= 100, "FLAG").otherwise("CLEAR"), cites(), claims()),  # verdict against flags
        13: doc(word, cites(), claims(predicate="must", flag=F.lit("true"))),     # cannot be checked
        14: doc(word, cites(), claims(metric="speed")),                           # a metric nobody measured
        15: doc(word, cites(), claims(extra=',"confidence":0.9')),                # an extra key
        16: doc(F.lit("NULL_UNMAPPED"), none, none),
        17: doc(word, cites("term.load", "definition_resolved"), claims()),       # cites a definition
    }
    text = good
    for kind, body in kinds.items():
        text = F.when(F.col("event_id") % 18 == kind, body).otherwise(text)
    payload = F.concat(F.lit('{"load":'), v, F.lit("}"))
    raw = e.select(F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("measurement_id"), text.alias("raw"))
    return raw, B.envelope_of(B.events_of(spark, sf_dir), payload)


def load_rules(spark):
    return rules_frame(spark, [dict(rule_id="ob.load.cap", metric="load", operator="must_not_exceed", value="100", version="v1")])


def _definitions(spark):
    from rulegauge.session import literal_frame
    return literal_frame(spark, [("term.load",)], "id string")


_P_SQL = """p AS (SELECT 'ev-' || event_id AS measurement_id, event_id % 18 AS c, value <= 100 AS met, user_id FROM events),
  w AS (SELECT *, CASE WHEN met THEN 'CLEAR' ELSE 'FLAG' END AS word FROM p)"""


@B.query("contract_guard", f"""WITH {_P_SQL} SELECT measurement_id,
    CASE c WHEN 5 THEN 'not_json' WHEN 6 THEN 'missing_keys' WHEN 7 THEN 'unknown_verdict' WHEN 10 THEN 'assertion'
           WHEN 11 THEN 'citation' WHEN 15 THEN 'assertion' END AS contract_error,
    CASE WHEN c IN (5, 6, 7, 10, 11, 15) THEN 'DISCRETIONARY' WHEN c IN (2, 8, 9) THEN 'CLEAR' WHEN c = 16 THEN 'NULL_UNMAPPED'
         WHEN c = 12 THEN CASE WHEN met THEN 'FLAG' ELSE 'CLEAR' END ELSE word END AS verdict FROM w""")
def _contract(spark, sf_dir):
    return E.parse_proposals(raw_proposals(spark, sf_dir)[0]).select("measurement_id", "contract_error", "verdict")


@B.query("citation_enforce", f"""WITH {_P_SQL} SELECT measurement_id, 'ob.none' AS bad FROM w WHERE c = 4""")
def _citation(spark, sf_dir):
    raw, records = raw_proposals(spark, sf_dir)
    got = E.verify(E.parse_proposals(raw), records, load_rules(spark), definitions=_definitions(spark))
    return got.filter(F.size("bad_citations") > 0).select("measurement_id", F.concat_ws(",", "bad_citations").alias("bad"))


@B.query("taxonomy_guard", f"""WITH {_P_SQL} SELECT measurement_id,
    CASE c WHEN 8 THEN 'NULL_UNMAPPED' ELSE 'DISCRETIONARY' END AS verdict FROM w WHERE c IN (8, 9)""")
def _taxonomy(spark, sf_dir):
    got = E.parse_proposals(raw_proposals(spark, sf_dir)[0])
    after = E.taxonomy(F.col("verdict"), F.col("citations"), F.col("assertions"))
    return got.select("measurement_id", "verdict", after.alias("after")).filter("verdict <> after").select(
        "measurement_id", F.col("after").alias("verdict"))


def _rows(spark, sf_dir):
    raw, records = raw_proposals(spark, sf_dir)
    return E.check_rows(E.parse_proposals(raw), records, load_rules(spark)).filter("item = 'a'")


@B.query("ground_observation", f"""WITH {_P_SQL} SELECT measurement_id, CASE c WHEN 2 THEN 'observed_differs' ELSE 'metric_not_measured' END AS grounding
  FROM w WHERE c IN (2, 14)""")
def _ground_obs(spark, sf_dir):
    return _rows(spark, sf_dir).filter(F.col("grounding").isin("observed_differs", "metric_not_measured")).select(
        "measurement_id", "grounding")


@B.query("ground_obligation", f"WITH {_P_SQL} SELECT measurement_id, 'value_differs' AS grounding FROM w WHERE c = 3")
def _ground_obl(spark, sf_dir):
    return _rows(spark, sf_dir).filter(F.col("grounding").isin("unknown_obligation", "metric_differs", "value_differs")).select(
        "measurement_id", "grounding")


@B.query("normalize_satisfied", f"""WITH {_P_SQL} SELECT measurement_id, NOT met AS claimed, met AS flag FROM w WHERE c = 1""")
def _normalized(spark, sf_dir):
    return _rows(spark, sf_dir).filter(F.col("flag") != F.col("claim.satisfied")).select(
        "measurement_id", F.col("claim.satisfied").alias("claimed"), "flag")


_STATUS = """CASE WHEN c IN (5, 6, 7, 8, 9, 10, 11, 13, 15, 16) THEN 'UNVERIFIABLE' WHEN c IN (2, 3, 14) THEN 'LLM_CONTRADICTION'
    WHEN c = 12 THEN 'NEURO_SYMBOLIC_DIVERGENCE' ELSE 'AGREED' END"""


@B.query("verify_rollup", f"""WITH {_P_SQL} SELECT measurement_id, {_STATUS} AS verifier_status,
    CASE WHEN c IN (5, 6, 7, 8, 9, 10, 11, 13, 15, 16) THEN 0 ELSE 1 END AS checked FROM w""")
def _rollup(spark, sf_dir):
    raw, records = raw_proposals(spark, sf_dir)
    got = E.verify(E.parse_proposals(raw), records, load_rules(spark), definitions=_definitions(spark))
    return got.select("measurement_id", "verifier_status", F.col("checked_assertions").cast("int").alias("checked"))


@B.query("verify_raw_flags", f"""WITH {_P_SQL} SELECT measurement_id,
    CASE WHEN c = 1 THEN 'LLM_CONTRADICTION' ELSE {_STATUS} END AS verifier_status FROM w""")
def _raw_flags(spark, sf_dir):
    raw, records = raw_proposals(spark, sf_dir)
    return E.verify(E.parse_proposals(raw), records, load_rules(spark), normalize=False).select("measurement_id", "verifier_status")


@B.query("divergence_list", f"""WITH {_P_SQL} SELECT measurement_id, CASE
    WHEN c IN (5, 6, 7, 8, 9, 10, 11, 15, 16) THEN 'There was nothing to check.'
    WHEN c = 12 THEN 'Verdict ' || CASE WHEN met THEN 'FLAG' ELSE 'CLEAR' END || ' does not follow from the satisfied flags.'
    WHEN c = 13 THEN '[ob.load.cap] must cannot be checked' WHEN c = 2 THEN '[ob.load.cap] observed_differs: load'
    WHEN c = 3 THEN '[ob.load.cap] value_differs: load' WHEN c = 14 THEN '[ob.load.cap] metric_not_measured: speed' ELSE '' END AS divergences FROM w""")
def _divergences(spark, sf_dir):
    raw, records = raw_proposals(spark, sf_dir)
    return E.verify(E.parse_proposals(raw), records, load_rules(spark)).select(
        "measurement_id", F.concat_ws("; ", "divergences").alias("divergences"))


@B.query("verify_window_assertions", f"""WITH {_X_SQL}, w AS (SELECT measurement_id, avg(x) OVER {_CLOSED} AS mean FROM x)
  SELECT measurement_id, CASE WHEN mean IS NULL THEN 'UNVERIFIABLE' WHEN mean BETWEEN 5 AND 30 THEN 'AGREED' ELSE 'LLM_CONTRADICTION' END AS verifier_status FROM w""")
def _window_claims(spark, sf_dir):
    records = B.mixed_records(spark, sf_dir)
    rules = rules_frame(spark, [dict(rule_id="ob.x.mean", metric="x", operator="must_average_within", value="[5, 30]")])
    claim = F.array(F.struct(
        F.lit("must_average_within").alias("predicate"), F.lit("x").alias("metric"), F.lit("[5,30]").alias("value"),
        F.lit(None).cast("string").alias("observed"), F.lit(True).alias("satisfied"), F.lit("ob.x.mean").alias("obligation_id"),
        F.lit(_W).cast("bigint").alias("window_seconds"))).cast(E.ASSERTIONS)
    proposals = records.select("measurement_id", F.lit("CLEAR").alias("verdict"), F.lit("").alias("reasoning"),
                               F.array().cast(E.CITATIONS).alias("citations"), claim.alias("assertions"))
    return E.verify(proposals, records, rules, history=records).select("measurement_id", "verifier_status")


# ---- policy and envelopes ---------------------------------------------------------------------------

_GRID = """g AS (SELECT l_orderkey, l_linenumber, l_orderkey % 4 AS s, l_linenumber % 3 + 1 AS tier, l_orderkey % 3 = 0 AS attested,
    CASE WHEN l_orderkey % 2 = 0 THEN 'CLEAR' ELSE 'FLAG' END AS verdict FROM lineitem)"""


def _grid(spark, sf_dir, policy):
    statuses = F.array(*[F.lit(s) for s in P.STATUSES])
    lines = B.table(spark, sf_dir, "lineitem").select(
        F.element_at(statuses, (F.col("l_orderkey") % 4 + 1).cast("int")).alias("status"),
        (F.col("l_linenumber") % 3 + 1).alias("tier"), (F.col("l_orderkey") % 3 == 0).alias("attested"),
        F.when(F.col("l_orderkey") % 2 == 0, "CLEAR").otherwise("FLAG").alias("verdict"))
    out = lines.withColumn("p", E.risk_policy(F.col("verdict"), F.col("status"), F.col("tier"), F.col("attested"), policy=policy))
    return out.groupBy("tier", "status", "attested", F.col("verdict").alias("proposed"), "p.verdict", "p.attestation_required",
                       F.coalesce("p.note", F.lit("")).alias("note")).agg(F.count(F.lit(1)).alias("n_rows"))


def _grid_sql(verdict, required, note):
    return f"""WITH {_GRID} SELECT CAST(tier AS INTEGER) AS tier, ['AGREED', 'LLM_CONTRADICTION', 'NEURO_SYMBOLIC_DIVERGENCE', 'UNVERIFIABLE'][s + 1] AS status, attested,
    verdict AS proposed, {verdict} AS verdict, {required} AS attestation_required, {note} AS note, count(*) AS n_rows FROM g GROUP BY ALL"""


B.register("risk_policy", lambda spark, sf: _grid(spark, sf, "impl"), _grid_sql(
    "CASE WHEN s <> 0 AND (tier = 1 OR (tier = 2 AND s IN (1, 2) AND NOT attested) OR (tier = 3 AND s = 1)) THEN 'DISCRETIONARY' ELSE verdict END",
    "s <> 0 AND NOT attested AND (tier = 1 OR (tier = 2 AND s IN (1, 2)))",
    """CASE WHEN s <> 0 AND (tier = 1 OR (tier = 2 AND s IN (1, 2) AND NOT attested) OR (tier = 3 AND s = 1)) THEN 'forced_discretionary'
        WHEN (tier = 2 AND s = 3) OR (tier = 3 AND s IN (2, 3)) THEN 'accepted_with_note' ELSE '' END"""))
B.register("risk_policy_spec", lambda spark, sf: _grid(spark, sf, "spec"), _grid_sql(
    "CASE WHEN (tier = 1 AND NOT (s = 0 AND attested)) OR (tier = 2 AND s IN (1, 2)) THEN 'DISCRETIONARY' ELSE verdict END",
    "tier = 1 AND NOT (s = 0 AND attested)",
    """CASE WHEN tier = 1 AND NOT (s = 0 AND attested) THEN 'held' WHEN tier = 2 AND s IN (1, 2) THEN 'forced_discretionary'
        WHEN tier = 3 AND s <> 0 THEN 'accepted_with_note' ELSE '' END"""))

PROVENANCE = {
    "model_weight_hash": "sha256:" + "f" * 64, "kg_version_hash": "sha256:" + "a" * 64, "prompt_template_id": "evaluate.1",
    "prompt_template_hash": "sha256:" + "1" * 64, "decoder_seed": 0, "structured_grammar_hash": "sha256:" + "2" * 64,
}


@B.query("envelopes_external", f"""WITH {_P_SQL} SELECT measurement_id,
    CASE WHEN c = 4 THEN 'NULL_UNMAPPED' WHEN c IN (2, 3, 5, 6, 7, 9, 10, 11, 12, 14, 15) THEN 'DISCRETIONARY'
         WHEN c IN (8, 16) THEN 'NULL_UNMAPPED' ELSE word END AS verdict,
    CASE WHEN c = 4 THEN 'UNVERIFIABLE' ELSE {_STATUS} END AS verifier_status,
    c IN (2, 3, 12, 14) AS attestation_required,
    CASE WHEN c IN (4, 5, 6, 7, 8, 10, 11, 15, 16) THEN NULL WHEN c = 17 THEN 'term.load' ELSE 'ob.load.cap' END AS booked_under FROM w""")
def _external(spark, sf_dir):
    raw, records = raw_proposals(spark, sf_dir)
    got = E.envelopes(records, load_rules(spark), E.parse_proposals(raw), definitions=_definitions(spark), provenance=PROVENANCE)
    return got.select("measurement_id", "verdict", "verifier_status", "attestation_required",
                      E.rule_of(F.col("citations")).alias("booked_under"))


@B.query("envelopes_first_match", f"""WITH {_FIRST_SQL}, s AS (SELECT r.measurement_id, min(o.tier) AS tier FROM r JOIN o
      ON (o.eff IS NULL OR o.eff <= r.ts) AND (o.sunset IS NULL OR o.sunset >= r.ts)
     AND (r.jurisdiction IS NULL OR list_contains(o.places, '*') OR list_contains(o.places, r.jurisdiction)) GROUP BY 1),
  c AS (SELECT r.measurement_id, coalesce(s.tier, 2) AS tier, p.rule_id, p.ok, p.claimed, p.op,
      CASE WHEN p.rule_id IS NULL THEN 'NULL_UNMAPPED' WHEN p.claimed THEN 'CLEAR' ELSE 'FLAG' END AS proposed,
      CASE WHEN p.rule_id IS NULL OR (p.ok IS NULL) THEN 'UNVERIFIABLE' WHEN p.claimed AND NOT p.ok THEN 'NEURO_SYMBOLIC_DIVERGENCE'
           ELSE 'AGREED' END AS status
    FROM r LEFT JOIN picked p USING (measurement_id) LEFT JOIN s USING (measurement_id))
  SELECT measurement_id, CASE WHEN status <> 'AGREED' AND (tier = 1 OR (tier = 2 AND status = 'NEURO_SYMBOLIC_DIVERGENCE')) THEN 'DISCRETIONARY'
      ELSE proposed END AS verdict, status AS verifier_status, 'tier-' || tier AS tier FROM c""")
def _first_match(spark, sf_dir):
    got = E.envelopes(B.metric_records(spark, sf_dir), B.obligations(spark), provenance=PROVENANCE)
    return got.select("measurement_id", "verdict", "verifier_status", "tier")


@B.query("provenance_check", "SELECT 'ev-' || event_id AS measurement_id FROM events WHERE event_id % 9 = 0")
def _provenance(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    good = F.struct(*[F.lit(x).alias(n) for n, x in PROVENANCE.items()])
    bad = F.struct(*[F.lit("SHA256:ABC" if n == "kg_version_hash" else x).alias(n) for n, x in PROVENANCE.items()])
    rows = e.select(F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("measurement_id"),
                    F.when(F.col("event_id") % 9 == 0, bad).otherwise(good).alias("provenance"))
    return E.provenance_issues(rows).select("measurement_id")


@B.query("fast_path", f"""WITH r AS ({B.RECORD_SQL}),
  f AS (SELECT *, CASE WHEN v <= 12 THEN 1 ELSE 0 END AS flag, user_id % 3 + 1 AS tier FROM r),
  p AS (SELECT measurement_id, tier, count(*) OVER w AS n, min(flag) OVER w AS lo, max(flag) OVER w AS hi FROM f
        WINDOW w AS (PARTITION BY user_id, subject ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
  SELECT measurement_id, CASE WHEN tier = 3 AND n = 3 AND lo = hi THEN 'fast' END AS verdict_path FROM p""")
def _fast(spark, sf_dir):
    checks = B.mixed_records(spark, sf_dir).select(
        "measurement_id", "tenant_id", "subject", "ts", "event_id", (F.col("value") <= 12).cast("int").alias("flag"),
        (F.col("user_id") % 3 + 1).alias("tier"))
    return E.fast_path(checks, keys=["tenant_id", "subject"], order=["ts", "event_id"], id_col="measurement_id",
                       stable_for=3).select("measurement_id", "verdict_path")


@B.query("udf_proposal", f"""WITH r AS ({B.RECORD_SQL}) SELECT measurement_id, CASE WHEN v > 100 THEN 'FLAG' ELSE 'CLEAR' END AS verdict FROM r""")
def _udf(spark, sf_dir):
    """A user's own scorer over (measurement, rules in scope), called with Arrow batches."""
    from rulegauge.operators.proposers import propose

    def scorer(batch):
        load = batch["measurement"].str.extract(r'"load":([0-9.]+)', expand=False).astype(float)
        verdict = load.gt(100).map({True: "FLAG", False: "CLEAR"})
        return ('{"verdict":"' + verdict + '","reasoning":"cap 100","kg_citations":[],"formalizable_assertions":[]}')
    records = raw_proposals(spark, sf_dir)[1]
    return propose(records, load_rules(spark), scorer).select("measurement_id", "verdict")
