"""Ids belong to their subject: tenants that share one, and records that a store holds twice, do not touch each other."""

from pyspark.sql import functions as F

from rulegauge.operators import envelope as E
from rulegauge.operators import history as H
from rulegauge.operators import routing as R
from rulegauge.operators import rules as U
from rulegauge.session import literal_frame
from rulegauge.sources.rulesets import rules_frame

SCHEMA = "measurement_id string, tenant_id string, subject string, s bigint, json string, jurisdiction string"


def records(spark, rows):
    """(id, tenant, second, payload)"""
    return literal_frame(spark, [(i, t, "pump", s, j, None) for i, t, s, j in rows], SCHEMA).select(
        "measurement_id", "tenant_id", "subject", F.timestamp_seconds("s").alias("ts"), "jurisdiction",
        F.try_parse_json("json").alias("measurement"))


def test_shared_id_does_not_clear_a_breach(spark):
    rules = rules_frame(spark, [dict(rule_id="w", metric="x", operator="must_average_within", value="[0, 5]", seconds=60)])
    df = records(spark, [("r1", "t1", 100, '{"x":7}'), ("r1", "t2", 100, '{"x":1}')])
    got = E.verdict_all(df, rules, history=df)
    assert {(r.tenant_id, r.verdict, r.n_mapped) for r in got.collect()} == {("t1", "FLAG", 1), ("t2", "CLEAR", 1)}


def test_record_held_twice_counts_once(spark):
    rules = rules_frame(spark, [
        dict(rule_id="w", metric="x", operator="must_average_within", value="[0, 5]", seconds=60),
        dict(rule_id="e", metric="x", operator="must_be_recorded_within", value="null", seconds=60)])
    df = records(spark, [("r1", "t1", 100, '{"x":7}')])
    got = E.verdict_all(df, rules, history=df.unionByName(df)).collect()
    # one record, nothing before it: both obligations are breached, each once
    assert [(r.n_mapped, r.n_breached, r.verdict) for r in got] == [(2, 2, "FLAG")]


def test_rule_operators_keep_tenants_apart(spark):
    df = records(spark, [("a", "t1", 100, '{"x":1}'), ("b", "t1", 110, '{"x":1}'), ("b", "t2", 110, '{"x":1}'), ("c", "t1", 120, '{"x":1}')])
    registry = literal_frame(spark, [("pump", "r", 0)], "subject string, rule_id string, ord int")
    for operator, want in (("window_count", {("a", "t1"): "CLEAR", ("b", "t1"): "FLAG", ("b", "t2"): "CLEAR", ("c", "t1"): "FLAG"}),
                           ("debounce", {("a", "t1"): "CLEAR", ("b", "t1"): "DISCRETIONARY", ("b", "t2"): "CLEAR", ("c", "t1"): "DISCRETIONARY"})):
        rules = rules_frame(spark, [dict(rule_id="r", operator=operator, seconds=60, value="1", cmp_op="lte")])
        routed = R.route(df, registry, rules)
        assert {(r.measurement_id, r.tenant_id): r.verdict for r in U.evaluate(routed, df).collect()} == want
        seen = U.evaluate(routed, df, include_self=True)
        assert seen.count() == 4


def test_repeated_probe_rows_have_one_answer(spark):
    df = records(spark, [("a", "t1", 100, '{"x":1}'), ("a", "t1", 100, '{"x":1}'), ("b", None, 100, '{"x":2}')])
    got = {(r.measurement_id, r.tenant_id): (r["count"], r.sum_value) for r in H.window_stats(df, seconds=60, path="x").collect()}
    assert got == {("a", "t1"): (2, 2.0), ("b", None): (1, 2.0)}


def test_proposals_and_envelopes_of_shared_ids(spark):
    rules = rules_frame(spark, [dict(rule_id="cap", metric="x", operator="must_not_exceed", value="5")])
    df = records(spark, [("r1", "t1", 100, '{"x":7}'), ("r1", "t2", 100, '{"x":1}')])
    assert {(r.tenant_id, r.verdict) for r in E.propose_first_match(df, rules).collect()} == {("t1", "FLAG"), ("t2", "CLEAR")}
    got = {(r.tenant_id, r.verdict, r.verifier_status) for r in E.envelopes(df, rules, carry=H.SUBJECT).collect()}
    assert got == {("t1", "FLAG", "AGREED"), ("t2", "CLEAR", "AGREED")}


def test_record_before_is_looked_up_once(spark):
    from rulegauge.operators import routing as R
    from rulegauge.operators import rules as E
    from rulegauge.plans import base as B
    registry, rules = B.ledger_rules(spark)
    records = B.mixed_records(spark, "/root/testdata/sf0.001")
    early = E.evaluate(R.route(E.record_before(records), registry, rules), records, needs=(False, True))
    late = E.evaluate(R.route(records, registry, rules), records, needs=(False, True))
    assert early.columns == late.columns
    pick = ("tenant_id", "measurement_id", "verdict", "reasoning")
    assert early.select(*pick).exceptAll(late.select(*pick)).count() == 0 and early.count() == late.count() == records.count()
    assert early._jdf.queryExecution().analyzed().toString().count("windowspecdefinition") < 4


def test_entries_are_decided_before_they_are_ranged(spark, monkeypatch):
    """The pass that finds the ranges reads a written table and does not decide the entries once more."""
    from rulegauge.operators import ordered
    from rulegauge.plans import base as B
    plans, whole = [], ordered.dense_index
    monkeypatch.setattr(ordered, "dense_index", lambda df, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df, **k))
    monkeypatch.setattr(B, "_BUILT", {})
    B.entries_table(spark, "/root/testdata/sf0.001")
    assert plans and all("Exchange" not in p for p in plans)


def test_replay_writes_what_it_compares(spark, monkeypatch):
    from rulegauge.operators import replay as Y
    from rulegauge.plans import audit
    written, whole = [], Y.materialize
    monkeypatch.setattr(Y, "materialize", lambda df, *a, **k: written.append(df) or whole(df, *a, **k))
    got = audit._replayed(spark, "/root/testdata/sf0.001")
    assert set(written[0].columns) == {"tenant_id", "sequence_number", "telemetry_id", "rule_id", "verdict", "skip_reason", "record", "_key"}
    assert written[0].filter("skip_reason IS NOT NULL AND record IS NOT NULL").count() == 0
    assert {r.outcome for r in got.select("outcome").distinct().collect()} == {"skipped", "matched", "mismatched"}
