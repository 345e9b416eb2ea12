"""Fifty golden cases through the whole path: the pinned scores must come out."""

import json

from pyspark.sql import functions as F

from rulegauge.operators import envelope as E
from rulegauge.operators import scoring as M
from rulegauge.session import literal_frame
from rulegauge.sources.rulesets import rules_frame

# The ten rules of the golden set.
RULES = [
    dict(rule_id="energy.so2.cap", metric="so2_ppm", operator="must_not_exceed", value="100", jurisdiction='"us.federal"',
         effective_date="2026-01-01T00:00:00Z"),
    dict(rule_id="energy.ph.range", metric="ph", operator="must_be_within", value="[6.0, 8.5]", jurisdiction='"global"'),
    dict(rule_id="energy.nox.cap", metric="nox_ppm", operator="must_not_exceed", value="75", jurisdiction='"us.federal"'),
    dict(rule_id="energy.flow.min", metric="flow_m3h", operator="must_be_at_least", value="10", jurisdiction='"global"'),
    dict(rule_id="energy.temp.range", metric="temp_c", operator="must_be_within", value="[5, 40]", jurisdiction='"global"'),
    dict(rule_id="energy.opacity.cap.ab", metric="opacity_pct", operator="must_not_exceed", value="20", jurisdiction='"ca.alberta"'),
    dict(rule_id="energy.co.cap.future", metric="co_ppm", operator="must_not_exceed", value="50", jurisdiction='"us.federal"',
         effective_date="2026-09-01T00:00:00Z"),
    dict(rule_id="energy.benzene.cap.sunset", metric="benzene_ppb", operator="must_not_exceed", value="5",
         jurisdiction='"us.federal"', sunset_date="2026-03-31T00:00:00Z"),
    dict(rule_id="energy.methane.cap", metric="methane_kg_h", operator="must_not_exceed", value="12", jurisdiction='"us.federal"'),
    dict(rule_id="energy.turbidity.cap", metric="turbidity_ntu", operator="must_not_exceed", value="1", jurisdiction='"global"'),
]
US, AB = "us.federal", "ca.alberta"
# Fixed values: (metric, readings that are clear, readings that breach, readings no rule covers, place).
READINGS = [
    ("so2_ppm", [85, 42, 100, 99.9], [142, 100.1, 500, 101], [], US),
    ("ph", [7.2, 6.0, 8.5, 7.9], [5.4, 9.1, 0.0, 8.6], [], US),
    ("nox_ppm", [60, 75, 1], [76, 200], [], US),
    ("flow_m3h", [15, 10], [9.9, 0], [], US),
    ("temp_c", [20, 5, 40], [4.9, 41], [], US),
    ("methane_kg_h", [11.9], [12.1, 30], [], US),
    ("turbidity_ntu", [0.5, 1.0], [3], [], US),
    ("opacity_pct", [15], [25], [], AB),
    ("opacity_pct", [], [], [25, 10], US),
    ("helium_ppm", [], [], [5], US), ("noise_dba", [], [], [80], US), ("spill_volume_l", [], [], [200], US),
    ("so2", [], [], [142], US), ("x", [], [], [1], US),
    ("co_ppm", [], [], [60, 10], US), ("benzene_ppb", [], [], [7, 2], US), ("so2_ppm", [], [], [142], AB),
]
RULE_OF = {(r["metric"]): r["rule_id"] for r in RULES}


def golden(spark):
    rows = []
    for metric, clear, breach, gap, place in READINGS:
        for verdict, values in (("CLEAR", clear), ("FLAG", breach), ("NULL_UNMAPPED", gap)):
            for v in values:
                rows.append((f"{metric}-{place}-{v}", f"facility.{metric}", place, json.dumps({metric: v}), verdict,
                             None if verdict == "NULL_UNMAPPED" else RULE_OF[metric]))
    frame = literal_frame(spark, rows, "case_id string, subject string, jurisdiction string, payload string, expected string, rule string")
    return frame.withColumns({"measurement_id": F.col("case_id"), "ts": F.lit("2026-06-15 12:00:00").cast("timestamp"),
                              "measurement": F.parse_json("payload")})


def results(spark, proposals=None):
    cases = golden(spark)
    env = E.envelopes(cases, rules_frame(spark, RULES), proposals)
    shape = "array<struct<obligation_id:string,satisfied:boolean>>"
    want = F.when(F.col("rule").isNull(), F.array().cast(shape)).otherwise(F.array(F.struct(
        F.col("rule").alias("obligation_id"), (F.col("expected") == "CLEAR").alias("satisfied"))).cast(shape))
    got = F.transform("assertions", lambda a: F.struct(a["obligation_id"].alias("obligation_id"), a["satisfied"].alias("satisfied")))
    return cases.join(env, "measurement_id").select(
        "case_id", F.col("subject").alias("category"), F.col("expected").alias("expected_verdict"),
        F.col("verdict").alias("predicted_verdict"), want.alias("expected_assertions"), got.alias("emitted_assertions"),
        "verifier_status", "checked_assertions", F.lit("").alias("notes"))


def test_golden_pins(spark):
    out = results(spark)
    totals = {r.expected_verdict: r["count"] for r in out.groupBy("expected_verdict").count().collect()}
    assert totals == {"CLEAR": 20, "FLAG": 18, "NULL_UNMAPPED": 12}
    m = M.score(out).first()
    assert m.n_cases == 50 and m.verdict_accuracy == 0.96
    assert m.flag_recall == round(16 / 18, 4) and m.flag_precision == 1.0
    assert m.breaches_silently_cleared == 0 and m.unmapped_recall == 1.0
    assert m.assertion_accuracy == 1.0 and m.verifier_agreement_rate == round(36 / 38, 4)


def test_golden_blind_spots(spark):
    wrong = {(r.case_id, r.predicted, r.verifier_status) for r in M.mismatches(results(spark)).collect()}
    assert wrong == {(f"flow_m3h-{US}-{v}", "DISCRETIONARY", "NEURO_SYMBOLIC_DIVERGENCE") for v in (9.9, 0)}


def test_all_obligations_have_no_blind_spot(spark):
    got = E.verdict_all(golden(spark), rules_frame(spark, RULES), carry=["expected"])
    assert got.filter("verdict <> expected").count() == 0
