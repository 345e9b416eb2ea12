"""Smaller pieces against hand-worked cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.functions import values as V
from rulegauge.operators import envelope as E
from rulegauge.operators import extraction as X
from rulegauge.operators import graph as G
from rulegauge.operators import routing as R
from rulegauge.operators import rules as U
from rulegauge.operators import scoring as M
from rulegauge.session import literal_frame, materialize
from rulegauge.sources import rulesets as S
from rulegauge.sources.rulesets import rules_frame


def values(spark, texts):
    return literal_frame(spark, [(i, t) for i, t in enumerate(texts)], "i int, t string")


def test_float_text_matches_python(spark):
    xs = [85.0, 0.0, -0.0, 1e20, 1.5e-7, 12345678.9, 0.0001, 0.00012, 1e16, 123456789012.25, -3.5, 9.99e15, 1e-300, 0.1]
    df = literal_frame(spark, [(x,) for x in xs], "x double")
    assert [r.s for r in df.select(V.float_text(F.col("x")).alias("s")).collect()] == [repr(x) for x in xs]


def test_parse_float_like_a_float_parser(spark):
    texts = ['"12"', '" 1e3 "', '"1_0"', '"1d"', '"n/a"', "true", "null", "[1]", '"inf"', '"-.5"', "7", '""']
    got = values(spark, texts).select(V.parse_float(F.parse_json("t")).alias("x")).collect()
    assert [r.x for r in got] == [12.0, 1000.0, 10.0, None, None, 1.0, None, None, float("inf"), -0.5, 7.0, None]


def test_parse_iso(spark):
    texts = ["2026-01-01", "2026-01-01T00:00:00Z", "2026-01-01T02:00:00+02:00", "2026-13-01", "soon", "", None]
    got = [r.u for r in values(spark, texts).select(V.micros(V.parse_iso(F.col("t"))).alias("u")).collect()]
    assert got[:3] == [1767225600000000] * 3 and got[3:] == [None] * 4


def test_subject_and_slug(spark):
    df = values(spark, ["  So2   PPM ", "A  b"]).select(V.normalize_subject(F.col("t")).alias("n"), V.slug(F.col("t")).alias("s"))
    assert [r.n for r in df.collect()] == ["so2 ppm", "a b"]
    assert df.collect()[1].s == "a.b"


def test_canonical_exact_keeps_numbers(spark):
    df = values(spark, ['{"b": 85.0, "a": "é"}']).select(V.canonical_json_exact("t").alias("e"), V.canonical_json(F.parse_json("t")).alias("n"))
    assert df.first().e == '{"a":"é","b":85.0}' and df.first().n == '{"a":"é","b":85}'


def routed(spark, payload, **rule):
    rules = rules_frame(spark, [dict(rule_id="r", **rule)])
    registry = literal_frame(spark, [("s", "r", 0)], "subject string, rule_id string, ord int")
    recs = literal_frame(spark, payload, "measurement_id string, at int, p string").select(
        "measurement_id", F.lit("t").alias("tenant_id"), F.lit("s").alias("subject"),
        F.when(F.col("at") >= 0, F.timestamp_seconds(F.col("at") + 1_700_000_000)).alias("ts"), F.parse_json("p").alias("measurement"))
    return R.route(recs, registry, rules), recs


def verdicts(df):
    return {r.measurement_id: r.verdict for r in df.collect()}


def test_count_window_flags_burst(spark):
    rows, recs = routed(spark, [(f"m{i}", i, "{}") for i in range(1, 8)], operator="window_count", metric="x", seconds=30, cmp_op="lte", value="5")
    got = verdicts(U.evaluate(rows, recs))
    assert got["m5"] == "CLEAR" and got["m6"] == got["m7"] == "FLAG"
    assert set(verdicts(U.evaluate(rows, None)).values()) == {"DISCRETIONARY"}


def test_average_window_and_missing_path(spark):
    rows, recs = routed(spark, [("a", 0, '{"x":60}'), ("b", 10, '{"x":80}'), ("c", 1000, '{"y":1}')], operator="window_avg", metric="x",
                        seconds=60, cmp_op="lte", value="70")
    assert verdicts(U.evaluate(rows, recs)) == {"a": "CLEAR", "b": "CLEAR", "c": "NULL_UNMAPPED"}
    rows, recs = routed(spark, [("a", 0, '{"x":60}')], operator="window_avg", metric="x", seconds=60, cmp_op="near", value="70")
    assert verdicts(U.evaluate(rows, recs)) == {"a": "DISCRETIONARY"}


def test_self_lookup_modes(spark):
    rows, recs = routed(spark, [("a", 0, "{}"), ("b", 100, "{}"), ("c", 110, "{}"), ("n", -1, "{}")], operator="debounce", seconds=60)
    assert verdicts(U.evaluate(rows, recs)) == {"a": "CLEAR", "b": "CLEAR", "c": "DISCRETIONARY", "n": "DISCRETIONARY"}
    assert verdicts(U.evaluate(rows, recs, include_self=True))["a"] == "DISCRETIONARY"


def test_stale_gate_comes_first(spark):
    rows, recs = routed(spark, [("a", 0, '{"x":500}'), ("b", 30, '{"x":500}')], operator="lte", metric="x", value="100", fresh_seconds=60)
    assert verdicts(U.evaluate(rows, recs)) == {"a": "NULL_STALE", "b": "FLAG"}


def test_nan_never_compares(spark):
    rows, _ = routed(spark, [("a", 0, '{"x":"nan"}')], operator="range", metric="x", low=0.0, high=1.0)
    assert verdicts(U.evaluate_stateless(rows)) == {"a": "FLAG"}


def test_rule_without_predicate(spark):
    rows, _ = routed(spark, [("a", 0, '{"x":1}')], metric="x")
    assert verdicts(U.evaluate_stateless(rows)) == {"a": "DISCRETIONARY"}


def test_scope_variants_against_brute_force(spark):
    rng = random.Random(4)
    places = [None, '"us.federal"', '" US.Federal "', '"global"', '"*"', '""', '["ca.alberta", "us.federal"]', '["GLOBAL", "x"]', "[]", "7"]
    days = [None, "2024-01-03", "2024-01-05T12:00:00Z", "bad", "2024-01-10"]
    rules = [dict(rule_id=f"r{i}", jurisdiction=rng.choice(places), effective_date=rng.choice(days), sunset_date=rng.choice(days),
                  risk_tier=rng.choice(["high", "low", None, "medium"])) for i in range(40)]
    recs = [(f"m{i}", rng.choice([None, "us.federal", "CA.Alberta ", "mars"]), rng.randrange(0, 14 * 24)) for i in range(60)]
    df = literal_frame(spark, recs, "measurement_id string, jurisdiction string, h int").withColumn(
        "ts", F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600))
    prepared = rules_frame(spark, rules)
    got = {(r.measurement_id, r.rule_id) for r in R.scope(df, prepared.select("rule_id", "tokens", "from_us", "to_us")).collect()}
    hours = {"2024-01-03": 48, "2024-01-05T12:00:00Z": 108, "2024-01-10": 216}
    import json
    want = set()
    for mid, place, hour in recs:
        for r in rules:
            lo, hi = hours.get(r["effective_date"]), hours.get(r["sunset_date"])
            if (lo is not None and lo > hour) or (hi is not None and hi < hour):
                continue
            j = None if r["jurisdiction"] is None else json.loads(r["jurisdiction"])
            names = None if j is None else [x.strip().lower() for x in ([j] if isinstance(j, str) else j if isinstance(j, list) else [])]
            if place is None or names is None or any(n in ("global", "*", "") or n == place.strip().lower() for n in names):
                want.add((mid, r["rule_id"]))
    assert got == want
    snap = {r.measurement_id: (r.n_in, r.n_out, r.tier) for r in R.snapshot(df, prepared).collect()}
    rank = {"high": 1, "low": 3, None: 2, "medium": 2}
    for mid, _, _ in recs:
        mine = [r for r in rules if (mid, r["rule_id"]) in want]
        assert snap[mid] == (40, len(mine), min((rank[r["risk_tier"]] for r in mine), default=2))


def test_chunks_against_character_walk():
    def walk(text, size, overlap):
        if len(text) <= size:
            return [text]
        out, start = [], 0
        while True:
            stop = min(start + size, len(text))
            if stop < len(text):
                for at in range(stop, start + size // 2, -1):
                    if text[at] in ".!?\n":
                        stop = at + 1
                        break
            out.append(text[start:stop])
            if stop >= len(text):
                return out
            start = stop - overlap
    rng = random.Random(9)
    for size, overlap in ((40, 5), (10, 0), (7, 3), (100, 20)):
        for n in (0, 1, size - 1, size, size + 1, 3 * size, 500):
            text = "".join(rng.choice("abcdé漢 .!?\n") if rng.random() < 0.9 else "x" for _ in range(n))
            assert [text[a:b] for a, b in X.chunk_spans(text, size, overlap)] == walk(text, size, overlap)
    plain = "x" * 1000
    assert [plain[a:b] for a, b in X.chunk_spans(plain, 100, 20)] == walk(plain, 100, 20)
    # a break closer than the overlap still moves forward
    assert X.chunk_spans("a" * 60 + "." + "a" * 100, 100, 90)[-1][1] == 161


def test_chunk_arguments(spark):
    docs = literal_frame(spark, [("d", "text")], "doc_id string, text string")
    for bad in (dict(size=0), dict(size=5, overlap=5), dict(size=5, overlap=-1)):
        with pytest.raises(ValueError):
            X.chunk(docs, **bad)


def test_document_text(spark):
    docs = literal_frame(spark, [("a.txt", "x"), ("b.MD", "y"), ("c.pdf", "z")], "path string, content string")
    assert [(r.text, r.problem) for r in X.document_text(docs).collect()] == [("x", None), ("y", None), (None, "unsupported: pdf")]


def test_lookup_takes_any_text_as_a_key(spark):
    doc = '{"a\\"b": 1, "x[0]": {"k\'": 2}, "p": {"q": 3}}'
    paths = ['a"b', "x[0].k'", "p.q", 'no"pe', "x[0", "p.q.r", '"]["']
    df = literal_frame(spark, [(p, doc) for p in paths], "p string, d string").withColumn("v", F.try_parse_json("d"))
    got = [r.t for r in df.select(F.to_json(V.lookup(F.col("v"), F.col("p"))).alias("t")).collect()]
    assert got == ["1", "2", "3", None, None, None, None]
    keys = [r.t for r in df.select(F.to_json(V.flat_key(F.col("v"), F.col("p"))).alias("t")).collect()]
    assert keys == ["1", None, None, None, None, None, None]


def test_registry_keeps_document_order(spark):
    doc = literal_frame(spark, [("s", '{"tag_registry": {"pump": "r1", "Zed": "r9", "Pump": "r2"}}')], "source string, text string")
    got = [(r.ord, r.subject, r.rule_id) for r in S.flat_registry(doc).orderBy("ord").collect()]
    assert got == [(0, "pump", "r1"), (1, "Zed", "r9"), (2, "Pump", "r2")]


def test_percentages_are_checked(spark):
    with pytest.raises(ValueError):
        M.percentiles(literal_frame(spark, [("g", 1.0)], "g string, x double"), "x", qs=(101,))


@pytest.mark.parametrize("first,second,unit,clash", [
    (("1950-01-01", "1955-01-01"), ("1960-01-01", "1965-01-01"), 86_400, False),
    (("1950-01-01", "1961-01-01"), ("1960-01-01", "1965-01-01"), 86_400, True),
    (("2024-01-01", "2024-01-31"), ("2024-06-01", "2024-06-30"), 3_600, False),
    (("2160-01-01", "2170-01-01"), ("2150-01-01", "2159-12-31"), 86_400, False),
    (("2160-01-01", None), (None, "2170-01-01"), 86_400, True), ((None, "1920-01-01"), ("1920-01-02", None), 86_400, False)])
def test_contradictions_in_any_century_and_unit(spark, first, second, unit, clash):
    rules = rules_frame(spark, [dict(rule_id="floor", metric="m", operator="must_be_at_least", value="100", effective_date=first[0], sunset_date=first[1]),
                                dict(rule_id="cap", metric="m", operator="must_not_exceed", value="50", effective_date=second[0], sunset_date=second[1])])
    assert [r.rule_id for r in G.contradictions(rules, unit_seconds=unit).collect()] == (["floor"] if clash else [])


@pytest.mark.parametrize("one,two,clash", [('"global"', '"ca.alberta"', True), ('"ca.alberta"', '"global"', True), ('"global"', '"*"', True),
                                           ('"ca.alberta"', '"us.federal"', False)])
def test_contradictions_with_rules_for_everywhere(spark, one, two, clash):
    rules = rules_frame(spark, [dict(rule_id="floor", metric="m", operator="must_be_at_least", value="100", jurisdiction=one),
                                dict(rule_id="cap", metric="m", operator="must_not_exceed", value="50", jurisdiction=two)])
    assert [(r.rule_id, r.witness_id) for r in G.contradictions(rules).collect()] == ([("floor", "cap")] if clash else [])


def test_contradictions_against_brute_force(spark):
    rng = random.Random(11)
    kinds = ["must_be_at_least", "must_be_above", "must_not_exceed", "must_be_below", "must_equal", "must_be_within"]
    rules, spec = [], []
    for i in range(60):
        kind, v, first = rng.choice(kinds), rng.randrange(0, 12), rng.randrange(0, 200)
        last = None if rng.random() < 0.2 else first + rng.randrange(0, 40)
        day = lambda d: None if d is None else f"2021-{1 + d // 28:02d}-{1 + d % 28:02d}"
        rules.append(dict(rule_id=f"r{i:02d}", metric=f"m{i % 2}", operator=kind, value=f"[{v}, {v + 3}]" if kind == "must_be_within" else str(v),
                          effective_date=day(first), sunset_date=day(last)))
        lo = v if kind in ("must_be_at_least", "must_be_above", "must_equal", "must_be_within") else None
        hi = v + 3 if kind == "must_be_within" else v if kind in ("must_not_exceed", "must_be_below", "must_equal") else None
        spec.append((f"r{i:02d}", f"m{i % 2}", lo, kind == "must_be_above", hi, kind == "must_be_below", day(first), day(last) or "9999"))
    want = set()
    for a in spec:
        for b in spec:
            if a[1] == b[1] and a[2] is not None and b[4] is not None and a[6] <= b[7] and b[6] <= a[7]:
                if a[2] > b[4] or (a[2] == b[4] and (a[3] or b[5])):
                    want.add(a[0])
    assert {r.rule_id for r in G.contradictions(rules_frame(spark, rules)).collect()} == want


def test_cycles_against_brute_force(spark):
    rng = random.Random(3)
    edges = [("amended_by", f"n{rng.randrange(30):02d}", f"n{rng.randrange(30):02d}") for _ in range(34)]
    reach = {}
    for _, a, b in edges:
        reach.setdefault(a, set()).add(b)

    def loops(start):
        seen, todo = set(), list(reach.get(start, ()))
        while todo:
            x = todo.pop()
            if x == start:
                return True
            if x not in seen:
                seen.add(x)
                todo += reach.get(x, ())
        return False
    got = {r.node_id for r in G.precedent_cycles(literal_frame(spark, edges, "type string, from_id string, to_id string")).collect()}
    assert got == {n for n in reach if loops(n)}


def test_policy_grid(spark):
    rows = [(s, t, a) for s in P.STATUSES for t in (1, 2, 3) for a in (True, False)]
    df = literal_frame(spark, rows, "s string, t int, a boolean")
    got = {(r.s, r.t, r.a): r.p.verdict for r in df.select("*", E.risk_policy(F.lit("CLEAR"), F.col("s"), F.col("t"), F.col("a")).alias("p")).collect()}
    for (s, t, a), verdict in got.items():
        forced = s != "AGREED" and (t == 1 or (t == 2 and s in ("LLM_CONTRADICTION", "NEURO_SYMBOLIC_DIVERGENCE") and not a)
                                    or (t == 3 and s == "LLM_CONTRADICTION"))
        assert verdict == ("DISCRETIONARY" if forced else "CLEAR")
    with pytest.raises(ValueError):
        E.risk_policy(F.lit("CLEAR"), F.col("s"), F.col("t"), F.col("a"), policy="other")


def test_percentiles_nearest_rank(spark):
    rng = random.Random(2)
    for n in (1, 2, 19, 100, 101):
        xs = [round(rng.uniform(-50, 5000), 1) for _ in range(n)]
        got = M.percentiles(literal_frame(spark, [("g", x) for x in xs], "g string, x double"), "x", by=["g"]).first()
        for q in (50, 90, 95, 99):
            assert got[f"p{q}_ms"] == sorted(xs)[max(1, -(-q * n // 100)) - 1]


def test_latency_of_one_sample(spark):
    got = M.latency_summary(literal_frame(spark, [("g", 12.5)], "g string, x double"), "x", by=["g"]).first()
    assert got.stdev_ms == 0.0 and got.p99_ms == 12.5 and got.throughput_per_s == 80.0


def test_partition_count_does_not_matter(spark):
    from rulegauge.plans.catalog import QUERIES
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, QUERIES["win_sum"](spark, "/root/testdata/sf0.001").collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_responses_are_parsed_once(spark):
    """Arrays, objects with rules, and what is neither; the optimizer puts no second reading of the text under the explode."""
    texts = ['[{"id":"a"},null,3]', '{"rules":[{"id":"b"}]}', '{"rules":{"id":"c"}}', '{"rules":null}', '[]', "null", '"[1]"', "7", "no json", None]
    rows = materialize(literal_frame(spark, list(enumerate(texts)), "n int, response string"))
    good, bad = X.unwrap(rows)
    assert sorted((r.n, r.pos) for r in good.select("n", "pos").collect()) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert {r.n: r.reason for r in bad.collect()} == {
        **dict.fromkeys((2, 3, 5, 6, 7), "no_rule_array"), **dict.fromkeys((8, 9), "not_json")}
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") + plan.count("parse_json") == 1 and "schemaOfVariant" not in plan


def test_places_are_worked_out_per_record_not_per_pair(spark):
    rules = rules_frame(spark, [dict(rule_id="a", metric="x", operator="must_not_exceed", value="5", jurisdiction='"Us"'),
                                dict(rule_id="b", metric="x", operator="must_equal", value="true")])
    rows = literal_frame(spark, [(1, " US ", '{"x":6}'), (2, "ca", '{"x":1}'), (3, None, '{"x":"t"}'), (4, "us", '{"y":1}'), (5, "us", '{"x":true}')],
                         "measurement_id bigint, jurisdiction string, json string")
    records = rows.select("measurement_id", "jurisdiction", F.lit("2024-01-01").cast("timestamp").alias("ts"), F.parse_json("json").alias("measurement"))
    got = E.verdict_all(records, rules)
    assert {(r.measurement_id, r.n_mapped, r.n_breached, r.n_open, r.verdict) for r in got.collect()} == {
        (1, 2, 2, 0, "FLAG"), (2, 1, 0, 0, "CLEAR"), (3, 2, 1, 1, "FLAG"), (4, 0, 0, 0, "NULL_UNMAPPED"), (5, 2, 0, 0, "CLEAR")}
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert joins and not any("regexp_replace" in line for line in joins)
