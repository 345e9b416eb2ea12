"""Rules in force by version: the interval index against a test of every rule."""

import random

import pytest
from pyspark.sql import functions as F

from rulegauge.operators import graph as G
from rulegauge.operators import routing as R
from rulegauge.session import literal_frame
from rulegauge.sources.rulesets import rules_frame


def day(n):
    return None if n is None else f"20{20 + n // 336:02d}-{1 + n // 28 % 12:02d}-{1 + n % 28:02d}"


@pytest.mark.parametrize("seed, n", [(1, 0), (2, 1), (3, 40), (4, 150)])
def test_snapshot_rules_against_every_rule(spark, seed, n):
    rng = random.Random(seed)
    places = ['"us"', '"ca"', '["us", "ca"]', '"*"', '"global"', '""', None]
    spec = []
    for i in range(n):
        first = None if rng.random() < 0.1 else rng.randrange(600)
        last = None if rng.random() < 0.2 else (first or 0) + rng.randrange(-2, 90)
        spec.append((f"r{i:03}", first, last, rng.choice(places)))
    rules = rules_frame(spark, [dict(rule_id=i, metric="m", operator="must_equal", value="1", effective_date=day(a), sunset_date=day(b),
                                     **({} if p is None else {"jurisdiction": p})) for i, a, b, p in spec])
    asked = [(f"m{k}", k % 700, rng.choice(["us", "CA ", "eu", None])) for k in range(80)]
    records = literal_frame(spark, [(i, day(d), p) for i, d, p in asked] + [("none", None, "us")],
                            "measurement_id string, d string, jurisdiction string").withColumn("ts", F.to_timestamp("d"))
    got = {r.measurement_id: r.rule_ids for r in R.snapshot_rules(records, rules).collect()}
    open_ = rules.select("rule_id", "tokens", "from_us", "to_us", "ord").collect()
    us = {r.measurement_id: r.us for r in records.select("measurement_id", F.unix_micros("ts").alias("us")).collect()}
    want = {}
    for i, _, p in asked:
        held = [r for r in sorted(open_, key=lambda r: (r.ord, r.rule_id)) if r.from_us <= us[i] <= r.to_us
                and (p is None or set(r.tokens) & {"*", p.strip().lower()})]
        if held:
            want[i] = [r.rule_id for r in held]
    assert got == want


def test_index_is_linear_in_the_rules(spark):
    rules = rules_frame(spark, [dict(rule_id=f"r{i}", metric="m", operator="must_equal", value="1", effective_date=day(i), sunset_date=day(500 + i))
                                for i in range(200)])
    versions, nodes = R.rule_index(rules)
    listed = nodes.agg(F.sum(F.size("rules"))).first()[0]
    # two place tokens a rule; a run of n versions is cut into less than two blocks a level
    assert versions.count() <= 2 * 401 and listed <= 2 * 200 * 2 * 9


def test_shared_ids_have_their_own_rules(spark):
    rules = rules_frame(spark, [dict(rule_id="old", metric="m", operator="must_equal", value="1", sunset_date="2020-01-31"),
                                dict(rule_id="new", metric="m", operator="must_equal", value="1", effective_date="2020-02-01")])
    records = literal_frame(spark, [("a", "t1", "2020-01-05"), ("a", "t2", "2020-03-05")], "measurement_id string, tenant_id string, d string").select(
        "measurement_id", "tenant_id", F.to_timestamp("d").alias("ts"), F.lit(None).cast("string").alias("jurisdiction"))
    assert {(r.tenant_id, *r.rule_ids) for r in R.snapshot_rules(records, rules).collect()} == {("t1", "old"), ("t2", "new")}


def test_unknown_edge_type_is_a_finding(spark):
    nodes = literal_frame(spark, [("a", "Rule"), ("b", "Obligation")], "id string, type string")
    edges = literal_frame(spark, [("consists_of", "a", "b"), ("bogus_edge", "a", "b")], "type string, from_id string, to_id string")
    found = G.edge_target_types(nodes, edges).collect()
    assert len(found) == 1 and "bogus_edge" in str(found[0])


def test_values_demanded_and_forbidden(spark):
    def clash(*spec):
        rules = [dict(rule_id=i, metric="m", operator=kind, value=v, **more) for i, kind, v, more in spec]
        return [(r.rule_id, r.witness_id) for r in G.value_clashes(rules_frame(spark, rules)).collect()]
    equal, other = ("eq", "must_equal", "5", {}), ("ne", "must_not_equal", "5", {})
    assert clash(equal, other) == [("eq", "ne")]
    assert clash(equal, ("ne", "must_not_equal", "6", {})) == []
    assert clash(("eq", "must_equal", '"a"', {}), ("z", "must_not_be_one_of", '["b", "a"]', {}), ("y", "must_not_equal", '"a"', {})) == [("eq", "y")]
    assert clash(("eq", "must_equal", "5", dict(sunset_date="2021-01-01")), ("ne", "must_not_equal", "5", dict(effective_date="2021-01-03"))) == []
    assert clash(("eq", "must_equal", "5", dict(jurisdiction='"us"')), ("ne", "must_not_equal", "5", dict(jurisdiction='"ca"'))) == []
    assert clash(("eq", "must_equal", "5", dict(jurisdiction='"*"')), ("ne", "must_not_equal", "5", dict(jurisdiction='"ca"'))) == [("eq", "ne")]


@pytest.mark.parametrize("seed, n", [(1, 0), (2, 1), (5, 60)])
def test_demands_against_every_pair(spark, seed, n):
    rng = random.Random(seed)
    spec = []
    for i in range(n):
        first = None if rng.random() < 0.1 else rng.randrange(600)
        last = None if rng.random() < 0.1 else (first or 0) + rng.randrange(0, 60)
        spec.append((f"r{i:03}", rng.choice(["m", "k"]), rng.choice(['"a"', '"b"', "5", "true"]), first, last, rng.choice(["us", "ca", "*"])))
    rules = rules_frame(spark, [dict(rule_id=i, metric=m, operator="must_equal", value=v, effective_date=day(a), sunset_date=day(b), jurisdiction=f'"{p}"')
                                for i, m, v, a, b, p in spec] + [dict(rule_id="no", metric="m", operator="must_not_equal", value="9")])
    key = {r.rule_id: r.key for r in rules.select("rule_id", F.col("duty")["key"].alias("key")).collect()}
    want = set()
    for i, m, _, a, b, p in spec:
        met = sorted((key[j], j) for j, m2, _, a2, b2, q in spec if m2 == m and (p == q or "*" in (p, q))
                     and (b is None or (day(a2) or "") <= day(b)) and (b2 is None or (day(a) or "") <= day(b2)))
        other = next((x for x in (met[0], met[-1]) if x[0] != key[i]), None)
        if other:
            want.add((m, p, i, other[1]))
    got = [(r.metric, r.token, r.rule_id, r.witness_id) for r in G.demand_clashes(rules).collect()]
    assert len(got) == len(want) and set(got) == want


def test_totals_are_those_of_the_lists(spark):
    """Rules that come twice, with overlapping periods or once for a place and once for everywhere, count once."""
    spec = [("7", "us", 0, 300), ("7", "us", 200, 400), ("7", "*", 350, 500), ("8", "us", 10, 20), ("8", "us", 10, 20), ("9", "ca", 0, 900)]
    rules = rules_frame(spark, [dict(rule_id=i, ord=1, jurisdiction=f'"{p}"', effective_date=day(a), sunset_date=day(b)) for i, p, a, b in spec])
    records = literal_frame(spark, [(f"m{d}", day(d), p) for d, p in ((15, "us"), (250, "us"), (375, "us"), (450, "eu"), (250, None), (899, "us"))],
                            "measurement_id string, d string, jurisdiction string").select(
        F.concat("measurement_id", F.coalesce("jurisdiction", F.lit("-"))).alias("measurement_id"), F.to_timestamp("d").alias("ts"), "jurisdiction")
    versions, nodes = R.rule_index(rules)
    placed = R.rule_versions(records, versions, carry=("jurisdiction",))
    sums = R.version_rules(placed, nodes, totals={"n": F.lit(1), "total": F.col("rule_id").cast("bigint")})
    got = {r.measurement_id: (r.n, r.total) for r in placed.join(sums, "stand").collect()}
    assert got == {"m15us": (2, 15), "m250us": (1, 7), "m375us": (1, 7), "m450eu": (1, 7), "m250-": (2, 16)}
    listed = {r.measurement_id: r.rule_ids for r in R.snapshot_rules(records, rules).collect()}
    assert listed == {"m15us": ["7", "8"], "m250us": ["7"], "m375us": ["7"], "m450eu": ["7"], "m250-": ["7", "9"]}


def test_clashing_rules_are_spread_before_their_entries(spark):
    """One file of rules is one task until it is spread; what multiplies its rows comes after that."""
    rules = rules_frame(spark, [dict(rule_id=f"r{i}", metric="m", operator="must_equal", value=str(i % 2), effective_date=day(i)) for i in range(20)]).coalesce(1)
    for found in (G.demand_clashes(rules), G.value_clashes(rules), G.contradictions(rules)):
        lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
        spread = [i for i, line in enumerate(lines) if "Repartition" in line]
        assert len(spread) == 2
        for i in spread:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            assert not any("Generate" in line or "transform(" in line for line in lines[i + 1:below])


def test_an_id_that_comes_twice_has_each_rule_once(spark):
    rules = rules_frame(spark, [dict(rule_id="1", ord=1, jurisdiction='["us", "ca"]', effective_date=day(0), sunset_date=day(300)),
                                dict(rule_id="2", ord=2, jurisdiction='"*"', effective_date=day(100), sunset_date=day(200))])
    records = literal_frame(spark, [("same", day(150), "us"), ("same", day(150), "us"), ("times", day(50), "us"), ("times", day(150), "us"),
                                    ("places", day(50), "us"), ("places", day(50), "ca")], "measurement_id string, d string, jurisdiction string").select(
        "measurement_id", F.to_timestamp("d").alias("ts"), "jurisdiction")
    want = {"same": ["1", "2"], "times": ["1", "2"], "places": ["1"]}
    assert {r.measurement_id: r.rule_ids for r in R.snapshot_rules(records, rules).collect()} == want
    versions, nodes = R.rule_index(rules)
    placed = R.rule_versions(records, versions)
    sums = R.version_rules(placed, nodes, totals={"n": F.lit(1)})
    assert {r.measurement_id: r.n for r in placed.join(sums, "stand").collect()} == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("n_lines, kind", [(100_000, "decimal(38,0)"), (10, "bigint")])
def test_key_sums_beyond_bigint(spark, tmp_path, n_lines, kind):
    """Sixty thousand rules of one place and first day with large keys, and records of their second day."""
    from rulegauge.plans.catalog import QUERIES
    keys = 2_000_000_000 - F.col("id") * 2600
    spark.range(60_000).select(keys.alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    second = F.date_add(F.lit("1992-01-02").cast("date"), 2_000_000_000 * 37 % 2600)
    spark.range(n_lines).select((F.col("id") * 4).alias("l_orderkey"), second.alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["scope_many_rules"](spark, str(tmp_path))
    want = n_lines * sum(2_000_000_000 - i * 2600 for i in range(60_000))
    assert [(r.place, r.n_records, r.n_in_force, int(r.key_sum)) for r in got.collect()] == [("p0", n_lines, n_lines * 60_000, want)]
    assert dict(got.dtypes)["key_sum"] == kind and (want > 2**63) == (kind != "bigint")


@pytest.mark.parametrize("clashes", [G.contradictions, G.demand_clashes])
def test_entries_of_clashing_rules_are_never_broadcast(spark, clashes):
    """A file of rules looks small beside the entries made of it; a broadcast of these would go through the driver."""
    rules = rules_frame(spark, [dict(rule_id=f"{i}{kind}", metric="m", operator=kind, value=str(i % 2), effective_date=day(i % 9), sunset_date=day(20))
                                for i in range(40) for kind in ("must_equal", "must_be_below")])
    found = clashes(rules)
    assert len(found.collect()) == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # what becomes entries are the nine different periods, asked about under one mark and held under two
    made = {x.rsplit("/", 1)[0] for x in found.inputFiles() if "/asked-" in x or "/held-" in x}
    assert sorted(spark.read.parquet(f).count() for f in made) == [9, 18]
