"""Records that come late: marked, never answered as if nothing were missing."""

import pytest
from pyspark.sql import functions as F

from rulegauge.session import literal_frame, work_path
from rulegauge.streaming import jobs as J

SCHEMA = "measurement_id string, tenant_id string, subject string, s bigint, x double"


@pytest.fixture
def fed(spark):
    """Feeds parts one after the other, each in a run of its own that resumes from the state before."""
    def run(parts, build):
        feed, out, state = (work_path(spark, f"late-{what}") for what in ("feed", "out", "state"))
        for part in parts:
            rows = literal_frame(spark, [(f"r{s}", "t", "a", s, float(s)) for s in part], SCHEMA).select(
                "*", F.timestamp_seconds("s").alias("ts"),
                F.parse_json(F.concat(F.lit('{"x":'), F.col("x").cast("string"), F.lit("}"))).cast("string").alias("json"))
            rows.coalesce(1).write.mode("append").parquet(feed)
            stream = J.read_parquet_stream(spark, feed, rows.schema).withColumn("measurement", F.try_parse_json("json"))
            made = build(stream)
            J.advance(made, out, state)
        return spark.read.schema(made.schema).parquet(out)
    return run


def test_late_duplicate_has_no_online_verdict(fed):
    got = {r.measurement_id: (r.verdict, r.late) for r in fed([[100, 200, 1000], [150, 1010]], lambda s: J.debounce(s, seconds=60)).collect()}
    assert got == {"r100": ("CLEAR", False), "r200": ("CLEAR", False), "r1000": ("CLEAR", False), "r150": (None, True),
                   "r1010": ("DISCRETIONARY", False)}


def test_window_over_dropped_state_goes_to_replay(fed):
    day = 86_400
    got = {r.measurement_id: (r["count"], r.late, r.to_replay) for r in fed(
        [[1000, 1010], [3 * day], [1020, 3 * day + 5]], lambda s: J.trailing_windows(s, seconds=60, path="x")).collect()}
    assert got["r1010"] == (2, False, False) and got[f"r{3 * day + 5}"] == (2, False, False)
    assert got["r1020"][1:] == (True, True)


def test_late_record_makes_no_false_silence(fed):
    got = fed([[90, 95, 100], [80], [105, 130]], lambda s: J.silence(s, seconds=10, key="tenant_id"))
    assert [r.silent_from_us for r in got.collect()] == [105_000_000]


# ---- answers that are put right -----------------------------------------------------------------------

RECORD = "measurement_id string, tenant_id string, subject string, s bigint, x double, jurisdiction string"


def told(spark, batches, operator, **rule):
    """Feed ``batches`` of (id, tenant, second, x) one after the other; the answers, all versions, and the batch answer."""
    from rulegauge.operators import routing as R
    from rulegauge.operators import rules as U
    from rulegauge.sources.rulesets import rules_frame
    from rulegauge.streaming import verdicts as O
    registry = literal_frame(spark, [("a", "r", 0)], "subject string, rule_id string, ord int")
    rules = rules_frame(spark, [dict(rule_id="r", operator=operator, **rule)])

    def records(rows):
        return rows.select("measurement_id", "tenant_id", "subject", F.timestamp_seconds("s").alias("ts"), "jurisdiction",
                           F.try_parse_json(F.concat(F.lit('{"x":'), F.col("x").cast("string"), F.lit("}"))).alias("measurement"))
    feed, out, past, state = (work_path(spark, f"told-{what}") for what in ("feed", "out", "history", "state"))
    every = None
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for batch in batches:
        rows = literal_frame(spark, [(i, t, "a", s, float(x), None) for i, t, s, x in batch], RECORD)
        every = rows if every is None else every.unionByName(rows)
        rows.coalesce(1).write.mode("append").parquet(feed)
        O.run(records(J.read_parquet_stream(spark, feed, rows.schema)), O.OneRule(registry, rules), out, history=past, state=state)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = lambda r: (r.tenant_id, r.measurement_id)
    want = {key(r): r.verdict for r in U.evaluate(R.route(records(every), registry, rules), records(every)).collect()}
    got = {key(r): r.verdict for r in O.current(spark, out).collect()}
    return got, want, [(r.measurement_id, r.retracted, r.verdict) for r in O.retractions(spark, out).collect()]


def test_late_record_corrects_windows_and_itself(spark):
    batches = [[("a", "t", 100, 1), ("b", "t", 110, 1), ("far", "t", 500, 1)], [("late", "t", 105, 9), ("on", "t", 510, 1)],
               [("later", "t", 90, 9), ("x", "u", 1, 1)]]
    got, want, back = told(spark, batches, "window_sum", metric="x", seconds=60, cmp_op="lt", value="11")
    assert got == want and got["t", "b"] == "FLAG" and got["t", "far"] == "CLEAR"
    assert ("b", "CLEAR", "FLAG") in back and got["t", "late"] == "FLAG"


def test_late_record_corrects_the_one_after_it(spark):
    batches = [[("a", "t", 100, 1), ("c", "t", 100_000, 1)], [("b", "t", 99_990, 1), ("tie", "t", 100_000, 1)], [("d", "t", 100_050, 1)]]
    got, want, back = told(spark, batches, "debounce", seconds=60)
    assert got == want and ("c", "CLEAR", "DISCRETIONARY") in back


def test_random_lateness_ends_as_the_batch(spark):
    import random
    rng = random.Random(5)
    rows = [(f"m{i:03}", rng.choice("tu"), rng.randrange(0, 4000), rng.randrange(9)) for i in range(150)]
    rows = [(i, t, s, x, s + rng.choice([0, 0, 0, 0, 5, 700, 3500])) for i, t, s, x in rows]
    batches = [[r[:4] for r in rows if low <= r[4] < low + 2600] for low in range(0, 7600, 2600)]
    got, want, _ = told(spark, [b for b in batches if b], "lte", metric="x", value="5", fresh_seconds=100)
    assert got == want


def test_keys_of_one_call_are_kept_apart(spark, monkeypatch):
    """All keys in one bucket, null ones and those of other batches among them: each has its own state."""
    monkeypatch.setattr(J, "BUCKETS", 1)
    feed, out, state = (work_path(spark, f"apart-{what}") for what in ("feed", "out", "state"))
    for part in ([("a", "t", 100), ("b", None, 130), ("c", "u", 150)], [("d", "t", 110), ("e", None, 200), ("f", "v", 300)]):
        rows = literal_frame(spark, [(i, t, "s", s) for i, t, s in part], "measurement_id string, tenant_id string, subject string, s bigint")
        rows.coalesce(1).write.mode("append").parquet(feed)
        made = J.since_last(J.read_parquet_stream(spark, feed, rows.schema).withColumn("ts", F.timestamp_seconds("s")))
        J.advance(made, out, state)
    got = {r.measurement_id: (r.tenant_id, r.since_last) for r in spark.read.schema(made.schema).parquet(out).collect()}
    first = {k for k, (_, gap) in got.items() if gap is None or gap != gap}
    assert first == {"a", "b", "c", "f"} and got["d"] == ("t", 10.0) and got["e"] == (None, 70.0)


def test_short_keys_share_a_call(spark):
    """Five hundred keys of one row are taken in far fewer calls."""
    from rulegauge.streaming import processors as S
    assert issubclass(S.LastRecord, S.PerKey) and J.BUCKETS < 2000
    rows = spark.range(500).select(F.col("id").cast("string").alias("tenant_id"), F.lit("s").alias("subject"))
    kinds = J.bucketed(rows.filter("tenant_id < '2'"), ["tenant_id", "subject"]).count()
    assert kinds.columns == ["_bucket", "count"]
