"""Ordered operators against brute force, with ties, hot keys and awkward spans."""

import random

import pytest
from pyspark.sql import functions as F

from rulegauge.operators import history as H
from rulegauge.operators.ordered import as_of, dense_index, trailing
from rulegauge.session import literal_frame


def points(seed, n=240):
    rng = random.Random(seed)
    # a third of all rows on one key, many equal positions
    return [(f"i{i}", "hot" if i % 3 == 0 else f"k{rng.randrange(6)}", rng.randrange(0, 400),
             None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 3)) for i in range(n)]


def brute(probes, history, span, closed):
    out = {}
    for pid, key, p, _ in probes:
        hit = [(h[2], h[3]) for h in history if h[1] == key and (p - span <= h[2] if closed else p - span < h[2]) and h[2] <= p]
        nums = [v for _, v in hit if v is not None]
        out[pid] = (len(hit), min((x for x, _ in hit), default=None), max((x for x, _ in hit), default=None),
                    round(sum(nums), 6) if nums else None, min(nums, default=None), max(nums, default=None))
    return out


SCHEMA = "id string, key string, pos bigint, v double"


@pytest.mark.parametrize("span,closed,tiles", [(1, False, 8), (3, True, 8), (37, False, 8), (60, True, 8), (100, False, 3),
                                               (64, True, 2), (250, False, 1), (1000, True, 16)])
def test_trailing_self(spark, span, closed, tiles):
    rows = points(span)
    df = literal_frame(spark, rows, SCHEMA).withColumn("span", F.lit(span).cast("bigint"))
    got = trailing(df, None, keys=["key"], pos="pos", span="span", id_col="id", values=["v"], closed=closed, tiles=tiles)
    found = {r.id: (r.n, r.first_pos, r.last_pos, None if r.v_sum is None else round(r.v_sum, 6), r.v_min, r.v_max) for r in got.collect()}
    assert found == brute(rows, rows, span, closed)


def test_trailing_other_history(spark):
    probes, history = points(1, 90), points(2, 200)
    p = literal_frame(spark, probes, SCHEMA).withColumn("span", F.lit(45).cast("bigint"))
    h = literal_frame(spark, history, SCHEMA).withColumn("span", F.lit(45).cast("bigint"))
    got = trailing(p, h, keys=["key"], pos="pos", span="span", id_col="id", values=["v"])
    found = {r.id: (r.n, r.first_pos, r.last_pos, None if r.v_sum is None else round(r.v_sum, 6), r.v_min, r.v_max) for r in got.collect()}
    assert found == brute(probes, history, 45, False)


def test_as_of(spark):
    probes, history = points(3, 90), points(4, 60)
    got = as_of(literal_frame(spark, probes, SCHEMA), literal_frame(spark, history, SCHEMA).select("key", "pos"), keys=["key"], pos="pos",
                id_col="id", tile_width=50)
    found = {r.id: r.seen_pos for r in got.collect()}
    assert found == {i: max((h[2] for h in history if h[1] == k and h[2] <= p), default=None) for i, k, p, _ in probes}


@pytest.mark.parametrize("partitions", [1, 8, 31])
def test_dense_index(spark, partitions):
    rows = points(5)
    got = dense_index(literal_frame(spark, rows, SCHEMA), keys=["key"], order=["pos", "id"], name="n", partitions=partitions)
    want = {}
    for key in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0])), 1):
            want[r[0]] = n
    assert {r.id: r.n for r in got.collect()} == want


def records(spark, rows):
    frame = literal_frame(spark, rows, "measurement_id string, at int, payload string")
    return frame.select("measurement_id", F.lit("t").alias("tenant_id"), F.lit("s").alias("subject"),
                        F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts"), F.parse_json("payload").alias("measurement"))


def test_window_edges_and_types(spark):
    rows = [("a", 0, '{"x":1}'), ("b", 10, '{"x":"12"}'), ("c", 20, '{"x":true}'), ("d", 30, '{"x":null}'), ("e", 40, '{"x":{"y":1}}'),
            ("f", 50, '{}'), ("g", 60, '{"x":2.5}')]
    df = records(spark, rows)
    half = {r.measurement_id: r for r in H.window_stats(df, seconds=60, path="x").collect()}
    full = {r.measurement_id: r for r in H.window_stats(df, seconds=60, path="x", bounds="[]").collect()}
    # the row exactly sixty seconds back is outside the half-open window and inside the closed one
    assert (half["g"]["count"], half["g"].sum_value) == (6, 2.5)
    assert (full["g"]["count"], full["g"].sum_value, full["g"].avg_value) == (7, 3.5, 1.75)
    assert half["f"].sum_value == 1.0 and half["b"].sum_value == 1.0
    with pytest.raises(ValueError):
        H.window_stats(df, seconds=0)
    with pytest.raises(ValueError):
        H.window_stats(df, seconds=5, bounds="()")


def test_rows_without_time_are_nobodys_predecessor(spark):
    df = records(spark, [("a", 0, "{}"), ("b", 5, "{}")])
    lost = records(spark, [("z", 0, "{}")]).withColumn("ts", F.lit(None).cast("timestamp"))
    got = {r.measurement_id: r.last_ts for r in H.last_seen(df.unionByName(lost)).collect()}
    assert got["a"] is None and got["z"] is None and got["b"] is not None


def test_previous_row_moves_one_row_per_tile_for_tails(spark):
    from rulegauge.operators.ordered import previous_row
    rows = literal_frame(spark, [("a", i, f"v{i}") for i in range(40)] + [("b", 3, "w"), (None, 1, "n"), (None, 2, "m")], "key string, at int, v string")
    got = previous_row(rows, keys=["key"], order=["at"], tile=F.floor(F.col("at") / 4).cast("bigint"), values=["v"])
    found = {(r.key, r.at): r.prev_v for r in got.collect()}
    assert found == {("a", 0): None, **{("a", i): f"v{i - 1}" for i in range(1, 40)}, ("b", 3): None, (None, 1): None, (None, 2): "n"}
    assert "partial_max_by" in got._jdf.queryExecution().executedPlan().toString()
