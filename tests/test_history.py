"""The history table: versions, retention by dropping, and what it leaves alone."""

from pyspark.sql import functions as F

from rulegauge.session import literal_frame, work_path
from rulegauge.sources import history as S


def records(spark, rows):
    return literal_frame(spark, rows, "measurement_id string, tenant_id string, d string").select(
        "measurement_id", "tenant_id", F.lit("a").alias("subject"), F.to_timestamp("d").alias("ts"), F.try_parse_json(F.lit('{"x":1}')).alias("measurement"))


def ids(df):
    return sorted(r.telemetry_id for r in df.collect())


def test_retention_drops_partitions_and_counts(spark):
    path = work_path(spark, "retention-test")
    S.append_history(records(spark, [("a", "t1", "2024-01-01"), ("b", "t1", "2024-01-09"), ("c", "a/b +%", "2024-01-01"), ("d", None, "2024-01-01"),
                                     ("e", "007", "2024-01-01"), ("f", "t1", None)]), path)
    S.append_history(records(spark, [("a", "t1", "2024-01-01"), ("g", "t1", "2024-01-02")]), path)
    before = S.read_history(spark, path)
    assert ids(before) == ["a", "a", "b", "c", "d", "e", "f", "g"]
    assert {r.tenant_id for r in before.collect()} == {"t1", "a/b +%", None, "007"}
    settings = literal_frame(spark, [("t1", 7), ("007", 1)], "tenant_id string, buffer_retention_days int")
    assert S.drop_expired(spark, path, settings, "2024-01-10 00:00:00", default_days=30) == 4
    assert ids(S.read_history(spark, path)) == ["b", "c", "d", "f"]
    # the version before is still there, also for a reader who had it open
    assert ids(S.read_history(spark, path, version=2)) == ids(before) == ["a", "a", "b", "c", "d", "e", "f", "g"]
    assert S.drop_expired(spark, path, settings, "2024-01-10 00:00:00", default_days=30) == 0
    assert S.drop_expired(spark, path, settings, "2024-01-10 00:00:00", default_days=1) == 2
    assert S.vacuum(spark, path) == 6
    assert ids(S.read_history(spark, path)) == ["b", "f"]


def test_partition_columns_prune(spark):
    path = work_path(spark, "prune-test")
    S.append_history(records(spark, [(f"r{i}", f"t{i % 3}", f"2024-01-0{1 + i % 5}") for i in range(30)]), path)
    chosen = S.read_history(spark, path).filter("tenant_id = 't1' AND day = DATE '2024-01-02'")
    assert len({r[0] for r in chosen.select(F.input_file_name()).collect()}) == 1
    assert "PartitionFilters: [isnotnull(tenant_id" in chosen._jdf.queryExecution().toString()


def test_empty_table(spark):
    path = work_path(spark, "empty-test")
    assert S.read_history(spark, path).count() == 0
    S.append_history(records(spark, []), path)
    assert S.read_history(spark, path).count() == 0
