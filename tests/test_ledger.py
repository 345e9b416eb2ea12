"""Hash chains: byte form, segments, continuation, tampering."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from rulegauge.operators import ledger as L
from rulegauge.session import literal_frame, work_path

WORDS = ['plain', 'quote " and \\ slash', 'é → 漢字 🎈', 'tab\t line\n', 'control \u001f \u000b \u0001', 'literal \\u001F', 'del \u007f']


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [("hot" if i % 3 else f"t{i % 4}", f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}+00:00", "FLAG" if i % 5 == 0 else "CLEAR", f"x{i}",
             hashlib.sha256(str(i).encode()).hexdigest(), None if i % 7 == 0 else "r1", "kg", "0.1", WORDS[i % len(WORDS)],
             None if i % 11 == 0 else "v") for i in range(150)]
    return literal_frame(spark, rows, "tenant_id string, timestamp_iso string, verdict string, telemetry_id string, telemetry_hash string, "
                         "rule_id string, kg_version string, model_version string, reasoning string, track string")


def recompute(rows, key="model_version"):
    tips = {}
    for r in sorted(rows, key=lambda r: (r.tenant_id, r.sequence_number)):
        body = {"sequence_number": r.sequence_number, "previous_hash": tips.get(r.tenant_id, "0" * 64), "timestamp": r.timestamp_iso,
                "verdict": r.verdict, "telemetry_id": r.telemetry_id, "telemetry_hash": r.telemetry_hash, "rule_id": r.rule_id,
                "kg_version": r.kg_version, key: r.model_version, "reasoning": r.reasoning, "track": r.track}
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        tips[r.tenant_id] = hashlib.sha256(text.encode()).hexdigest()
        yield r, body["previous_hash"], tips[r.tenant_id]


@pytest.mark.parametrize("segment,key", [(7, "model_version"), (1000, "zz_version")])
def test_chain_is_byte_exact(verdicts, segment, key):
    rows = L.build_chain(verdicts, segment_rows=segment, version_key=key).collect()
    assert len(rows) == 150
    for row, previous, own in recompute(rows, key):
        assert (row.previous_hash, row.entry_hash) == (previous, own)


def test_continuation_equals_one_build(verdicts):
    whole = {(r.tenant_id, r.sequence_number): r.entry_hash for r in L.build_chain(verdicts).collect()}
    early = L.build_chain(verdicts.filter("timestamp_iso < '2024-01-01T00:01:20'"), segment_rows=9)
    late = L.build_chain(verdicts.filter("timestamp_iso >= '2024-01-01T00:01:20'"), heads=L.heads_of(early), segment_rows=9)
    assert {(r.tenant_id, r.sequence_number): r.entry_hash for r in early.unionByName(late).collect()} == whole


def test_tampering_is_found(verdicts):
    chain = L.build_chain(verdicts)
    assert chain.count() == 150 and L.chain_issues(chain, tile=8).count() == 0
    assert L.verify_chain(chain, tile=8).filter("NOT is_valid").count() == 0
    changed = chain.withColumn("verdict", F.when(F.expr("tenant_id = 'hot' AND sequence_number = 9"), "NULL_STALE").otherwise(F.col("verdict")))
    assert [r.issue_type for r in L.chain_issues(changed, tile=8).collect()] == ["ENTRY_HASH_MISMATCH"]
    cut = chain.filter("NOT (tenant_id = 'hot' AND sequence_number = 8)")
    found = {(r.issue_type, r.sequence_number) for r in L.chain_issues(cut, tile=8).collect()}
    assert found == {("SEQUENCE_GAP", 8), ("HASH_MISMATCH", 9)}
    assert L.verify_chain(chain.limit(0)).count() == 0


def test_append_only(spark, verdicts):
    path = work_path(spark, "append-test")
    chain = L.build_chain(verdicts)
    L.append_ledger(chain, path)
    with pytest.raises(ValueError):
        L.append_ledger(chain.limit(1), path)
    assert spark.read.parquet(path).count() == 150


def test_export_formats(spark, verdicts):
    rows = L.build_chain(verdicts).withColumn("timestamp", F.to_timestamp("timestamp_iso"))
    for fmt in ("jsonl", "csv"):
        files = L.export(rows, work_path(spark, "exp"), fmt, verdict="FLAG", fields=["tenant_id", "sequence_number"]).collect()
        assert files and all(f.checksum.startswith("sha256:") for f in files)
    with pytest.raises(ValueError):
        L.export(rows, work_path(spark, "exp"), "xml")


def test_missing_fields_are_findings(verdicts):
    rows = L.build_chain(verdicts)
    head = rows.filter("tenant_id = 'hot'").agg(F.max("sequence_number")).first()[0]
    at = (F.col("tenant_id") == "hot") & (F.col("sequence_number") == head)

    def issues(column, value):
        changed = rows.withColumn(column, F.when(at, F.lit(value).cast(rows.schema[column].dataType)).otherwise(F.col(column)))
        return {(r.sequence_number, r.issue_type) for r in L.chain_issues(changed).filter("tenant_id = 'hot'").collect()}
    assert issues("entry_hash", None) == {(head, "ENTRY_HASH_MISMATCH")}
    assert (head, "HASH_MISMATCH") in issues("previous_hash", None)
    assert (head, "TIMESTAMP_ORDER") in issues("timestamp_iso", "yesterday")
    linked = L.chain_linkage(rows.withColumn("previous_hash", F.when(at, F.lit(None).cast("string")).otherwise(F.col("previous_hash"))))
    assert [r.chain_link_valid for r in linked.filter(at).collect()] == [False]
    assert linked.filter("chain_link_valid is null").count() == 0


# ---- commits -----------------------------------------------------------------------------------------

def test_clean_append_opens_no_stored_entry(spark, verdicts):
    path = work_path(spark, "zone-test")
    chain = L.build_chain(verdicts)
    L.append_ledger(chain.filter("sequence_number <= 20"), path)
    log = L.CommitLog(spark, path)
    first = log.commits()[0]
    # without the entries of the first commit an append beyond them still works, one that meets them does not
    kept = log.new_path("_aside")
    log.fs.rename(log.new_path(f"commit={first}"), kept)
    L.append_ledger(chain.filter("sequence_number > 20"), path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        L.append_ledger(chain.filter("sequence_number = 20"), path)
    log.fs.rename(kept, log.new_path(f"commit={first}"))
    assert L.read_ledger(spark, path).count() == chain.count()


def test_of_two_racing_appends_one_wins(spark, verdicts, monkeypatch):
    path = work_path(spark, "race-test")
    chain = L.build_chain(verdicts)
    L.append_ledger(chain.filter("sequence_number <= 5"), path)
    put, done = L.CommitLog.put, []

    def late(self, version, commit):
        if not done:
            done.append(commit)
            L.append_ledger(chain.filter("sequence_number BETWEEN 6 AND 9"), path)
        return put(self, version, commit)
    monkeypatch.setattr(L.CommitLog, "put", late)
    with pytest.raises(ValueError):
        L.append_ledger(chain.filter("sequence_number BETWEEN 8 AND 12"), path)
    assert L.read_ledger(spark, path).count() == chain.filter("sequence_number <= 9").count()
    done.clear()

    def other(self, version, commit):
        if not done:
            done.append(commit)
            L.append_ledger(chain.filter("sequence_number BETWEEN 30 AND 31"), path)
        return put(self, version, commit)
    monkeypatch.setattr(L.CommitLog, "put", other)
    # what the winner wrote does not meet it: it takes the next version
    L.append_ledger(chain.filter("sequence_number BETWEEN 10 AND 12"), path)
    assert len(L.CommitLog(spark, path).commits()) == 4


def test_appends_to_a_ledger_without_a_log(spark, verdicts):
    path = work_path(spark, "old-test")
    chain = L.build_chain(verdicts)
    chain.filter("sequence_number <= 5").withColumn("day", F.lit("2024-01-01")).write.partitionBy("day").parquet(path)
    with pytest.raises(ValueError):
        L.append_ledger(chain.filter("sequence_number = 5"), path)
    L.append_ledger(chain.filter("sequence_number = 6"), path)
    assert L.read_ledger(spark, path).count() > 0


def test_entries_leave_the_fold_with_their_hashes(verdicts):
    """Other columns of any type pass through; the entries are not joined with their hashes afterwards."""
    more = verdicts.withColumns({"extra": F.struct(F.lit(1).alias("a"), F.array("verdict").alias("b")), "at": F.to_timestamp("timestamp_iso"),
                                 "body": F.parse_json(F.concat(F.lit('{"x":"'), "telemetry_id", F.lit('"}')))})
    chain = L.build_chain(more, segment_rows=20)
    assert "Join" not in chain._jdf.queryExecution().executedPlan().toString()
    assert chain.columns == [*more.columns, "sequence_number", "previous_hash", "entry_hash"]
    assert chain.filter("extra.b[0] = verdict AND at = to_timestamp(timestamp_iso)").count() == 150
    assert chain.filter("variant_get(body, '$.x', 'string') = telemetry_id").count() == 150
