"""The decided entries that ledgers are built from: numbered once, and only as wide as they need to be."""

from datetime import datetime, timedelta

from rulegauge.operators import ledger as L
from rulegauge.plans import base as B
from rulegauge.plans import streams  # noqa: F401 - registers the queries

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def test_ledgers_number_decided_entries_once(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 8)
    rows = [(n, start + timedelta(hours=n % 150), None if n % 9 == 4 else n % 5, ("click", "view", "error", "purchase", "signup")[n % 5],
             float(n), '{"k": %d}' % n) for n in range(300)]
    spark.createDataFrame(rows, EVENTS).write.parquet(f"{tmp_path}/events.parquet")
    written = {}
    kept = L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name="stage", by=None: written.setdefault(name, kept(df, name, by)))
    B.apply_defaults(spark)
    built = {(r.tenant_id, r.sequence_number): (r.telemetry_id, r.entry_hash) for r in B.ledger_table(spark, str(tmp_path)).collect()}
    # neither numbered beforehand nor written with the text that is hashed
    assert "entries" not in {what for _, sf, what in B._BUILT if sf == str(tmp_path)}
    assert not {"_head", "_tail"} & set(written["segments"].columns)
    online = B.QUERIES["stream_ledger"](spark, str(tmp_path)).collect()
    assert {(r.tenant_id, r.sequence_number): (r.telemetry_id, r.entry_hash) for r in online} == built
    # entries of no ledger are in none
    assert len(online) == len(built) == sum(r[2] is not None for r in rows)
    assert all(tenant is not None for tenant, _ in built)
