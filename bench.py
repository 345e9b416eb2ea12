"""Headline queries at one scale; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES set the run."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = "/root/testdata/sf0.001"
SMALLER_DIR = "/root/testdata/sf0.01"
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "verdict_counts", "verdict_lineitem", "rule_verdicts", "pred_range", "win_sum", "since_last", "scope_snapshot",
    "propose_first_match", "envelopes_external", "ledger_build", "ledger_verify", "ledger_issues", "verdict_summary",
    "agreement_rolling", "replay_report", "kg_validation", "kg_slice", "kg_contradictions", "doc_chunks", "cand_dedup",
    "latency_percentiles", "eval_scores_by_category", "stream_window",
)
ROWS = {"verdict_counts": "events", "verdict_lineitem": "lineitem", "rule_verdicts": "events", "envelopes_external": "events",
        "ledger_verify": "events", "make_entries": "events"}


def laid_out(spark, source: str, files: int) -> str:
    """The tables in several files each, as a large table would be: one row group is read by one core."""
    target = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(source)):
        spark.read.parquet(f"{source}/{name}").repartition(files).write.parquet(f"{target}/{name}")
    return target


def main() -> None:
    from rulegauge.plans.base import entries_table, ledger_table
    from rulegauge.plans.catalog import QUERIES
    from rulegauge.session import build_session
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    def run(name, where):
        started = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    data = laid_out(spark, SF_DIR, int(CPUS))
    timings = {}
    smaller = {}
    if any(n.startswith(("ledger", "agreement", "verdict_summary", "replay")) for n in names):
        # the tables the audit queries read are made once, and their making is reported on its own
        for label, make in (("make_entries", entries_table), ("make_ledger", ledger_table)):
            if os.path.isdir(WARM_DIR):
                make(spark, WARM_DIR)
            started = time.perf_counter()
            make(spark, data)
            timings[label] = round(time.perf_counter() - started, 3)
    for name in names:
        if os.path.isdir(WARM_DIR):
            run(name, WARM_DIR)  # class loading and code generation on the smallest scale
        timings[name] = round(run(name, data), 3)
        if name in ROWS and not name.startswith("ledger") and os.path.isdir(SMALLER_DIR):
            smaller[name] = round(run(name, SMALLER_DIR), 3)
    counts = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in set(ROWS.values())}
    rates = {n: round(counts[t] / timings[n]) for n, t in ROWS.items() if n in timings}
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(CPUS),
                      "records_per_second": rates,
                      "records_per_second_and_core": {n: round(r / int(CPUS)) for n, r in rates.items()},
                      "seconds_at_sf0.01": smaller}))


if __name__ == "__main__":
    main()
