"""Re-decide past entries from the stored history and compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegauge.operators import routing as R
from rulegauge.operators import rules as E
from rulegauge.session import materialize


def replay_range(entries: DataFrame, lo: int, hi: int) -> DataFrame:
    return entries.filter(F.col("sequence_number").between(lo, hi))


def fetch(entries: DataFrame, history: DataFrame) -> DataFrame:
    """Adds ``record``: the latest history row with the entry's payload hash in its tenant (NULL if none).

    Only history rows whose hash an entry names are looked at. They are reduced to one row per hash with map-side
    combining before the join, so repeated payloads do not multiply.
    """
    row = F.struct("telemetry_ts", "telemetry_id", "subject", "payload")
    named = entries.select("tenant_id", F.col("telemetry_hash").alias("measurement_hash"))
    latest = history.join(named, ["tenant_id", "measurement_hash"], "left_semi").groupBy("tenant_id", F.col("measurement_hash").alias("telemetry_hash")).agg(
        F.max_by(row, F.struct("telemetry_ts", "telemetry_id")).alias("record"))
    return entries.join(latest, ["tenant_id", "telemetry_hash"], "left")


def skip_reason(fetched: DataFrame) -> DataFrame:
    """Adds ``skip_reason``: before the history existed, model-only track, or payload not found."""
    return fetched.withColumn("skip_reason", F.when(
        F.coalesce(F.col("schema_version"), F.lit("0.1.0")) == "0.1.0", "pre_buffer_version")
        .when(F.col("track") == "llm", "model_track").when(F.col("record").isNull(), "record_missing"))


def replay(entries: DataFrame, history: DataFrame, registry: DataFrame, rules: DataFrame, lo: int, hi: int,
           *, include_self: bool = False) -> DataFrame:
    """Per entry of the range: ``outcome`` (skipped, matched, mismatched), its reason and the new verdict.

    ``history`` holds ``tenant_id, subject, telemetry_id, telemetry_ts, payload, measurement_hash``. Each
    entry is decided as of its record's own time over all that its subject sent before.
    """
    # what is not compared or returned is neither shuffled with the entries nor written
    told = ["tenant_id", "sequence_number", "telemetry_id", "rule_id", "verdict"]
    slim = replay_range(entries, lo, hi).select(*told, "telemetry_hash", "schema_version", "track")
    chosen = materialize(skip_reason(fetch(slim, history)).select(
        *told, "skip_reason", F.when(F.col("skip_reason").isNull(), F.col("record")).alias("record"),
        F.concat_ws("#", "tenant_id", "sequence_number").alias("_key")), "chosen")
    # decisions look back only: of the history the range's subjects are needed, up to their last entry
    until = chosen.filter("skip_reason IS NULL").groupBy("tenant_id", F.col("record.subject").alias("subject")).agg(
        F.max("record.telemetry_ts").alias("_until"))
    past = history.join(until, ["tenant_id", "subject"]).filter(F.col("telemetry_ts") <= F.col("_until")).select("tenant_id", "subject", F.col("telemetry_id").alias("measurement_id"),
                          F.col("telemetry_ts").alias("ts"), F.col("payload").alias("measurement"))
    live = chosen.filter("skip_reason IS NULL").select(
        "_key", "tenant_id", F.col("rule_id").alias("recorded_rule"), F.col("verdict").alias("recorded_verdict"),
        F.col("record.subject").alias("subject"), F.col("record.telemetry_id").alias("measurement_id"),
        F.col("record.telemetry_ts").alias("ts"), F.col("record.payload").alias("measurement"))
    routed = R.route(live, registry, rules)
    # the record before is looked up once in the history, then carried to the entries by record id
    decided = E.evaluate_as_of(routed, past, id_col="_key", include_self=include_self, needs=E.history_needs(rules))
    rerouted = ~F.col("recorded_rule").eqNullSafe(F.col("rule_id")) | F.col("rule_id").isNull()
    results = decided.select(
        "_key", F.when(rerouted, "tag_registry_divergence").when(
            F.col("verdict") != F.col("recorded_verdict"), "verdict_divergence").alias("mismatch"),
        F.when(rerouted, "<routing diverged>").otherwise(F.col("verdict")).alias("replayed_verdict"),
        F.col("rule_id").alias("replayed_rule"))
    joined = chosen.join(results, "_key", "left")
    outcome = (F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("mismatch").isNull(), "matched")
               .otherwise("mismatched"))
    return joined.select(
        "tenant_id", "sequence_number", "telemetry_id", "rule_id", F.col("verdict").alias("recorded_verdict"),
        "replayed_verdict", "replayed_rule", outcome.alias("outcome"),
        F.coalesce("skip_reason", "mismatch").alias("reason"))


def replay_report(results: DataFrame) -> DataFrame:
    """One row of totals; clean when every replayed entry matched."""
    counted = results.agg(
        F.count(F.lit(1)).alias("total_entries"), F.count_if(F.col("outcome") != "skipped").alias("replayed_entries"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped_entries"),
        F.count_if(F.col("outcome") == "matched").alias("matched_entries"),
        F.count_if(F.col("outcome") == "mismatched").alias("mismatched_entries"))
    return counted.withColumn("is_clean", (F.col("mismatched_entries") == 0)
                              & (F.col("replayed_entries") == F.col("matched_entries")))
