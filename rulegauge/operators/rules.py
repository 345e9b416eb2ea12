"""One rule per record: the operator grammar, stateless and over history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.functions import values as V
from rulegauge.operators import history as H
from rulegauge.operators.ordered import attached


def evaluate_stateless(routed: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``reasoning`` from the record alone; operators over history go to a human."""
    steps = P.with_rule_observation(routed)
    judged = P.stateless_decision(
        rule_id=F.col("rule_id"), operator=F.col("operator"), metric=F.col("metric"), unit=F.col("unit"),
        low=F.col("low"), high=F.col("high"), operand=F.col("operand"), seen=F.col("_seen"))
    blind = P.decision("DISCRETIONARY", F.concat(F.lit("Rule "), F.col("rule_id"), F.lit(
        ": needs the subject's history, which is not available here.")))
    needs_history = F.col("operator").isin(*P.HISTORY_OPERATORS) | F.col("fresh_seconds").isNotNull()
    out = (F.when(F.col("rule_id").isNull(), _unmapped()).when(needs_history, blind).otherwise(judged))
    return _finish(steps.withColumn("_d", out), routed.columns)


def _unmapped():
    return P.decision("NULL_UNMAPPED", F.concat(F.lit("No rule is registered for subject '"), F.col("subject"),
                                                F.lit("'.")))


def _finish(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, F.col("_d.verdict").alias("verdict"), F.col("_d.reasoning").alias("reasoning"))


def history_needs(rules: DataFrame) -> tuple[bool, bool]:
    """(windows, record before): what the rules look up in histories. One small job over the rule set."""
    row = rules.agg(
        F.max(F.col("operator").isin(*P.WINDOW_OPERATORS)).alias("w"),
        F.max(F.col("operator").isin("since_last", "debounce") | F.col("fresh_seconds").isNotNull()).alias("b")).first()
    return bool(row["w"]), bool(row["b"])


def evaluate(routed: DataFrame, history: DataFrame | None = None, *, include_self: bool = False,
             id_col: str = "measurement_id", needs: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Adds ``verdict`` and ``reasoning`` for every operator.

    ``history`` holds the records windows look at (with ``measurement``); NULL means none is available, and
    rules over history go to a human. Windows count every record up to the probe, itself included when it is
    in the history. ``since_last``, ``debounce`` and the freshness gate look at the record before; with
    ``include_self`` they may find the probe's own row, as a store that is written first would. Rows that went
    through :func:`record_before` ahead of routing are not looked up again.
    """
    if history is None:
        return evaluate_stateless(routed)
    seen = None
    if needs[1] and include_self:
        seen = _latest_seen(routed, history, id_col)
    elif needs[1] and "_last" not in routed.columns:
        routed = record_before(routed, id_col=id_col)
    return _with_history(routed, history if needs[0] else None, seen, id_col)


def record_before(records: DataFrame, *, id_col: str = "measurement_id") -> DataFrame:
    """Adds ``_last``, the time of the subject's record before; rows are narrower ahead of routing than after it."""
    return H.last_seen(records, id_col=id_col).withColumnRenamed("last_ts", "_last")


def evaluate_as_of(routed: DataFrame, history: DataFrame, *, id_col: str, include_self: bool = False,
                   needs: tuple[bool, bool] = (True, True)) -> DataFrame:
    """As :func:`evaluate` for rows that point into the history by ``tenant_id`` and ``measurement_id``.

    Several rows may point at one record; the record before is taken from the history, not from ``routed``.
    """
    if not needs[1]:
        seen = None
    elif include_self:
        seen = _latest_seen(routed, history, id_col)
    else:
        # a record that the store holds twice is not its own predecessor
        before = H.last_seen(history.select(*H.SUBJECT, "measurement_id", "ts").distinct())
        seen = routed.select(*H.SUBJECT, "measurement_id", "ts", id_col).join(
            before.withColumnRenamed("last_ts", "_last"), [*H.SUBJECT, "measurement_id", "ts"]).groupBy(
            *H.SUBJECT, id_col).agg(F.max("_last").alias("_last"))
    return _with_history(routed, history if needs[0] else None, seen, id_col)


def _latest_seen(routed: DataFrame, history: DataFrame, id_col: str) -> DataFrame:
    found = H.last_seen(routed.select(*H.SUBJECT, id_col, "ts"), history, id_col=id_col)
    return found.groupBy(*H.SUBJECT, id_col).agg(F.max("last_ts").alias("_last"))


def _with_history(routed: DataFrame, history: DataFrame | None, seen: DataFrame | None, id_col: str) -> DataFrame:
    joined = routed
    if seen is not None:
        joined = attached(joined, seen, [*H.SUBJECT, id_col])
    elif "_last" not in joined.columns:
        joined = joined.withColumn("_last", F.lit(None).cast("timestamp"))
    if history is not None:
        windowed = routed.filter(F.col("operator").isin(*P.WINDOW_OPERATORS))
        stats = H.rule_window_stats(windowed, history, id_col=id_col).select(
            *H.SUBJECT, id_col, F.col("count").alias("_n"), F.col("sum_value").alias("_sum"), F.col("avg_value").alias("_avg"))
        joined = attached(joined, stats, [*H.SUBJECT, id_col])
    else:
        joined = joined.withColumns({"_n": F.lit(None).cast("bigint"), "_sum": F.lit(None).cast("double"),
                                     "_avg": F.lit(None).cast("double")})
    return decide(joined, [c for c in routed.columns if c != "_last"])


def decide(joined: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of routed rows plus ``verdict`` and ``reasoning``, from what was looked up in the history.

    Needs ``_last`` (the record before) and ``_n``, ``_sum``, ``_avg`` (the rule's window), wherever they come from.
    """
    joined = joined.withColumn("_gap", H.elapsed_seconds(F.col("ts"), F.col("_last")))
    operator = F.col("operator")
    measured = (F.when(operator == "window_count", F.coalesce(F.col("_n"), F.lit(0)).cast("double"))
                .when(operator == "window_sum", F.col("_sum")).when(operator == "window_avg", F.col("_avg"))
                .when(operator == "since_last", F.col("_gap")))
    steps = P.with_rule_observation(joined.withColumn("_measured", measured)).withColumn(
        "_measured_text", V.float_text(F.col("_measured")))
    return _finish(steps.withColumn("_d", full_decision()), columns)


def full_decision():
    """Gate first, then the operator, over the columns :func:`evaluate` prepares."""
    rule_id, operator, subject = F.col("rule_id"), F.col("operator"), F.col("subject")
    seconds, gap = F.col("seconds"), F.col("_gap")
    lead = F.concat(F.lit("Rule "), rule_id)
    over = F.concat(F.lit(" over "), seconds.cast("string"), F.lit("s"))
    target = F.col("operand.number")
    measured = F.col("_measured")

    def against(label, cmp, goal, goal_text):
        return P.compare_decision(rule_id=rule_id, cmp=cmp, observed=measured, target=goal, label=label,
                                  observed_text=F.col("_measured_text"), target_text=goal_text)

    unusable = P.decision("DISCRETIONARY", F.concat(lead, F.lit(": operator '"), operator, F.lit(
        "' requires a telemetry timestamp and complete parameters.")))
    none_found = P.decision("NULL_UNMAPPED", F.concat(
        lead, F.lit(": "), operator, F.lit(" found no numeric values at '"), F.col("metric"), F.lit("' for '"), subject,
        F.lit("' in the last "), seconds.cast("string"), F.lit("s.")))
    label = F.when(operator == "window_count", F.concat(F.lit("count"), over)).otherwise(F.concat(
        F.substring_index(operator, "_", -1), F.lit("("), F.col("metric"), F.lit(")"), over))
    window = (
        F.when(F.col("ts").isNull() | seconds.isNull() | (seconds <= 0) | target.isNull(), unusable)
        .when(measured.isNull(), none_found)
        .otherwise(against(label, F.coalesce(F.col("cmp_op"), F.lit("lte")), target, F.col("operand.number_text"))))
    since = (
        F.when(F.col("ts").isNull() | F.col("value_seconds").isNull(), unusable)
        .when(F.col("_last").isNull(), P.decision("NULL_UNMAPPED", F.concat(
            lead, F.lit(": since_last needs a prior record for '"), subject, F.lit("'; none found."))))
        .otherwise(against(F.concat(F.lit("since_last("), subject, F.lit(")")),
                           F.coalesce(F.col("cmp_op"), F.lit("gte")), F.col("value_seconds"),
                           F.col("value_seconds_text"))))
    debounce = (
        F.when(F.col("ts").isNull() | seconds.isNull(), unusable)
        .when(F.col("_last").isNull() | (gap > seconds), P.decision("CLEAR", F.concat(
            lead, F.lit(": debounce("), seconds.cast("string"), F.lit("s) satisfied, no prior record for '"), subject,
            F.lit("' in the window."))))
        .otherwise(P.decision("DISCRETIONARY", F.concat(
            lead, F.lit(": debounce("), seconds.cast("string"), F.lit("s), duplicate event for '"), subject,
            F.lit("'; routed to human review.")))))
    fresh_seconds = F.col("fresh_seconds")
    gated = fresh_seconds.isNotNull()
    stale = P.decision("NULL_STALE", F.concat(
        lead, F.lit(": no telemetry for subject '"), subject, F.lit("' within the last "),
        fresh_seconds.cast("string"), F.lit("s.")))
    return (
        F.when(rule_id.isNull(), _unmapped())
        .when(gated & (F.col("ts").isNull() | (fresh_seconds <= 0)), unusable)
        .when(gated & ~H.fresh(F.col("ts"), F.col("_last"), fresh_seconds), stale)
        .when(operator.isin(*P.WINDOW_OPERATORS), window)
        .when(operator == "since_last", since)
        .when(operator == "debounce", debounce)
        .otherwise(P.stateless_decision(
            rule_id=rule_id, operator=operator, metric=F.col("metric"), unit=F.col("unit"), low=F.col("low"),
            high=F.col("high"), operand=F.col("operand"), seen=F.col("_seen"))))
