"""Predicates over one observation: rule operators and typed obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegauge.functions import values as V

# The five verdicts, the four check results, the sixteen obligation types.
VERDICTS = ("CLEAR", "FLAG", "NULL_UNMAPPED", "NULL_STALE", "DISCRETIONARY")
STATUSES = ("AGREED", "LLM_CONTRADICTION", "NEURO_SYMBOLIC_DIVERGENCE", "UNVERIFIABLE")
OBLIGATION_TYPES = (
    "must", "must_not", "must_not_exceed", "must_be_at_least", "must_be_below", "must_be_above",
    "must_be_within", "must_be_one_of", "must_not_be_one_of", "must_be_recorded_within", "should",
    "discretionary", "must_equal", "must_not_equal", "must_average_within", "must_not_exceed_in_window",
)
WINDOW_OPERATORS = ("window_count", "window_sum", "window_avg")
HISTORY_OPERATORS = WINDOW_OPERATORS + ("since_last", "debounce")
WINDOW_OBLIGATIONS = ("must_average_within", "must_not_exceed_in_window")

_HOLDS_SIGN = {"lte": "≤", "lt": "<", "gte": "≥", "gt": ">", "eq": "=="}
_FAILS_SIGN = {"lte": ">", "lt": "≥", "gte": "<", "gt": "≤", "eq": "!="}


def truthy_compare(op: str, left: Column, right: Column) -> Column:
    """IEEE comparison: anything against NaN is false."""
    result = {"lte": left <= right, "lt": left < right, "gte": left >= right,
              "gt": left > right, "eq": left == right}[op]
    return result & ~F.isnan(left) & ~F.isnan(right)


def compare_by(op: Column, left: Column, right: Column) -> Column:
    """Comparison picked by a column of operator codes; NULL for an unknown code."""
    out = F.lit(None).cast("boolean")
    for name in _HOLDS_SIGN:
        out = F.when(op == name, truthy_compare(name, left, right)).otherwise(out)
    return out


def _sign(op: Column, ok: Column, holds=_HOLDS_SIGN, fails=_FAILS_SIGN) -> Column:
    out = F.lit("!=")
    for name in holds:
        out = F.when(op == name, F.when(ok, holds[name]).otherwise(fails[name])).otherwise(out)
    return out


def _outcome(ok: Column) -> Column:
    return F.when(ok, "CLEAR").otherwise("FLAG")


def _sentence(rule_id: Column, ok: Column, detail: Column) -> Column:
    return F.concat(F.lit("Rule "), rule_id, F.when(ok, " satisfied: ").otherwise(" BREACHED: "), detail)


def rule_operand(v: Column, low: Column, high: Column) -> Column:
    """Everything a rule operator reads from its operand, worked out once on the rules side.

    An absent, null, empty, zero or false operand reads as the empty list for set operators.
    """
    text = F.to_json(v)
    number = V.parse_float(v)
    empty = v.isNull() | F.coalesce(text.isin("null", "[]", "{}", "0", "false", '""'), F.lit(True))
    return F.struct(
        number.alias("number"), V.float_text(number).alias("number_text"),
        F.concat(F.lit("["), V.float_text(low), F.lit(", "), V.float_text(high), F.lit("]")).alias("range_text"),
        F.when(empty, F.array().cast("array<string>")).otherwise(V.list_keys(v)).alias("keys"),
        (~empty & (V.kind(v) != "array")).alias("not_a_list"),
        F.coalesce(text, F.lit("[]")).alias("text"),
    )


def with_rule_observation(df: DataFrame, name: str = "_seen") -> DataFrame:
    """Adds what rule operators read from ``measurement`` at ``metric``, one step per column so that no step
    is worked out twice."""
    at, value, k, text = F.col("_seen_at"), F.col("_seen_value"), F.col("_seen_kind"), F.col("_seen_text")
    return (
        df.withColumn("_seen_at", V.lookup(F.col("measurement"), F.col("metric")))
        .withColumns({"_seen_value": V.split_value(at), "_seen_unit": V.split_unit(at)})
        .withColumns({"_seen_kind": V.kind(value), "_seen_text": V.as_text(value)})
        .withColumns({"_seen_number": V.parse_float(value, k), "_seen_key": V.value_key(value, k)})
        .withColumn(name, F.struct(
            (at.isNull() | F.is_variant_null(at)).alias("missing"), F.col("_seen_unit").alias("unit"),
            F.col("_seen_number").alias("number"), V.float_text(F.col("_seen_number")).alias("number_text"),
            F.col("_seen_key").alias("key"), F.coalesce(text, F.to_json(value)).alias("text")))
        .drop("_seen_at", "_seen_value", "_seen_unit", "_seen_kind", "_seen_text", "_seen_number", "_seen_key"))


def decision(verdict, reasoning: Column) -> Column:
    verdict = F.lit(verdict) if isinstance(verdict, str) else verdict
    return F.struct(verdict.alias("verdict"), reasoning.alias("reasoning"))


def stateless_decision(*, rule_id: Column, operator: Column, metric: Column, unit: Column, low: Column,
                       high: Column, operand: Column, seen: Column) -> Column:
    """Verdict and reasoning of an operator that needs the record only.

    ``operand`` is a :func:`rule_operand`, ``seen`` comes from :func:`with_rule_observation`; ``low`` and
    ``high`` bound ``range``/``between``.
    """
    number, limit = seen["number"], operand["number"]
    clash = (F.coalesce(unit, F.lit("")) != "") & (F.coalesce(seen["unit"], F.lit("")) != "") \
        & (unit != seen["unit"])
    lead = F.concat(metric, F.lit("="))

    compare_ok = compare_by(operator, number, limit)
    lead_number = F.concat(lead, seen["number_text"])
    compare_text = F.concat(lead_number, F.lit(" "), _sign(operator, compare_ok), F.lit(" "), operand["number_text"])
    inside = truthy_compare("lte", low, number) & truthy_compare("lte", number, high)
    inside_text = F.concat(lead_number, F.when(inside, " in ").otherwise(" outside "), operand["range_text"])
    member = F.coalesce(F.array_contains(operand["keys"], seen["key"]), F.lit(False))
    set_ok = member != (operator == "not_in_set")
    set_text = F.concat(lead, seen["text"], F.when(member, " ∈ ").otherwise(" ∉ "), operand["text"])
    quoted = F.concat(F.lit("'"), rule_id, F.lit("'"))
    plain = F.concat(F.lit("Rule "), rule_id)
    unreadable = decision("DISCRETIONARY",
                          F.concat(plain, F.lit(": predicate could not be evaluated; routed to human review.")))

    def judged(ok, text):
        return decision(_outcome(ok), _sentence(rule_id, ok, text))

    return (
        F.when(operator.isNull() & operand.isNull(), decision("DISCRETIONARY", F.concat(
            F.lit("Rule "), quoted, F.lit(" has no structured predicate; routed to human review."))))
        .when(seen["missing"], decision("NULL_UNMAPPED", F.concat(
            F.lit("Rule "), quoted, F.lit(": metric '"), metric, F.lit("' not present in telemetry."))))
        .when(clash, decision("DISCRETIONARY", F.concat(
            F.lit("Unit mismatch on rule "), quoted, F.lit(": predicate expects '"), unit,
            F.lit("', telemetry has '"), seen["unit"], F.lit("'. No implicit conversion performed."))))
        .when(operator.isin(*_HOLDS_SIGN),
              F.when(number.isNull() | limit.isNull(), unreadable).otherwise(judged(compare_ok, compare_text)))
        .when(operator.isin("range", "between"),
              F.when(number.isNull() | low.isNull() | high.isNull(), unreadable)
              .otherwise(judged(inside, inside_text)))
        .when(operator.isin("in_set", "not_in_set"),
              F.when(operand["not_a_list"], unreadable).otherwise(judged(set_ok, set_text)))
        .when(operator == "exists", decision("CLEAR", F.concat(
            plain, F.lit(": 'exists' predicate satisfied for '"), metric, F.lit("'."))))
        .otherwise(decision("DISCRETIONARY", F.concat(
            plain, F.lit(": unknown predicate operator '"), F.coalesce(operator, F.lit("None")), F.lit("'."))))
    )


def compare_decision(*, rule_id: Column, cmp: Column, observed: Column, target: Column, label: Column,
                     observed_text: Column, target_text: Column) -> Column:
    """Verdict and reasoning of an aggregate against its target; unknown code is for a human."""
    ok = compare_by(cmp, observed, target)
    text = F.concat(label, F.lit(": "), observed_text, F.lit(" "), _sign(cmp, ok), F.lit(" "), target_text)
    return F.when(ok.isNull(), F.struct(
        F.lit("DISCRETIONARY").alias("verdict"),
        F.concat(F.lit("Rule "), rule_id, F.lit(": unknown comparison '"), F.coalesce(cmp, F.lit("None")),
                 F.lit("' on "), label, F.lit(".")).alias("reasoning"))).otherwise(
        F.struct(_outcome(ok).alias("verdict"), _sentence(rule_id, ok, text).alias("reasoning")))


# ---- typed obligations --------------------------------------------------------------------

def obligation_operand(v: Column) -> Column:
    """What the obligation checks read from an operand, worked out once on the obligations side."""
    pair = F.try_variant_get(v, "$", "array<variant>")
    is_pair = F.size(pair) == 2
    return F.struct(
        V.number_or_bool(v).alias("number"),
        V.number_or_null(v).alias("strict"),
        F.when(is_pair, V.number_or_bool(F.get(pair, F.lit(0)))).alias("low"),
        F.when(is_pair, V.number_or_bool(F.get(pair, F.lit(1)))).alias("high"),
        V.value_key(_none_as_null(v)).alias("key"),
        F.when(F.size(pair) > 0, V.list_keys(v)).alias("keys"),
    )


def observation(v: Column, k: Column | None = None, n: Column | None = None) -> Column:
    """What the obligation checks read from an observed VARIANT. Booleans count as numbers here.

    ``k`` is ``kind(v)`` and ``n`` is ``V.number_or_bool(v)`` as columns of their own, so that they are worked out once.
    """
    k = V.kind(v) if k is None else k
    number = F.when(k.isin("number", "bool"), V.as_double(v)) if n is None else n
    return F.struct(number.alias("number"), F.when(k != "null", V.value_key(v, k, n)).alias("key"))


def satisfied(predicate: Column, seen: Column, operand: Column) -> Column:
    """Tri-state check of one obligation: true, false, or NULL for "cannot be checked".

    ``seen`` is an :func:`observation`, ``operand`` an :func:`obligation_operand`.
    """
    number, limit, lo, hi = seen["number"], operand["number"], operand["low"], operand["high"]
    same = seen["key"].eqNullSafe(operand["key"])
    member = F.coalesce(F.array_contains(operand["keys"], seen["key"]), F.lit(False))
    # comparisons with a NULL side stay NULL, which is "cannot be checked"
    return (
        F.when(predicate == "must_not_exceed", truthy_compare("lte", number, limit))
        .when(predicate == "must_be_at_least", truthy_compare("gte", number, limit))
        .when(predicate == "must_be_below", truthy_compare("lt", number, limit))
        .when(predicate == "must_be_above", truthy_compare("gt", number, limit))
        .when(predicate == "must_be_within",
              F.when(number.isNotNull() & lo.isNotNull() & hi.isNotNull(),
                     truthy_compare("lte", lo, number) & truthy_compare("lte", number, hi)))
        .when(predicate == "must_equal", same)
        .when(predicate == "must_not_equal", ~same)
        .when(predicate == "must_be_one_of", F.when(operand["keys"].isNotNull(), member))
        .when(predicate == "must_not_be_one_of", F.when(operand["keys"].isNotNull(), ~member))
    )


def _none_as_null(v: Column) -> Column:
    return F.when(F.is_variant_null(v), F.lit(None)).otherwise(v)


def satisfied_in_window(predicate: Column, *, mean: Column, peak: Column, operand: Column) -> Column:
    """As :func:`satisfied` for the two window obligations, from the window's mean and peak."""
    lo, hi, limit = operand["low"], operand["high"], operand["strict"]
    return (
        F.when(predicate == "must_average_within",
               F.when(mean.isNotNull() & lo.isNotNull() & hi.isNotNull(), (lo <= mean) & (mean <= hi)))
        .when(predicate == "must_not_exceed_in_window", peak <= limit)
    )


# ---- risk tiers ------------------------------------------------------------------------------

# Accepted spellings of the three tiers.
TIER_ALIASES = {
    "tier-1": 1, "tier1": 1, "high": 1, "high-risk": 1,
    "tier-2": 2, "tier2": 2, "standard": 2, "default": 2,
    "tier-3": 3, "tier3": 3, "low": 3, "low-risk": 3,
}
DEFAULT_TIER = 2


def tier_rank(raw: Column) -> Column:
    """1 (strictest) to 3; unknown or missing spellings give 2."""
    key = F.lower(V.strip(raw))
    out = F.lit(DEFAULT_TIER)
    for rank in (1, 3):
        out = F.when(key.isin(*[k for k, r in TIER_ALIASES.items() if r == rank]), rank).otherwise(out)
    return out


def tier_name(rank: Column) -> Column:
    return F.concat(F.lit("tier-"), rank.cast("string"))
