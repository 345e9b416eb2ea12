"""Rule graphs as two tables: slices for records, and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.functions import values as V
from rulegauge.session import materialize
from rulegauge.sources.rulesets import OPEN_FROM, OPEN_TO

# The node kind each edge type must point at.
EDGE_TARGETS = {
    "applies_to": "Subject", "consists_of": "Obligation", "defined_by": "Definition", "exempted_by": "Exemption",
    "amended_by": "Obligation", "interpreted_by": "Precedent", "scoped_to": "Jurisdiction", "cited_by": "Citation",
}
SEVERITY = {
    "DUPLICATE_NODE_ID": "CRITICAL", "DANGLING_EDGE": "HIGH", "INVALID_EDGE_TARGET_TYPE": "HIGH",
    "RULE_WITHOUT_OBLIGATION": "HIGH", "OBLIGATION_WITHOUT_RULE": "MEDIUM", "UNKNOWN_OBLIGATION_TYPE": "HIGH",
    "MISSING_EFFECTIVE_DATE": "HIGH", "UNKNOWN_RISK_TIER": "HIGH", "NODE_WITHOUT_CITATION": "MEDIUM",
}


def node_version(body: Column) -> Column:
    """Content hash of a node body (VARIANT or struct) that does not hold the version itself."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(body), 256))


# ---- slices ------------------------------------------------------------------------------------

# records of one subject that are kept together; a subject with more is taken in slices of about as many
SLICE_ROWS = 10_000
# where the rows of a record are while nothing is moved
HOME = ["subject_id", "_slice"]


def duties(nodes: DataFrame, edges: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(subject, rule, obligation) paths with the obligation's validity and places; the graph side only.

    Places are kept as rows: ``token`` is ``*`` for an obligation without a ``scoped_to`` edge on itself or
    on its rule. ``subjects`` (a row per ``subject_id``) leaves the paths of other subjects out; its columns stay.
    """
    def hop(kind, a, b, by):
        # moved by the key of the join that follows, so that repeats are dropped without a shuffle of their own
        found = edges.filter(F.col("type") == kind).select(F.col("from_id").alias(a), F.col("to_id").alias(b))
        return found.repartition(by).distinct()

    obligations = nodes.filter("type = 'Obligation'").select(
        F.col("id").alias("obligation_id"), "obligation_type", "metric", "value",
        F.coalesce(V.micros(V.parse_iso(F.col("effective_date_start"))), F.lit(-(2**62)).cast("bigint")).alias("from_us"),
        F.coalesce(V.micros(V.parse_iso(F.col("effective_date_end"))), F.lit(2**62).cast("bigint")).alias("to_us"))
    applied = hop("applies_to", "rule_id", "subject_id", "rule_id" if subjects is None else "subject_id")
    if subjects is not None:
        applied = applied.join(subjects, "subject_id")
    via_rule = hop("scoped_to", "rule_id", "rule_token", "rule_id")
    # all joins of a rule, then all joins of an obligation: paths are moved once for each
    paths = applied.join(hop("consists_of", "rule_id", "obligation_id", "rule_id"), "rule_id").join(via_rule, "rule_id", "left")
    placed = paths.join(obligations, "obligation_id").join(
        hop("scoped_to", "obligation_id", "token", "obligation_id"), "obligation_id", "left")
    return placed.withColumn("token", F.coalesce("token", "rule_token", F.lit("*"))).drop("rule_token")


def kg_slice(records: DataFrame, nodes: DataFrame, edges: DataFrame, *, id_col: str = "measurement_id",
             attach: bool = False, apart: bool = False) -> DataFrame:
    """Obligations in force per record: subject, then rule, obligation, date and place.

    ``records`` carry ``subject_id``, ``ts`` and ``jurisdiction``. One row per (record, rule, obligation); with ``attach`` one
    per (record, ``role``, ``node_id``): the rules, the obligations, and all that is :func:`attached` to them.

    Everything that multiplies happens on the paths, and only on those of subjects that have records; they meet the records once,
    by subject. ``apart`` says that no id has several subjects (:func:`shared_ids`): rows then stay where they met, keep
    ``HOME``, which names the place, and can be counted per record without being moved.
    """
    us = V.micros(F.col("ts"))
    sizes = records.filter("subject_id IS NOT NULL").groupBy("subject_id").agg(
        F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("_slices"))
    large = sizes.filter("_slices > 1").withColumnRenamed("_slices", "_of")
    # an id lies in one slice of its subject; paths go to all slices
    placed = records.join(large, "subject_id", "left").withColumn(
        "_slice", F.coalesce(F.pmod(F.xxhash64(id_col), F.col("_of")), F.lit(0)).cast("int")).drop("_of")
    paths = duties(nodes, edges, sizes)
    found = ["rule_id", "obligation_id"]
    if attach:
        found, where = ["role", "node_id"], ["subject_id", "_slices", "from_us", "to_us", "token"]
        own = F.array(*[F.struct(F.lit(role).alias("role"), F.col(node).alias("node_id"))
                        for role, node in (("rule", "rule_id"), ("obligation", "obligation_id"))])
        paths = paths.select(*where, F.inline(own)).unionByName(attached(paths, edges, keys=where))
    paths = paths.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    place = F.col("jurisdiction").isNull() | (F.col("token") == "*") | (F.col("token") == F.col("jurisdiction"))
    hits = _at_home(placed).join(_at_home(paths), HOME).filter((F.col("from_us") <= us) & (us <= F.col("to_us")) & place)
    keep = [*(HOME if apart else []), id_col, *found]
    return hits.select(*keep).dropDuplicates(keep)


def _at_home(rows: DataFrame) -> DataFrame:
    """Rows by subject and slice. The number of parts is given, as rows multiply in the joins that follow and parts merged by
    their size before would not fit memory after."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *HOME)


def shared_ids(records: DataFrame, *, id_col: str = "measurement_id") -> DataFrame:
    """Ids that records of several subjects carry, NULL among them; written, so that its size is known."""
    seen = records.filter("subject_id IS NOT NULL").groupBy(id_col).agg(F.min("subject_id").alias("_a"), F.max("subject_id").alias("_b"))
    return materialize(seen.filter("_a <> _b").select(F.col(id_col).alias("shared_id")), "shared")


def attachments(edges: DataFrame) -> DataFrame:
    """(owner, ``role``, ``node_id``): what hangs on each node directly, and the citations of all of that.

    Graph side only: definitions, exemptions and precedents of obligations, and citations of the owner and of
    what hangs on it.
    """
    near = edges.filter(F.col("type").isin("defined_by", "exempted_by", "interpreted_by")).select(
        F.col("from_id").alias("owner"), F.col("type").alias("role"), F.col("to_id").alias("node_id"))
    amended = edges.filter("type = 'amended_by'").select(
        F.col("to_id").alias("owner"), F.col("type").alias("role"), F.col("from_id").alias("node_id"))
    hanging = near.unionByName(amended)
    cites = edges.filter("type = 'cited_by'").select(F.col("from_id").alias("cited"), F.col("to_id").alias("citation"))
    own = cites.select(F.col("cited").alias("owner"), F.lit("cited_by").alias("role"), F.col("citation").alias("node_id"))
    deep = hanging.join(cites, F.col("node_id") == F.col("cited")).select(
        "owner", F.lit("cited_by").alias("role"), F.col("citation").alias("node_id"))
    return hanging.unionByName(own).unionByName(deep).distinct()


def attached(slices: DataFrame, edges: DataFrame, *, id_col: str = "measurement_id", keys: list[str] | None = None) -> DataFrame:
    """Rows (record, ``role``, ``node_id``) of everything attached to a slice's rules and obligations, without repeats.

    ``keys`` names columns that stand for the record; paths of :func:`duties` are few where slices are many.
    """
    keys = keys or [id_col]
    owners = slices.select(*keys, F.explode(F.array("rule_id", "obligation_id")).alias("owner"))
    return owners.join(attachments(edges), "owner").select(*keys, "role", "node_id").distinct()


def slice_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as a flat rule set: one rule per (subject, obligation) path, ready for ``prepare_rules``.

    A path under several places becomes one rule per place.
    """
    tiers = nodes.filter("type = 'Rule'").select(F.col("id").alias("rule_id"), "risk_tier")
    d = duties(nodes, edges).join(tiers, "rule_id", "left")
    return d.select(
        F.col("obligation_id").alias("rule_id"), F.lit(1).alias("ord"), F.col("obligation_type").alias("operator"),
        "metric", "value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("cmp_op"),
        F.lit(None).cast("bigint").alias("seconds"), F.lit(None).cast("double").alias("value_seconds"),
        F.lit(None).cast("bigint").alias("fresh_seconds"),
        F.to_json(F.array(F.col("token"))).alias("jurisdiction"),
        F.when(F.col("from_us") > -(2**61), V.iso_text(F.timestamp_micros("from_us"))).alias("effective_date"),
        F.when(F.col("to_us") < 2**61, V.iso_text(F.timestamp_micros("to_us"))).alias("sunset_date"),
        "risk_tier", F.lit(None).cast("string").alias("version"), "subject_id")


# ---- integrity -----------------------------------------------------------------------------------

def _issue(df: DataFrame, kind: str, node: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("issue_type"), F.lit(SEVERITY[kind]).alias("severity"), node.alias("node_id"),
                     detail.cast("string").alias("detail"))


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Ids used more than once, within one kind or across kinds."""
    counts = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _issue(counts, "DUPLICATE_NODE_ID", F.col("id"), F.col("n"))


def _node_types(nodes: DataFrame) -> DataFrame:
    # an id used by several kinds counts as the kind that is listed last
    order = F.create_map(*[x for i, k in enumerate(dict.fromkeys((
        "Subject", "Rule", "Obligation", "Definition", "Exemption", "Precedent", "Jurisdiction", "Citation")))
        for x in (F.lit(k), F.lit(i))])
    return nodes.groupBy("id").agg(F.max_by("type", order[F.col("type")]).alias("node_type"))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    known = nodes.select("id").distinct()

    def side(column, words):
        lost = edges.join(known, F.col(column) == F.col("id"), "left_anti")
        return _issue(lost, "DANGLING_EDGE", F.col(column), F.concat(F.col("type"), F.lit(f" {words}")))
    return side("from_id", "from").unionByName(side("to_id", "to"))


def edge_target_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    expected = F.create_map(*[x for k, v in EDGE_TARGETS.items() for x in (F.lit(k), F.lit(v))])[F.col("type")]
    # an edge type that the table does not know fits no target
    typed = edges.join(_node_types(nodes), F.col("to_id") == F.col("id")).filter(
        expected.isNull() | (expected != F.col("node_type")))
    return _issue(typed, "INVALID_EDGE_TARGET_TYPE", F.col("to_id"),
                  F.concat(F.col("type"), F.lit(" "), F.col("from_id"), F.lit(" "), F.col("node_type")))


def rules_without_obligation(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.filter("type = 'consists_of'").select(F.col("from_id").alias("id"))
    lost = nodes.filter("type = 'Rule'").select("id").distinct().join(used, "id", "left_anti")
    return _issue(lost, "RULE_WITHOUT_OBLIGATION", F.col("id"), F.lit(None))


def orphan_obligations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.filter("type = 'consists_of'").select(F.col("to_id").alias("id"))
    lost = nodes.filter("type = 'Obligation'").select("id").distinct().join(used, "id", "left_anti")
    return _issue(lost, "OBLIGATION_WITHOUT_RULE", F.col("id"), F.lit(None))


def schema_issues(nodes: DataFrame) -> DataFrame:
    """Unknown obligation types and risk tiers, obligations without a readable start date."""
    duty = nodes.filter("type = 'Obligation'")
    kinds = duty.filter(~F.coalesce(F.col("obligation_type").isin(*P.OBLIGATION_TYPES), F.lit(False)))
    dates = duty.filter(V.parse_iso(F.col("effective_date_start")).isNull())
    tiers = nodes.filter("type = 'Rule'").filter(
        F.col("risk_tier").isNotNull() & ~F.col("risk_tier").isin("low", "medium", "high"))
    return (_issue(kinds, "UNKNOWN_OBLIGATION_TYPE", F.col("id"), F.col("obligation_type"))
            .unionByName(_issue(dates, "MISSING_EFFECTIVE_DATE", F.col("id"), F.col("effective_date_start")))
            .unionByName(_issue(tiers, "UNKNOWN_RISK_TIER", F.col("id"), F.col("risk_tier"))))


def uncited_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    need = nodes.filter(F.col("type").isin("Obligation", "Definition", "Exemption", "Precedent")).select("id", "type")
    used = edges.filter("type = 'cited_by'").select(F.col("from_id").alias("id"))
    lost = need.distinct().join(used, "id", "left_anti")
    return _issue(lost, "NODE_WITHOUT_CITATION", F.col("id"), F.col("type"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All standard findings of a graph."""
    return (duplicate_nodes(nodes).unionByName(dangling_edges(nodes, edges))
            .unionByName(edge_target_types(nodes, edges)).unionByName(rules_without_obligation(nodes, edges))
            .unionByName(orphan_obligations(nodes, edges)))


def validation_result(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals; clean unless something CRITICAL or HIGH was found.

    The checks read both tables several times, so these are written once, as narrow as they need them.
    """
    nodes, edges = materialize(nodes, "nodes"), materialize(edges, "edges")
    issues = validate(nodes, edges).agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("blocking_issues"))
    return issues.select(
        nodes.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_nodes"),
        edges.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total_edges"),
        "total_issues", (F.col("blocking_issues") == 0).alias("is_clean"))


# ---- contradictions -------------------------------------------------------------------------------

def _blocks(first: Column, last: Column, top: int) -> Column:
    """The fewest aligned power-of-two blocks that cover ``first..last``: array of (level, number)."""
    shape = "struct<s:bigint,e:bigint,out:array<struct<l:int,b:bigint>>>"
    start = F.struct(first.cast("bigint").alias("s"), last.cast("bigint").alias("e"),
                     F.array().cast("array<struct<l:int,b:bigint>>").alias("out")).cast(shape)

    def step(acc, level):
        s, e = acc["s"], acc["e"]
        live, odd, even = s <= e, (s % 2) == 1, (e % 2) == 0
        one = F.when(live & odd, F.array(F.struct(level.alias("l"), s.alias("b")))).otherwise(F.array())
        two = F.when(live & even & ~((s == e) & odd), F.array(F.struct(level.alias("l"), e.alias("b")))).otherwise(F.array())
        grown = F.concat(acc["out"], one.cast("array<struct<l:int,b:bigint>>"), two.cast("array<struct<l:int,b:bigint>>"))
        return F.struct(F.when(live, F.floor((s + 1) / 2)).otherwise(1).cast("bigint").alias("s"),
                        F.when(live, F.floor((e - 1) / 2)).otherwise(0).cast("bigint").alias("e"), grown.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(top)), start, step, lambda acc: acc["out"])


def _timed(rules: DataFrame, unit_seconds: int) -> tuple[DataFrame, Column, Column]:
    """``rules`` with their periods in units, the entries under which a period is stored, and those under which one that
    overlaps it asks: arrays of (kind, level, block). One small job over the rules' dates."""
    unit = unit_seconds * V.MICROS
    # prepared rules are written once: they are read for the dates, for what is stored and for what is asked
    needed = [c for c in rules.columns if c in ("rule_id", "metric", "operator", "tokens", "from_us", "to_us") or c.startswith("_")]
    rules = materialize(rules.select(*needed), "timed")

    def units(us):
        return (us - F.pmod(us, F.lit(unit))) / F.lit(unit)

    # columns of their own, so that nothing below works them out again per level
    rules = rules.withColumns({"_first": units(F.col("from_us")).cast("bigint"), "_end": units(F.col("to_us")).cast("bigint")})
    # the levels follow the data's own dates; an end without a date lies just outside of them
    dated = (F.col("from_us") > OPEN_FROM, F.col("to_us") < OPEN_TO)
    ends = rules.agg(F.min(F.when(dated[0], F.col("_first"))), F.max(F.when(dated[1], F.col("_end"))),
                     F.min(F.when(dated[1], F.col("_end"))), F.max(F.when(dated[0], F.col("_first")))).first()
    known = [x for x in ends if x is not None] or [0]
    base, span = min(known) - 1, max(known) - min(known) + 3
    top = max(1, span.bit_length())
    rules = rules.withColumns({"_first": F.when(dated[0], F.col("_first") - base).otherwise(0).cast("bigint"),
                               "_end": F.when(dated[1], F.col("_end") - base).otherwise(span).cast("bigint")})
    first, last = F.col("_first"), F.col("_end")
    def entry(kind, level, block):
        return F.named_struct(F.lit("kind"), F.lit(kind), F.lit("l"), level, F.lit("b"), block)

    def spans(kind):
        return F.transform(_blocks(first, last, top), lambda x: entry(kind, x["l"], x["b"]))

    def around(kind):
        """The blocks around the first unit, one per level."""
        return F.transform(F.sequence(F.lit(0), F.lit(top)), lambda lv: entry(
            kind, lv, F.floor(first / F.pow(F.lit(2.0), lv)).cast("bigint")))

    # a stored period is found by a start inside it; a stored start is found by a period around it
    stored = F.concat(spans("span"), around("point"))
    asked = F.concat(around("span"), spans("point"))
    return rules, stored, asked


def _spread_out(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to as many tasks as a shuffle has. A small file of rules becomes some hundred entries a rule, and no task should
    make and sort most of them. Entries are never empty; explode_outer keeps a test of their size from running ahead of that."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _met(held: DataFrame, asks: DataFrame, best: list[Column], stored: Column, asked: Column) -> DataFrame:
    """``asks`` with ``best`` over the rows of ``held`` on their metric and token whose periods overlap theirs; asks without any go.

    ``best`` are minima and maxima that keep the names of their columns, so they can be taken over parts first. Rows of one period are
    one before they become entries, and a period is asked about once however many rules have it. The joins are by sorted rows:
    sizes are estimated without what ``explode`` multiplies, and a broadcast would bring all entries to the driver.
    """
    period, key = ["metric", "token", "_first", "_end"], ["metric", "token", "kind", "l", "b"]
    held = materialize(held.groupBy(*period).agg(*best), "held")
    values = [c for c in held.columns if c not in period]
    table = _spread_out(held).withColumn("x", F.explode_outer(stored)).select("metric", "token", "x.*", *values).groupBy(*key).agg(*best)
    periods = _spread_out(materialize(asks.select(*period).distinct(), "asked"))
    found = periods.withColumn("x", F.explode_outer(asked)).select(*period, "x.*").join(table.hint("merge"), key).groupBy(*period).agg(*best)
    return asks.join(found.hint("merge"), period)


def contradictions(rules: DataFrame, *, unit_seconds: int = 86_400) -> DataFrame:
    """Obligations on one metric and place whose bounds exclude each other while both are valid.

    A rule for everywhere (``*``) meets the rules of all places. The place of a row is that of its lower bound.

    ``rules`` are prepared rules. One row per lower-bound obligation that clashes, with the tightest opposing
    upper bound as witness. Validity is compared in units of ``unit_seconds`` (whole days).

    Two periods overlap exactly when the start of one lies in the other. Periods are cut into nested power-of-two
    blocks, points are looked up under the blocks around them, and upper bounds are reduced to the tightest per block
    before they meet lower bounds. So no pairs are formed, and the work is linear in the rules up to the number
    of levels, the logarithm of the span between the first and the last date of the rules in units.
    """
    kind, duty = F.col("operator"), F.col("duty")
    low = F.when(kind.isin("must_be_at_least", "must_be_above", "must_equal"), duty["number"]).when(
        kind == "must_be_within", duty["low"])
    high = F.when(kind.isin("must_not_exceed", "must_be_below", "must_equal"), duty["number"]).when(
        kind == "must_be_within", duty["high"])
    rules, stored, asked = _timed(rules.withColumns({"_low": low, "_high": high}), unit_seconds)
    base = rules.select("rule_id", "metric", F.explode("tokens").alias("token"), F.col("_low").alias("low"), F.col("_high").alias("high"),
                        (kind == "must_be_above").alias("low_open"), (kind != "must_be_below").alias("high_closed"), "_first", "_end")
    tight = F.struct("high", "high_closed", F.col("rule_id").alias("other"))
    # a bound is found under its own place and, for questions from everywhere, under a mark for any place
    anywhere = F.lit("\u0000any")
    held = base.filter("high IS NOT NULL").select("metric", F.explode(F.array(F.col("token"), anywhere)).alias("token"), "_first", "_end", tight.alias("t"))
    place = F.col("token")
    where = F.when(place == "*", F.array(anywhere)).otherwise(F.array(place, F.lit("*")))
    asks = base.filter("low IS NOT NULL").select("metric", place.alias("place"), F.explode(where).alias("token"), "rule_id", "low",
                                                 "low_open", "_first", "_end")
    met = _met(held, asks, [F.min("t").alias("t")], stored, asked)
    best = met.groupBy("metric", F.col("place").alias("token"), "rule_id", "low", "low_open").agg(F.min("t").alias("t"))
    clash = (F.col("low") > F.col("t.high")) | (
        (F.col("low") == F.col("t.high")) & (F.col("low_open") | ~F.col("t.high_closed")))
    return best.filter(clash).select(
        "metric", "token", "rule_id", "low", F.col("t.high").alias("high"), F.col("t.other").alias("witness_id"))


def value_clashes(rules: DataFrame, *, unit_seconds: int = 86_400) -> DataFrame:
    """Values that one obligation demands and another forbids, on one metric and place, while both are valid.

    One row per ``must_equal`` whose value a ``must_not_equal`` or ``must_not_be_one_of`` excludes, with the first such rule as
    witness. The forbidden values are an inverted index (metric, place, value, block of time) that keeps the first rule per
    entry, so no pairs are formed; values are compared as the checks compare them, text and lists included.
    """
    kind, duty = F.col("operator"), F.col("duty")
    forbidden = F.when(kind == "must_not_equal", F.array(duty["key"])).when(kind == "must_not_be_one_of", duty["keys"])
    rules, stored, asked = _timed(rules.withColumns({
        "_demanded": F.when(kind == "must_equal", duty["key"]), "_forbidden": forbidden}), unit_seconds)
    base = _spread_out(rules).select("rule_id", "metric", F.explode("tokens").alias("token"), "_demanded", "_forbidden",
                        stored.alias("stored"), asked.alias("asked"))
    key = ["metric", "token", "value", "kind", "l", "b"]
    anywhere = F.lit("\u0000any")
    table = (base.filter("_forbidden IS NOT NULL").withColumn("value", F.explode("_forbidden"))
             .withColumn("token", F.explode(F.array(F.col("token"), anywhere))).withColumn("x", F.explode_outer("stored"))
             .select("metric", "token", "value", "x.*", "rule_id").groupBy(*key).agg(F.min("rule_id").alias("other")))
    where = F.when(F.col("token") == "*", F.array(anywhere)).otherwise(F.array("token", F.lit("*")))
    asks = (base.filter("_demanded IS NOT NULL").select("metric", F.col("token").alias("place"), F.explode(where).alias("token"), "rule_id",
                                                        F.col("_demanded").alias("value"), "asked").withColumn("x", F.explode_outer("asked")))
    met = asks.select("metric", "place", "token", "value", "rule_id", "x.*").join(table, key)
    return met.groupBy("metric", F.col("place").alias("token"), "rule_id", "value").agg(F.min("other").alias("witness_id"))


def demand_clashes(rules: DataFrame, *, unit_seconds: int = 86_400) -> DataFrame:
    """Values of one metric and place that ``must_equal`` demands while another ``must_equal`` demands something else.

    One row per demand that another one, valid at some time of its own, contradicts. Of all such demands the witness is the one
    with the smallest value (ties: smallest id), or, where that is the same value, the one with the largest (ties: largest id). Blocks of
    time keep the smallest and the largest demand only, so there are no pairs, however many rules one metric has. Values are compared as the checks
    compare them; demands without a value do not take part.
    """
    rules, stored, asked = _timed(rules.filter(F.col("operator") == "must_equal").withColumn("_demanded", F.col("duty")["key"]), unit_seconds)
    base = rules.filter("_demanded IS NOT NULL").select(
        "rule_id", "metric", F.explode("tokens").alias("token"), F.struct(F.col("_demanded").alias("value"), F.col("rule_id").alias("id")).alias("own"),
        "_first", "_end")
    anywhere = F.lit("\u0000any")
    held = base.select("metric", F.explode(F.array(F.col("token"), anywhere)).alias("token"), "_first", "_end",
                       F.col("own").alias("low"), F.col("own").alias("high"))
    where = F.when(F.col("token") == "*", F.array(anywhere)).otherwise(F.array("token", F.lit("*")))
    asks = base.select("metric", F.col("token").alias("place"), F.explode(where).alias("token"), "own", "_first", "_end")
    best = [F.min("low").alias("low"), F.max("high").alias("high")]
    met = _met(held, asks, best, stored, asked).groupBy("metric", F.col("place").alias("token"), "own").agg(*best)
    other = F.when(F.col("low.value") != F.col("own.value"), F.col("low")).when(F.col("high.value") != F.col("own.value"), F.col("high"))
    return met.withColumn("other", other).filter("other IS NOT NULL").select(
        "metric", "token", F.col("own.id").alias("rule_id"), F.col("own.value").alias("value"), F.col("other.id").alias("witness_id"))


# ---- cycles -----------------------------------------------------------------------------------------

def precedent_cycles(edges: DataFrame, *, types: tuple = ("amended_by", "interpreted_by")) -> DataFrame:
    """Nodes that lie on a cycle of precedent edges, with the cycle's component (its largest id).

    Repeats until nothing is left: drop nodes without both an incoming and an outgoing edge, spread the largest
    id along the edges, and take, per colour, the nodes that reach the colour's own node. Each round works on
    tables; only row counts come to the driver.
    """
    spark = edges.sparkSession
    live = materialize(edges.filter(F.col("type").isin(*types)).select("from_id", "to_id").distinct(), "edges")
    found = []
    while True:
        live = _trim(live)
        if live.isEmpty():
            break
        colour = _spread(live)
        inner = materialize(
            live.join(colour.withColumnsRenamed({"id": "from_id", "colour": "c1"}), "from_id")
            .join(colour.withColumnsRenamed({"id": "to_id", "colour": "c2"}), "to_id")
            .filter("c1 = c2").select("from_id", "to_id", F.col("c1").alias("colour")), "inner")
        reach = materialize(colour.filter("id = colour").select("id", "colour"), "reach")
        size = reach.count()
        while True:
            more = inner.join(reach.withColumnRenamed("id", "to_id"), ["to_id", "colour"]).select(
                F.col("from_id").alias("id"), "colour")
            reach = materialize(reach.unionByName(more).distinct(), "reach")
            grown = reach.count()
            if grown == size:
                break
            size = grown
        loops = inner.join(reach.withColumnRenamed("id", "from_id"), ["from_id", "colour"]).join(
            reach.withColumnRenamed("id", "to_id"), ["to_id", "colour"])
        found.append(materialize(loops.select(F.col("from_id").alias("node_id"), F.col("colour").alias("component"))
                                 .distinct(), "cycles"))
        done = reach.select("id")
        live = materialize(live.join(done.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
                           .join(done.withColumnRenamed("id", "to_id"), "to_id", "left_anti"), "edges")
    if not found:
        return spark.createDataFrame([], "node_id string, component string")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _trim(live: DataFrame) -> DataFrame:
    size = live.count()
    while size:
        ins = live.select(F.col("to_id").alias("from_id")).distinct()
        outs = live.select(F.col("from_id").alias("to_id")).distinct()
        live = materialize(live.join(ins, "from_id", "left_semi").join(outs, "to_id", "left_semi"), "edges")
        left = live.count()
        if left == size:
            break
        size = left
    return live


def _spread(live: DataFrame) -> DataFrame:
    nodes = live.select(F.col("from_id").alias("id")).unionByName(live.select(F.col("to_id").alias("id"))).distinct()
    colour = materialize(nodes.withColumn("colour", F.col("id")), "colour")
    while True:
        pushed = live.join(colour.withColumnRenamed("id", "from_id"), "from_id").select(
            F.col("to_id").alias("id"), F.col("colour").alias("c"))
        best = pushed.groupBy("id").agg(F.max("c").alias("c"))
        stepped = materialize(colour.join(best, "id", "left").select(
            "id", F.greatest("colour", "c").alias("colour"), (F.col("c") > F.col("colour")).alias("moved")), "colour")
        moved = stepped.filter("moved").limit(1).count()
        colour = stepped.drop("moved")
        if not moved:
            return colour
