"""Queries over rule-graph integrity, document chunks and candidate extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulegauge.operators import extraction as X
from rulegauge.operators import graph as G
from rulegauge.plans import base as B
from rulegauge.sources.rulesets import RULE_FIELDS, prepare_rules

# ---- a rule graph at table scale: customers, orders, line items, parts, nations, with planted faults -----------

_LINE_SQL = "'l' || l_orderkey || '-' || l_linenumber"
_GRAPH_SQL = f"""
  nodes AS (
    SELECT 'c' || c_custkey AS id, 'Subject' AS type, NULL AS kind, NULL AS start, NULL AS risk FROM customer WHERE c_custkey % 50 <> 3
    UNION ALL SELECT 'o' || o_orderkey, 'Rule', NULL, NULL, CASE WHEN o_orderkey % 70 = 1 THEN 'extreme' WHEN o_orderkey % 3 = 0 THEN 'high' ELSE 'low' END FROM orders
    UNION ALL SELECT {_LINE_SQL}, 'Obligation', CASE WHEN l_partkey % 90 = 2 THEN 'must_maybe' ELSE 'must_not_exceed' END,
      CASE WHEN l_partkey % 80 = 5 THEN NULL WHEN l_partkey % 80 = 6 THEN 'soon' ELSE strftime(l_shipdate, '%Y-%m-%d') END, NULL FROM lineitem
    UNION ALL SELECT 'd' || p_partkey, CASE WHEN p_partkey % 60 = 7 THEN 'Exemption' ELSE 'Definition' END, NULL, NULL, NULL FROM part
    UNION ALL SELECT 'n' || n_nationkey, 'Jurisdiction', NULL, NULL, NULL FROM nation
    UNION ALL SELECT 'c' || s_suppkey, 'Citation', NULL, NULL, NULL FROM supplier WHERE s_suppkey % 10 = 4),
  edges AS (
    SELECT 'applies_to' AS type, 'o' || o_orderkey AS from_id, 'c' || o_custkey AS to_id FROM orders
    UNION ALL SELECT 'consists_of', 'o' || l_orderkey, {_LINE_SQL} FROM lineitem WHERE l_orderkey % 40 <> 9 AND l_partkey % 30 <> 11
    UNION ALL SELECT 'defined_by', {_LINE_SQL}, 'd' || l_partkey FROM lineitem
    UNION ALL SELECT 'scoped_to', {_LINE_SQL}, 'n' || l_suppkey % 27 FROM lineitem
    UNION ALL SELECT 'cited_by', 'd' || p_partkey, 'c' || (p_partkey % 2 * 10 + 4) FROM part WHERE p_partkey % 5 <> 0)"""


def trade_graph(spark, sf_dir):
    t = {n: B.table(spark, sf_dir, n) for n in ("customer", "orders", "part", "nation", "supplier")}
    lines = B.table(spark, sf_dir, "lineitem")

    def name(prefix, *cols):
        return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))

    blank = F.lit(None).cast("string")

    def node(df, ident, kind, obligation=blank, start=blank, risk=blank):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(ident.alias("id"), kind.alias("type"), obligation.alias("obligation_type"),
                         start.alias("effective_date_start"), risk.alias("risk_tier"))

    line, part = name("l", "l_orderkey", "l_linenumber"), F.col("l_partkey")
    start = F.when(part % 80 == 5, None).when(part % 80 == 6, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    nodes = [
        node(t["customer"].filter("c_custkey % 50 <> 3"), name("c", "c_custkey"), "Subject"),
        node(t["orders"], name("o", "o_orderkey"), "Rule", risk=F.when(F.col("o_orderkey") % 70 == 1, "extreme")
             .when(F.col("o_orderkey") % 3 == 0, "high").otherwise("low")),
        node(lines, line, "Obligation", F.when(part % 90 == 2, "must_maybe").otherwise("must_not_exceed"), start),
        node(t["part"], name("d", "p_partkey"), F.when(F.col("p_partkey") % 60 == 7, "Exemption").otherwise("Definition")),
        node(t["nation"], name("n", "n_nationkey"), "Jurisdiction"),
        node(t["supplier"].filter("s_suppkey % 10 = 4"), name("c", "s_suppkey"), "Citation")]

    def edge(df, kind, a, b):
        return df.select(F.lit(kind).alias("type"), a.alias("from_id"), b.alias("to_id"))
    edges = [
        edge(t["orders"], "applies_to", name("o", "o_orderkey"), name("c", "o_custkey")),
        edge(lines.filter("l_orderkey % 40 <> 9 AND l_partkey % 30 <> 11"), "consists_of", name("o", "l_orderkey"), line),
        edge(lines, "defined_by", line, name("d", "l_partkey")),
        edge(lines, "scoped_to", line, F.concat(F.lit("n"), (F.col("l_suppkey") % 27).cast("string"))),
        edge(t["part"].filter("p_partkey % 5 <> 0"), "cited_by", name("d", "p_partkey"),
             F.concat(F.lit("c"), (F.col("p_partkey") % 2 * 10 + 4).cast("string")))]
    return _all(nodes), _all(edges)


def _all(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_KINDS_SQL = """known AS (SELECT DISTINCT id FROM nodes), kinds AS (SELECT id, arg_max(type, CASE type WHEN 'Subject' THEN 0 WHEN 'Rule' THEN 1
    WHEN 'Obligation' THEN 2 WHEN 'Definition' THEN 3 WHEN 'Exemption' THEN 4 WHEN 'Precedent' THEN 5 WHEN 'Jurisdiction' THEN 6 ELSE 7 END) AS node_type FROM nodes GROUP BY 1)"""
_DUP = "SELECT 'DUPLICATE_NODE_ID' AS issue_type, id AS node_id, CAST(count(*) AS VARCHAR) AS detail FROM nodes GROUP BY id HAVING count(*) > 1"
_DANGLING = """SELECT 'DANGLING_EDGE', from_id, type || ' from' FROM edges WHERE from_id NOT IN (SELECT id FROM known)
  UNION ALL SELECT 'DANGLING_EDGE', to_id, type || ' to' FROM edges WHERE to_id NOT IN (SELECT id FROM known)"""
_TYPES = """SELECT 'INVALID_EDGE_TARGET_TYPE', to_id, e.type || ' ' || from_id || ' ' || node_type FROM edges e JOIN kinds k ON k.id = e.to_id
  WHERE node_type <> CASE e.type WHEN 'applies_to' THEN 'Subject' WHEN 'consists_of' THEN 'Obligation' WHEN 'defined_by' THEN 'Definition'
    WHEN 'scoped_to' THEN 'Jurisdiction' WHEN 'cited_by' THEN 'Citation' END"""
_COVER = "SELECT 'RULE_WITHOUT_OBLIGATION', id, NULL FROM (SELECT DISTINCT id FROM nodes WHERE type = 'Rule') WHERE id NOT IN (SELECT from_id FROM edges WHERE type = 'consists_of')"
_ORPHAN = "SELECT 'OBLIGATION_WITHOUT_RULE', id, NULL FROM (SELECT DISTINCT id FROM nodes WHERE type = 'Obligation') WHERE id NOT IN (SELECT to_id FROM edges WHERE type = 'consists_of')"


def _graph_query(name, fn, body):
    B.register(name, lambda spark, sf: fn(*trade_graph(spark, sf)).select("issue_type", "node_id", "detail"),
               f"WITH {_GRAPH_SQL}, {_KINDS_SQL} SELECT * FROM ({body}) q(issue_type, node_id, detail)")


_graph_query("kg_duplicates", lambda n, e: G.duplicate_nodes(n), _DUP)
_graph_query("kg_dangling", G.dangling_edges, _DANGLING)
_graph_query("kg_edge_types", G.edge_target_types, _TYPES)
_graph_query("kg_rule_cover", G.rules_without_obligation, _COVER)
_graph_query("kg_orphans", G.orphan_obligations, _ORPHAN)
_graph_query("kg_schema_issues", lambda n, e: G.schema_issues(n), """
  SELECT 'UNKNOWN_OBLIGATION_TYPE', id, kind FROM nodes WHERE type = 'Obligation' AND kind = 'must_maybe'
  UNION ALL SELECT 'MISSING_EFFECTIVE_DATE', id, start FROM nodes WHERE type = 'Obligation' AND (start IS NULL OR start = 'soon')
  UNION ALL SELECT 'UNKNOWN_RISK_TIER', id, risk FROM nodes WHERE risk = 'extreme'""")
_graph_query("kg_uncited", G.uncited_nodes, """
  SELECT 'NODE_WITHOUT_CITATION', id, type FROM (SELECT DISTINCT id, type FROM nodes WHERE type IN ('Obligation', 'Definition', 'Exemption', 'Precedent'))
  WHERE id NOT IN (SELECT from_id FROM edges WHERE type = 'cited_by')""")


@B.query("kg_validation", f"""WITH {_GRAPH_SQL}, {_KINDS_SQL}, issues AS (SELECT * FROM ({_DUP} UNION ALL {_DANGLING} UNION ALL {_TYPES}
    UNION ALL {_COVER} UNION ALL {_ORPHAN}) q(issue_type, node_id, detail))
  SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, count(*) AS total_issues,
    count(*) FILTER (WHERE issue_type <> 'OBLIGATION_WITHOUT_RULE') = 0 AS is_clean FROM issues""")
def _validation(spark, sf_dir):
    return G.validation_result(*trade_graph(spark, sf_dir))


@B.query("node_version", """SELECT p_partkey, 'sha256:' || sha256('{"id":"d' || p_partkey || '","name":"' || p_name || '","type":"Definition"}') AS version FROM part""")
def _version(spark, sf_dir):
    body = F.try_parse_json(F.format_string('{"type": "Definition", "name": "%s", "id": "d%s"}', F.col("p_name"), F.col("p_partkey")))
    return B.table(spark, sf_dir, "part").select("p_partkey", G.node_version(body).alias("version"))


# bounds of one metric per brand; kinds, values and periods by part key
_BOUND_SQL = """b AS (SELECT 'p' || p_partkey AS id, p_brand AS metric, 'n' || p_partkey % 3 AS token,
      CASE p_partkey % 4 WHEN 0 THEN p_size * 1.0 WHEN 2 THEN p_size * 1.0 WHEN 3 THEN p_size * 0.5 END AS lo,
      CASE p_partkey % 4 WHEN 1 THEN p_size + 8.0 WHEN 3 THEN p_size * 0.5 + 20 END AS hi, p_partkey % 4 = 2 AS lo_open, p_partkey % 8 <> 1 AS hi_closed,
      DATE '2020-01-01' + CAST(p_partkey * 37 % 1500 AS INTEGER) AS s, CASE WHEN p_partkey % 7 <> 0 THEN DATE '2020-01-01' + CAST(p_partkey * 37 % 1500 + p_partkey % 90 AS INTEGER) END AS e FROM part)"""


def _bound_rules(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    four = key % 4
    day = (key * 37 % 1500).cast("int")
    base = F.lit("2020-01-01").cast("date")
    kind = (F.when(four == 0, "must_be_at_least").when(four == 2, "must_be_above").when(four == 3, "must_be_within")
            .when(key % 8 == 1, "must_be_below").otherwise("must_not_exceed"))
    value = (F.when(four.isin(0, 2), size.cast("double").cast("string"))
             .when(four == 3, F.concat(F.lit("["), (size * 0.5).cast("double").cast("string"), F.lit(","),
                                       (size * 0.5 + 20).cast("double").cast("string"), F.lit("]")))
             .otherwise((size + 8).cast("double").cast("string")))
    raw = B.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("rule_id"), F.lit(1).alias("ord"), kind.alias("operator"),
        F.col("p_brand").alias("metric"), value.alias("value"),
        F.concat(F.lit('"n'), (key % 3).cast("string"), F.lit('"')).alias("jurisdiction"),
        F.date_add(base, day).cast("string").alias("effective_date"),
        F.when(key % 7 != 0, F.date_add(base, day + (key % 90).cast("int")).cast("string")).alias("sunset_date"))
    return prepare_rules(raw.select(*[(F.col(n) if n in raw.columns else F.lit(None)).cast(t).alias(n) for n, t in RULE_FIELDS.items()]))


@B.query("kg_contradictions", f"""WITH {_BOUND_SQL}, m AS (SELECT l.metric, l.token, l.id AS rule_id, l.lo AS low, l.lo_open, h.hi, h.hi_closed, h.id AS other,
    row_number() OVER (PARTITION BY l.id ORDER BY h.hi, h.hi_closed, h.id) AS n
    FROM b l JOIN b h ON l.metric = h.metric AND l.token = h.token AND l.lo IS NOT NULL AND h.hi IS NOT NULL
     AND l.s <= coalesce(h.e, DATE '2100-01-01') AND h.s <= coalesce(l.e, DATE '2100-01-01'))
  SELECT metric, token, rule_id, low::DOUBLE AS low, hi::DOUBLE AS high, other AS witness_id FROM m WHERE n = 1 AND (low > hi OR (low = hi AND (lo_open OR NOT hi_closed)))""")
def _contradictions(spark, sf_dir):
    return G.contradictions(_bound_rules(spark, sf_dir))


# demanded and forbidden values of one metric per brand
_VALUE_SQL = """v AS (SELECT 'p' || p_partkey AS id, p_brand AS metric, CASE WHEN p_partkey % 6 = 5 THEN '*' ELSE 'n' || p_partkey % 2 END AS token,
      p_partkey % 3 AS form, p_size % 7 AS v, DATE '2020-01-01' + CAST(p_partkey * 37 % 900 AS INTEGER) AS s,
      CASE WHEN p_partkey % 7 <> 0 THEN DATE '2020-01-01' + CAST(p_partkey * 37 % 900 + p_partkey % 200 AS INTEGER) ELSE DATE '2100-01-01' END AS e FROM part)"""


@B.query("kg_value_clashes", f"""WITH {_VALUE_SQL}
  SELECT a.metric, a.token, a.id AS rule_id, min(b.id) AS witness_id FROM v a JOIN v b ON a.metric = b.metric AND a.form = 0 AND b.form <> 0
    AND (a.token = b.token OR a.token = '*' OR b.token = '*') AND a.s <= b.e AND b.s <= a.e
    AND (a.v = b.v OR (b.form = 2 AND a.v = b.v + 1)) GROUP BY 1, 2, 3""")
def _value_clashes(spark, sf_dir):
    return G.value_clashes(_value_rules(spark, sf_dir)).select("metric", "token", "rule_id", "witness_id")


@B.query("kg_demand_clashes", f"""WITH {_VALUE_SQL}, d AS (SELECT * FROM v WHERE form = 0),
  m AS (SELECT a.metric, a.token, a.id, a.v, min((b.v, b.id)) AS low, max((b.v, b.id)) AS high FROM d a JOIN d b ON a.metric = b.metric
    AND (a.token = b.token OR a.token = '*' OR b.token = '*') AND a.s <= b.e AND b.s <= a.e GROUP BY 1, 2, 3, 4)
  SELECT metric, token, id AS rule_id, CASE WHEN low[1] <> v THEN low[2] ELSE high[2] END AS witness_id FROM m WHERE low[1] <> v OR high[1] <> v""")
def _demand_clashes(spark, sf_dir):
    return G.demand_clashes(_value_rules(spark, sf_dir)).select("metric", "token", "rule_id", "witness_id")


def _value_rules(spark, sf_dir):
    key, v = F.col("p_partkey"), F.col("p_size") % 7
    day = (key * 37 % 900).cast("int")
    base = F.lit("2020-01-01").cast("date")
    text = F.concat(F.lit('"v'), v.cast("string"), F.lit('"'))
    more = F.concat(F.lit("["), text, F.lit(',"v'), (v + 1).cast("string"), F.lit('"]'))
    fields = {"rule_id": F.concat(F.lit("p"), key.cast("string")), "ord": F.lit(1), "metric": F.col("p_brand"),
              "operator": F.element_at(F.array(F.lit("must_equal"), F.lit("must_not_equal"), F.lit("must_not_be_one_of")), (key % 3 + 1).cast("int")),
              "value": F.when(key % 3 == 2, more).otherwise(text),
              "jurisdiction": F.when(key % 6 == 5, F.lit('"*"')).otherwise(F.concat(F.lit('"n'), (key % 2).cast("string"), F.lit('"'))),
              "effective_date": F.date_add(base, day).cast("string"),
              "sunset_date": F.when(key % 7 != 0, F.date_add(base, day + (key % 200).cast("int")).cast("string"))}
    return prepare_rules(B.table(spark, sf_dir, "part").select(*[
        fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in RULE_FIELDS.items()]))


# precedent edges among parts: rings of five in every fiftieth block, otherwise towards the half key
_RING_SQL = """SELECT p_partkey AS a, CASE WHEN p_partkey % 50 < 4 THEN p_partkey + 1 WHEN p_partkey % 50 = 4 THEN p_partkey - 4
    ELSE p_partkey // 2 END AS b FROM part"""


def _precedents(spark, sf_dir):
    key = F.col("p_partkey")
    to = F.when(key % 50 < 4, key + 1).when(key % 50 == 4, key - 4).otherwise(F.floor(key / 2).cast("bigint"))
    return B.table(spark, sf_dir, "part").select(
        F.when(key % 2 == 0, "amended_by").otherwise("interpreted_by").alias("type"),
        F.format_string("p%08d", key).alias("from_id"), F.format_string("p%08d", to).alias("to_id"))


@B.query("kg_cycles", f"""WITH RECURSIVE e AS ({_RING_SQL}), w(start, cur, n, top) AS (SELECT a, b, 1, greatest(a, b) FROM e
    UNION ALL SELECT w.start, e.b, n + 1, greatest(top, e.b) FROM w JOIN e ON e.a = w.cur WHERE w.cur <> w.start AND n < 40)
  SELECT printf('p%08d', start) AS node_id, printf('p%08d', max(top)) AS component FROM w WHERE cur = start GROUP BY start""")
def _cycles(spark, sf_dir):
    return G.precedent_cycles(_precedents(spark, sf_dir))


@B.query("kg_flatten", """
  SELECT 'ob.' || l_partkey AS rule_id, 'cust.' || o_custkey AS subject_id, p_retailprice AS operand, 2 AS tier FROM
    (SELECT DISTINCT o_orderkey, o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) JOIN part ON p_partkey = l_partkey""")
def _flatten(spark, sf_dir):
    from rulegauge.plans.routing import slice_graph
    return prepare_rules(G.slice_rules(*slice_graph(spark, sf_dir))).select(
        "rule_id", "subject_id", F.col("operand.number").alias("operand"), "tier")


# ---- chunks ------------------------------------------------------------------------------------------------

_SIZE, _OVERLAP = 4000, 200


_CHUNK_SQL = f"""WITH RECURSIVE c(doc_id, text, n, start, stop) AS (
    SELECT doc_id, text, -1, CAST(0 AS BIGINT), CAST({_OVERLAP} AS BIGINT) FROM documents
    UNION ALL
    SELECT doc_id, text, n + 1, stop - {_OVERLAP}, CASE WHEN stop - {_OVERLAP} + {_SIZE} >= length(text) THEN length(text)
      ELSE stop - {_OVERLAP} + CASE WHEN regexp_matches(substr(text, stop - {_OVERLAP} + {_SIZE // 2 + 2}, {_SIZE // 2}), '[.!?\\n]')
        THEN {_SIZE // 2 + 1} + length(regexp_extract(substr(text, stop - {_OVERLAP} + {_SIZE // 2 + 2}, {_SIZE // 2}), '^((?s:.)*)[.!?\\n]', 0)) ELSE {_SIZE} END END
    FROM c WHERE n = -1 OR stop < length(text))"""


@B.query("doc_chunks", f"""{_CHUNK_SQL}
  SELECT doc_id, n AS chunk_index, start, stop - start AS n_chars, sha256(substr(text, start + 1, stop - start)) AS hash FROM c WHERE n >= 0""")
def _chunks(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.chunk(docs, size=_SIZE, overlap=_OVERLAP).select(
        "doc_id", "chunk_index", F.col("start").cast("bigint").alias("start"), F.length("chunk_text").cast("bigint").alias("n_chars"),
        F.sha2("chunk_text", 256).alias("hash"))


@B.query("doc_chunk_counts", f"""{_CHUNK_SQL}
  SELECT lang, count(*) AS n_chunks, CAST(sum(stop - start) AS BIGINT) AS n_chars FROM c JOIN documents USING (doc_id) WHERE n >= 0 GROUP BY 1""")
def _chunk_counts(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return X.chunk(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("chunk_text")).alias("n_chars"))


# ---- candidates ----------------------------------------------------------------------------------------------
# One response per line item of an order, with a candidate and a copy of it in capitals; qualities, blanks and
# repeats by key.

_CAND_SQL = """
  l AS (SELECT l_orderkey AS doc, (l_partkey * 1000 + l_suppkey) * 8 + l_linenumber AS chunk, pos, l_linenumber, l_partkey, l_suppkey,
      CAST(l_quantity AS INTEGER) AS q FROM lineitem, (VALUES (0), (1)) v(pos)),
  raw AS (SELECT *, l_partkey % 7 AS c, CASE WHEN l_suppkey % 2 = 0 AND pos = 0 THEN 'Tank ' ELSE 'TANK ' END || l_linenumber AS subject,
      CASE l_partkey % 4 WHEN 0 THEN 'must_not_exceed' WHEN 1 THEN 'Not_To_Exceed always' WHEN 2 THEN 'must_be_recorded_within' ELSE 'ought' END AS relation,
      CASE WHEN l_partkey % 11 = 0 THEN '  ' WHEN l_partkey % 5 = 0 THEN 'two days' ELSE q || ' ppm' END AS object FROM l),
  unwrapped AS (SELECT * FROM raw WHERE doc % 9 NOT IN (4, 5)),
  graded AS (SELECT *, CASE WHEN c = 2 THEN 'rule_' || chunk || '_' || pos || '_REJECTED' WHEN c = 4 THEN 'given.' || l_partkey ELSE 'rule_' || chunk || '_' || pos END AS id,
      CASE c WHEN 0 THEN 'EXPLICIT' WHEN 1 THEN 'EXPLICIT' WHEN 2 THEN 'DISCRETIONARY' WHEN 3 THEN 'DISCRETIONARY' WHEN 4 THEN 'CONFLICTING' ELSE 'EXPLICIT' END AS quality,
      c = 2 AS rejected FROM unwrapped WHERE c <> 5),
  valid AS (SELECT * FROM graded WHERE rejected OR trim(object) <> ''),
  deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, lower(subject), lower(relation), lower(object) ORDER BY chunk, pos) AS n FROM valid) WHERE n = 1)"""


def _responses(spark, sf_dir):
    lines = B.table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey")
    c = part % 7
    subject = F.concat(F.when(F.col("l_suppkey") % 2 == 0, "Tank ").otherwise("TANK "), F.col("l_linenumber").cast("string"))
    relation = F.element_at(F.array(F.lit("must_not_exceed"), F.lit("Not_To_Exceed always"), F.lit("must_be_recorded_within"),
                                    F.lit("ought")), (part % 4 + 1).cast("int"))
    obj = F.when(part % 11 == 0, "  ").when(part % 5 == 0, "two days").otherwise(
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" ppm")))
    quality = (F.when(c == 0, '"extraction_quality":"explicit",').when(c == 1, '"extraction_quality":"","confidence":"EXPLICIT",')
               .when(c == 2, '"confidence":"Implied",').when(c == 3, "")
               .when(c == 4, F.concat(F.lit('"extraction_quality":"CONFLICTING","id":"given.'), part.cast("string"), F.lit('",')))
               .when(c == 5, '"extraction_quality":"CERTAIN",').otherwise('"extraction_quality":"EXPLICIT",'))
    def item(name):
        return F.concat(F.lit("{"), quality, F.format_string(
            '"subject":"%s","relation":"%s","object":"%s","reasoning":"line"}', name, relation, obj))
    items = F.concat(item(subject), F.lit(","), item(F.upper(subject)))
    n = F.col("l_orderkey") % 9
    text = (F.when(n == 4, F.lit("no rules here")).when(n == 5, '{"answer": []}')
            .when(n == 6, F.concat(F.lit('{"rules":['), items, F.lit("]}")))
            .otherwise(F.concat(F.lit("["), items, F.lit("]"))))
    place = (part * 1000 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")
    return lines.select(F.col("l_orderkey").alias("doc_id"), place.alias("chunk_index"), text.alias("response"))


def _graded(spark, sf_dir):
    return X.grade(X.unwrap(_responses(spark, sf_dir))[0])


@B.query("cand_unwrap", """SELECT l_orderkey AS doc_id, CASE WHEN l_orderkey % 9 = 4 THEN 'not_json' WHEN l_orderkey % 9 = 5 THEN 'no_rule_array' ELSE 'ok' END AS reason,
  CASE WHEN l_orderkey % 9 IN (4, 5) THEN count(*) ELSE count(*) * 2 END AS n_items FROM lineitem GROUP BY l_orderkey""")
def _unwrap(spark, sf_dir):
    good, bad = X.unwrap(_responses(spark, sf_dir))
    rows = good.select("doc_id", F.lit("ok").alias("reason")).unionByName(bad.select("doc_id", "reason"))
    return rows.groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n_items"))


@B.query("cand_quality", f"WITH {_CAND_SQL} SELECT doc AS doc_id, CAST(pos AS INTEGER) AS pos, id, quality, rejected, subject FROM graded")
def _quality(spark, sf_dir):
    return _graded(spark, sf_dir).select("doc_id", "pos", "id", F.col("extraction_quality").alias("quality"), "rejected", "subject")


@B.query("cand_valid", f"WITH {_CAND_SQL} SELECT doc AS doc_id, CAST(pos AS INTEGER) AS pos, subject FROM valid")
def _valid(spark, sf_dir):
    return X.valid(_graded(spark, sf_dir)).select("doc_id", "pos", "subject")


@B.query("cand_dedup", f"WITH {_CAND_SQL} SELECT doc AS doc_id, CAST(pos AS INTEGER) AS pos, subject, object FROM deduped")
def _dedup(spark, sf_dir):
    return X.deduplicate(X.valid(_graded(spark, sf_dir))).select("doc_id", "pos", "subject", "object")


@B.query("cand_quality_counts", f"WITH {_CAND_SQL} SELECT doc AS doc_id, quality, count(*) AS n_rules FROM deduped GROUP BY 1, 2")
def _quality_counts(spark, sf_dir):
    return X.quality_counts(X.deduplicate(X.valid(_graded(spark, sf_dir)))).withColumnRenamed("extraction_quality", "quality")


@B.query("cand_by_quality", f"WITH {_CAND_SQL} SELECT doc AS doc_id, id FROM deduped WHERE quality = 'CONFLICTING'")
def _by_quality(spark, sf_dir):
    graded = X.valid(_graded(spark, sf_dir)).select("doc_id", "chunk_index", "pos", "id", "subject", "relation", "object", "extraction_quality")
    return X.of_quality(X.deduplicate(graded), "CONFLICTING").select("doc_id", "id")


_RELATIONS = ("Must_Not_Exceed the cap", "not_to_exceed", "cannot_exceed", "must_be_at_least", "is at_least", "must_be_below", "must_be_above",
              "must_be_within", "stays within", "must_be_one_of", "must_not_be_one_of", "must_be_recorded_within", " must_not ", "MUST", "should", "may")
_TYPE_OF = ("must_not_exceed", "must_not_exceed", "must_not_exceed", "must_be_at_least", "must_be_at_least", "must_be_below", "must_be_above",
            "must_be_within", "must_be_within", "must_be_one_of", "must_not_be_one_of", "must_be_recorded_within", "must_not", "must", "should",
            "discretionary")


def _relation(parity):
    def run(spark, sf_dir):
        text = F.element_at(F.array(*[F.lit(r) for r in _RELATIONS]), (F.col("p_partkey") % 16 + 1).cast("int"))
        return B.table(spark, sf_dir, "part").select("p_partkey", X.relation_type(text, parity=parity).alias("kind"))
    return run


def _relation_sql(kinds):
    listed = ", ".join(f"'{k}'" for k in kinds)
    return f"SELECT p_partkey, [{listed}][p_partkey % 16 + 1] AS kind FROM part"


B.register("relation_type", _relation(False), _relation_sql(_TYPE_OF))
B.register("relation_type_listed", _relation(True), _relation_sql(["must_be_within" if k == "must_be_recorded_within" else k for k in _TYPE_OF]))


def _objects():
    key = F.col("p_partkey")
    price = F.col("p_retailprice").cast("string")
    n = key % 6
    return (F.when(n == 0, F.concat(F.col("p_size").cast("string"), F.lit(" ppm"))).when(n == 1, F.concat(F.lit(" -"), price, F.lit("mg/l ")))
            .when(n == 2, F.concat(F.lit("+"), F.col("p_size").cast("string"), F.lit("%"))).when(n == 3, F.lit("two business days"))
            .when(n == 4, F.concat(F.col("p_size").cast("string"), F.lit(" parts per million"))).otherwise(price))


@B.query("object_value", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(-p_retailprice AS VARCHAR)
    WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN '"two business days"' WHEN 4 THEN '"' || p_size || ' parts per million"' ELSE CAST(p_retailprice AS VARCHAR) END AS operand FROM part""")
def _object_value(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select("p_partkey", X.object_value(_objects()).alias("operand"))


@B.query("object_unit", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ppm' WHEN 1 THEN 'mg/l' WHEN 2 THEN '%' END AS unit FROM part")
def _object_unit(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select("p_partkey", X.object_unit(_objects()).alias("unit"))


@B.query("slug", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE replace(p_name, ' ', '.') || '.' || p_partkey || '_x-y' END AS slug FROM part""")
def _slug(spark, sf_dir):
    from rulegauge.functions import values as V
    text = F.when(F.col("p_partkey") % 5 == 0, " ?.! ").otherwise(
        F.concat(F.lit("("), F.upper("p_name"), F.lit(" / "), F.col("p_partkey").cast("string"), F.lit("_x-Y)")))
    return B.table(spark, sf_dir, "part").select("p_partkey", V.slug(text).alias("slug"))


_EMIT_SQL = f"""{_CAND_SQL}, c AS (SELECT *, doc || '.' || id AS rid, 'subj.tank.' || l_linenumber AS sid FROM deduped),
  nodes AS (SELECT sid AS id, 'Subject' AS type, NULL AS kind, NULL AS operand, NULL AS unit FROM (SELECT DISTINCT sid FROM c)
    UNION ALL SELECT 'rule.' || lower(rid), 'Rule', NULL, NULL, NULL FROM c
    UNION ALL SELECT 'ob.' || lower(rid), 'Obligation', CASE WHEN relation = 'ought' THEN 'discretionary' WHEN relation LIKE '%exceed%' THEN 'must_not_exceed' ELSE relation END,
      CASE WHEN object LIKE '% ppm' THEN CAST(q AS VARCHAR) ELSE '"' || object || '"' END, CASE WHEN object LIKE '% ppm' THEN 'ppm' END FROM c
    UNION ALL SELECT 'cite.' || lower(rid), 'Citation', NULL, NULL, NULL FROM c
    UNION ALL SELECT 'us.federal', 'Jurisdiction', NULL, NULL, NULL)"""
_EMIT_SQL = _EMIT_SQL.replace("relation LIKE '%exceed%'", "lower(relation) LIKE '%exceed%'")


def _emitted(spark, sf_dir):
    cands = X.deduplicate(X.valid(_graded(spark, sf_dir))).withColumn(
        "id", F.concat_ws(".", F.col("doc_id").cast("string"), "id"))
    # the place of a candidate among all documents settles which spelling names a subject
    ready = cands.withColumn("chunk_index", F.col("doc_id"))
    return X.emit_graph(ready, jurisdiction="US Federal", source="doc_id")


@B.query("kg_emit", f"WITH {_EMIT_SQL} SELECT id, type, kind, operand, unit FROM nodes")
def _emit(spark, sf_dir):
    return _emitted(spark, sf_dir)[0].select("id", "type", F.col("obligation_type").alias("kind"), F.col("value").alias("operand"), "unit")


@B.query("kg_emit_edges", f"""WITH {_EMIT_SQL} SELECT 'applies_to' AS type, 'rule.' || lower(rid) AS from_id, sid AS to_id FROM c
  UNION ALL SELECT 'consists_of', 'rule.' || lower(rid), 'ob.' || lower(rid) FROM c
  UNION ALL SELECT 'scoped_to', 'rule.' || lower(rid), 'us.federal' FROM c UNION ALL SELECT 'cited_by', 'rule.' || lower(rid), 'cite.' || lower(rid) FROM c""")
def _emit_edges(spark, sf_dir):
    return _emitted(spark, sf_dir)[1]
