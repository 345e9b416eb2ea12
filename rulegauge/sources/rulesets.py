"""Rule sets and rule graphs from JSON documents (one document per row or file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.functions import values as V
from rulegauge.session import literal_frame

RULE_FIELDS = {
    "rule_id": "string", "ord": "int", "operator": "string", "metric": "string", "value": "string",
    "low": "double", "high": "double", "unit": "string", "cmp_op": "string", "seconds": "bigint",
    "value_seconds": "double", "fresh_seconds": "bigint", "jurisdiction": "string", "effective_date": "string",
    "sunset_date": "string", "risk_tier": "string", "version": "string",
}
# bounds in microseconds of a rule without a first or last date
OPEN_FROM, OPEN_TO = -(2**62), 2**62
NODE_KINDS = {
    "subjects": "Subject", "rules": "Rule", "obligations": "Obligation", "definitions": "Definition",
    "exemptions": "Exemption", "precedents": "Precedent", "jurisdictions": "Jurisdiction",
    "citations": "Citation",
}


def rules_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small rule set from literal rows; missing fields are NULL, ``value``/``jurisdiction`` are JSON text."""
    schema = ", ".join(f"{n} {t}" for n, t in RULE_FIELDS.items())
    data = [tuple(row.get(n, i + 1 if n == "ord" else None) for n in RULE_FIELDS) for i, row in enumerate(rows)]
    return prepare_rules(literal_frame(spark, data, schema))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Work out on the small side what every record would otherwise repeat: operands, places, dates."""
    value = F.try_parse_json("value")
    ready = rules.withColumn("_v", value).withColumn("_j", F.try_parse_json("jurisdiction"))
    places = F.transform(F.try_variant_get("_j", F.lit("$"), "array<variant>"),
                         lambda x: F.when(V.kind(x) == "string", F.lower(V.strip(V.as_text(x)))))
    named = (F.when(F.col("_j").isNull() | F.is_variant_null("_j"), F.array(F.lit("*")))
             .when(V.kind(F.col("_j")) == "string", F.array(F.lower(V.strip(V.as_text(F.col("_j"))))))
             .otherwise(F.coalesce(places, F.array().cast("array<string>"))))
    # Places that mean "everywhere".
    everywhere = F.exists(named, lambda x: x.isin("global", "*", ""))
    tokens = F.when(everywhere, F.array(F.lit("*"))).otherwise(
        F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    return (ready
            .withColumn("tokens", tokens)
            .withColumn("from_us", F.coalesce(V.micros(V.parse_iso(F.col("effective_date"))),
                                              F.lit(OPEN_FROM).cast("bigint")))
            .withColumn("to_us", F.coalesce(V.micros(V.parse_iso(F.col("sunset_date"))),
                                            F.lit(OPEN_TO).cast("bigint")))
            .withColumn("tier", P.tier_rank(F.col("risk_tier")))
            .withColumn("operand", P.rule_operand(F.col("_v"), F.col("low"), F.col("high")))
            .withColumn("value_seconds_text", V.float_text(F.col("value_seconds")))
            .withColumn("duty", P.obligation_operand(F.col("_v")))
            .withColumn("value_json", F.to_json("_v"))
            .drop("_v", "_j", "value").withColumnRenamed("jurisdiction", "rule_jurisdiction"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: ``source``, ``text``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def flat_rules(documents: DataFrame) -> DataFrame:
    """Rules of flat documents (``rules``, ``tag_registry``, ``metadata``), in document order."""
    doc = documents.withColumn("doc", F.try_parse_json("text"))
    items = doc.select(
        "source", F.try_variant_get("doc", F.lit("$.metadata.version"), "string").alias("version"),
        F.posexplode(F.try_variant_get("doc", F.lit("$.rules"), "array<variant>")).alias("pos", "rule"))

    def get(path, kind="string"):
        return F.try_variant_get("rule", F.lit(path), kind)

    nested = get("$.predicate", "variant")
    is_nested = V.kind(nested) == "object"

    def field(name, kind="string"):
        return F.when(is_nested, get(f"$.predicate.{name}", kind)).otherwise(get(f"$.{name}", kind))

    return items.select(
        "source", get("$.id").alias("rule_id"), (F.col("pos") + 1).cast("int").alias("ord"),
        F.when(is_nested, get("$.predicate.operator")).otherwise(V.as_text(nested)).alias("operator"),
        field("metric").alias("metric"), F.to_json(field("value", "variant")).alias("value"),
        field("min", "double").alias("low"), field("max", "double").alias("high"), field("unit").alias("unit"),
        field("op").alias("cmp_op"), field("seconds", "bigint").alias("seconds"),
        field("value_seconds", "double").alias("value_seconds"),
        field("requires_recent_within_seconds", "bigint").alias("fresh_seconds"),
        F.to_json(get("$.jurisdiction", "variant")).alias("jurisdiction"),
        get("$.effective_date").alias("effective_date"), get("$.sunset_date").alias("sunset_date"),
        get("$.risk_tier").alias("risk_tier"), F.coalesce("version", F.lit("unknown")).alias("version"))


def flat_registry(documents: DataFrame) -> DataFrame:
    """subject → rule_id entries; ``ord`` is the entry's place, the last spelling of a subject wins."""
    # a VARIANT sorts its keys; the text keeps the order of the document
    tags = documents.select("source", F.from_json(F.get_json_object("text", "$.tag_registry"), "map<string,string>").alias("m"))
    return tags.select("source", F.posexplode("m").alias("ord", "subject", "rule_id"))


def empty_documents(documents: DataFrame) -> DataFrame:
    """Documents to refuse: unreadable, or without a non-empty ``rules`` array."""
    rules = F.try_variant_get(F.try_parse_json("text"), F.lit("$.rules"), "array<variant>")
    return documents.filter(F.coalesce(F.size(rules), F.lit(0)) <= 0).select("source")


def graph_nodes(documents: DataFrame) -> DataFrame:
    """All nodes of graph documents, one row per array element."""
    doc = documents.select("source", F.try_parse_json("text").alias("doc"))
    arrays = F.array(*[
        F.struct(F.lit(kind).alias("kind"),
                 F.try_variant_get("doc", F.lit(f"$.nodes.{name}"), "array<variant>").alias("items"))
        for name, kind in NODE_KINDS.items()])
    items = (doc.select("source", F.explode(arrays).alias("a"))
             .select("source", "a.kind", F.posexplode("a.items").alias("pos", "node")))

    def get(path, kind="string"):
        return F.try_variant_get("node", F.lit(path), kind)

    return items.select(
        "source", F.col("kind").alias("type"), "pos", get("$.id").alias("id"), get("$.version").alias("version"),
        get("$.name").alias("name"), get("$.obligation_type").alias("obligation_type"),
        get("$.metric").alias("metric"), F.to_json(get("$.value", "variant")).alias("value"),
        get("$.unit").alias("unit"), get("$.effective_date_start").alias("effective_date_start"),
        get("$.effective_date_end").alias("effective_date_end"), get("$.risk_tier").alias("risk_tier"),
        get("$.parent").alias("parent"), F.to_json("node").alias("body"))


def graph_edges(documents: DataFrame) -> DataFrame:
    doc = documents.select("source", F.try_parse_json("text").alias("doc"))
    edges = doc.select("source", F.explode(F.try_variant_get("doc", F.lit("$.edges"), "array<variant>")).alias("e"))
    return edges.select(
        "source", F.try_variant_get("e", F.lit("$.type"), "string").alias("type"),
        F.coalesce(F.try_variant_get("e", F.lit("$.from"), "string"),
                   F.try_variant_get("e", F.lit("$.from_id"), "string")).alias("from_id"),
        F.coalesce(F.try_variant_get("e", F.lit("$.to"), "string"),
                   F.try_variant_get("e", F.lit("$.to_id"), "string")).alias("to_id"))
