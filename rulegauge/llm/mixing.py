"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulegauge.llm.common import numbered, parts, scalar, stored, word_count
from rulegauge.operators.ordered import dense_index

EXPECTED = "decimal(20,12)"
_OWN = ("_row", "_copies", "copy")


def source_targets(sized: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), factor: int = 3) -> DataFrame:
    """One row per source of ``sized`` (source, size): ``source, source_size, target, place``.

    Sources in code point order, NULL last, take the weights in turn. The sum of all sizes is shared by weight; a
    target stops at ``factor`` times its source's size and the excess is shared again among the rest, until no target
    is above. Each round is one aggregate over the table of sources: the driver sees two numbers a round.
    """
    own = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    own = own.withColumn("_none", F.col("source").isNull())
    placed = dense_index(own, keys=[], order=["_none", "source"], name="place").drop("_none")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = stored(placed.withColumn("weight", turn.cast("decimal(38,0)"))
                    .withColumn("cap", F.col("source_size").cast("decimal(38,0)") * factor), "sources")
    total, shares = scalar(placed.agg(F.sum("source_size"), F.sum("weight")))
    total, shares = int(total or 0), int(shares or 0)
    left, above = total, None
    while True:
        above = F.col("weight") * F.lit(left).cast("decimal(19,0)") > F.col("cap") * F.lit(shares).cast("decimal(19,0)")
        caps, rest = scalar(placed.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))))
        now = total - int(caps or 0), int(rest or 0)
        if now == (left, shares):
            break
        left, shares = now
    target = F.when(above, F.col("cap").cast("double")).otherwise(
        F.lit(left).cast("double") * F.col("weight").cast("double") / F.lit(shares or 1).cast("double"))
    return placed.select("source", "source_size", target.alias("target"), "place")


def boundary_copies(df: DataFrame, *, key: str, order: list[str], expected: str, offset: str) -> DataFrame:
    """Adds ``copies``: integer boundaries that the running sum of ``expected``, from ``offset`` on, crosses in a row.

    Rows of a key are range-partitioned in ``order`` and written once; each piece sums on its own and takes the sum of
    the earlier pieces from a table with one row per key and piece, so no key is held by one task. Sums are decimals:
    they do not depend on how rows are dealt, and reruns agree. ``key`` must not be NULL.
    """
    n = parts(df.sparkSession)
    placed = stored(df.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()), "placed")
    pieces = placed.groupBy(key, "_part").agg(F.sum(expected).cast("decimal(38,12)").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_before", F.coalesce(F.sum(expected).over(inside), F.lit(0)))
    start = (F.col("_base") + F.col("_before") + F.col(offset)).cast("decimal(38,12)")
    return (summed.join(pieces, [key, "_part"]).withColumn("_start", start)
            .withColumn("copies", (F.floor(F.col("_start") + F.col(expected)) - F.floor("_start")).cast("long"))
            .drop("_part", "_before", "_base", "_start"))


def sampled(sized: DataFrame, *, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), factor: int = 3) -> DataFrame:
    """Copies of each row of ``sized`` (doc_id, source, size and any key columns named ``_...``).

    A document is expected target / source size times. Documents of a source stand in order of size, so what one
    document takes too much the next takes less: a source's taken words end within its largest document of the target.
    A source without words takes nothing. Equal rows are interchangeable.
    """
    targets = source_targets(sized, weights=weights, factor=factor)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.col("place").cast("string")), 256), 1, 8), 16, 10)
    targets = stored(targets.select(
        F.col("source").alias("_name"), "source_size", "target", "place", rate.cast(EXPECTED).alias("_expected"),
        (draw.cast("double") / F.lit(2.0 ** 32)).cast(EXPECTED).alias("_offset")), "targets")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    keys = [c for c in sized.columns if c.startswith("_")]
    out = boundary_copies(joined, key="place", order=["size", "doc_id", *keys], expected="_expected", offset="_offset")
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_expected", "_offset", "place")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every document.

    NULL texts have size 0; NULL sources are one source, the last; repeated rows count each on its own; an empty table
    gives no rows. Other columns are not looked at.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return sampled(sized, **how).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture: each document as often as it is drawn, with the number of the ``copy`` (from 1).

    All columns are kept, but ones named ``copy``, ``_row`` or ``_copies`` give way.
    """
    rows = stored(numbered(docs.drop("_row")), "mixed")
    sized = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), "_row")
    drawn = sampled(sized, **how).filter("copies > 0").select("_row", F.col("copies").cast("int").alias("_copies"))
    kept = [F.col(c) for c in docs.columns if c not in _OWN]
    return rows.drop("_copies", "copy").join(stored(drawn, "drawn").hint("merge"), "_row").select(
        *kept, F.explode(F.sequence(F.lit(1), "_copies")).alias("copy"))
