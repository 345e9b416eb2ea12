"""Ordered operators that do not put all rows of one key into one task.

Every helper cuts the rows of a key into tiles along the order (time or position), works inside the
tiles in parallel, and carries between tiles by one row per tile. ``trailing`` sends tile totals to
the few tiles whose windows reach them; ``previous_row`` and ``as_of`` carry the last row over empty tiles by a window over that
small table, so a key has as many rows in one task as it has tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegauge.session import materialize


def previous_row(df: DataFrame, *, keys: list[str], order: list[str], tile: Column, values: list[str],
                 prefix: str = "prev_") -> DataFrame:
    """``values`` of the row before, per ``keys`` in ``order``; NULL for the first row.

    ``tile`` must grow with ``order``. Rows meet their predecessor inside the tile by ``lag``; the first
    row of a tile gets the last row of the nearest earlier non-empty tile from a one-row-per-tile table.
    """
    tiled = df.withColumn("_tile", tile)
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order)
    carried = F.struct(*[F.col(v).alias(v) for v in values])
    marked = tiled.withColumn("_before", F.lag(carried).over(inside))
    # a maximum per tile combines before it is shuffled; only tiles meet, not their rows
    tails = (tiled.groupBy(*keys, "_tile").agg(F.max_by(carried, F.struct(*order)).alias("_tail"))
             .withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_tile")))
             .filter(F.col("_tail").isNotNull()))
    joined = marked.join(tails, [*keys, "_tile"], "left")
    picked = F.coalesce(F.col("_before"), F.col("_tail"))
    return joined.select(*df.columns, *[picked[v].alias(prefix + v) for v in values])


def dense_index(df: DataFrame, *, keys: list[str], order: list[str], name: str, partitions: int | None = None,
                ) -> DataFrame:
    """1, 2, 3 … per ``keys`` in ``order``, balanced whatever the sizes of the keys.

    Rows are range-partitioned on (keys, order), sorted and written once, so that their places are fixed
    even if executors are lost. A table with one row per (partition, key) then gives each run its offset.
    The bounds of the ranges cost a pass of their own over ``df``: write it first if it is dear to compute.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(
        df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()), "ordered")
    runs = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that its size is known: a small one meets the rows without shuffling them
    runs = materialize(runs.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"), "runs")
    return (placed.join(runs, [*keys, "_part"])
            .withColumn(name, F.col("_offset") + F.col("_place") - F.col("_first") + 1)
            .select(*df.columns, name))


def trailing(probe: DataFrame, history: DataFrame | None, *, keys: list[str], pos: str, span: str, id_col: str,
             values: list[str] | None = None, closed: bool = False, tiles: int = 8) -> DataFrame:
    """Aggregate ``history`` over ``(p - span, p]`` for each probe row at position ``p``.

    ``closed`` takes ``[p - span, p]``. ``history=None`` means that the probe rows are their own history.
    ``span`` is a positive BIGINT column present on both sides; it belongs to the key. ``values`` are DOUBLE
    columns of the history. Returns one row per ``keys`` and ``id_col``: ``n``, ``first_pos``, ``last_pos`` and for
    each value ``<v>_n``, ``<v>_sum``, ``<v>_min``, ``<v>_max``. Keys may share an id; a probe row that is there twice
    has one answer.

    A span is covered by ``tiles`` tiles. Each window is a suffix of one tile, whole tiles, and a prefix of
    another: two running aggregates and one small per-tile table, so the work is linear in the rows and does
    not grow with the number of rows in a window.
    """
    values = values or []
    if id_col in keys:
        raise ValueError("the id column cannot be a key")
    tile_keys = [*keys, span]
    # span / width lies in (tiles - 1, tiles]; spans too short to divide that way are one tile long
    width = F.when(F.col(span) < tiles * (tiles - 1), F.col(span)).otherwise(
        F.ceil(F.col(span) / F.lit(tiles))).cast("bigint")
    at = F.floor(F.col("_pos") / F.col("_width")).cast("bigint")

    def events(frame, shift, is_probe, is_history):
        cols = [F.col(k) for k in tile_keys] + [width.alias("_width"), (F.col(pos) - shift).alias("_pos")]
        cols.append((F.col(id_col) if is_probe else F.lit(None).cast(probe.schema[id_col].dataType)).alias("_id"))
        cols.append(F.lit(is_history).alias("_has"))
        for v in values:
            cols.append((F.col(v) if is_history else F.lit(None)).cast("double").alias(v))
        cols.append(F.col(pos).alias("_at"))
        return frame.select(*cols).withColumn("_tile", at)

    ends = events(probe, F.lit(0), True, history is None)
    if history is not None:
        ends = ends.unionByName(events(history, F.lit(0), False, True))
    starts = events(probe, F.col(span), True, False)
    rows = ends.withColumn("_start", F.lit(False)).unionByName(starts.withColumn("_start", F.lit(True)))

    in_tile = Window.partitionBy(*tile_keys, "_tile")
    up_to = in_tile.orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = in_tile.orderBy(F.col("_pos").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow if closed else -1)

    def measures(prefix=""):
        has_pos = F.when(F.col("_has"), F.col("_pos"))
        out = [("n", F.count(F.when(F.col("_has"), 1))), ("first_pos", F.min(has_pos)), ("last_pos", F.max(has_pos))]
        for v in values:
            out += [(f"{v}_n", F.count(v)), (f"{v}_sum", F.sum(v)), (f"{v}_min", F.min(v)), (f"{v}_max", F.max(v))]
        return [(prefix + name, expr) for name, expr in out]

    names = [name for name, _ in measures()]
    both = rows.select("*", *[expr.over(up_to).alias("_up_" + name) for name, expr in measures()],
                       *[expr.over(after).alias("_dn_" + name) for name, expr in measures()])
    edge = [F.when(F.col("_start"), F.col("_dn_" + n)).otherwise(F.col("_up_" + n)).alias(n) for n in names]
    edges = both.filter(F.col("_id").isNotNull()).select(
        *tile_keys, "_id", "_start", "_tile", "_at", "_width", *edge)

    def fold(name, column=None):
        column = F.col(name) if column is None else column
        if name == "n" or name.endswith("_n") or name.endswith("_sum"):
            return F.sum(column)
        return F.min(column) if name == "first_pos" or name.endswith("_min") else F.max(column)

    if tiles > 1:
        # whole tiles strictly between the two edges: each tile sends its totals to the few tiles whose windows reach it
        totals = ends.groupBy(*tile_keys, "_width", "_tile").agg(*[e.alias(n) for n, e in measures()])
        sent = (totals.filter("n > 0").withColumn("_ahead", F.explode(F.sequence(F.lit(1), F.lit(tiles - 1))))
                .withColumn("_tile", F.col("_tile") + F.col("_ahead")))
        near = F.col("_ahead") <= tiles - 2
        between = sent.groupBy(*tile_keys, "_tile").agg(
            *[fold(n).alias("_w_" + n) for n in names], *[fold(n, F.when(near, F.col(n))).alias("_s_" + n) for n in names])
        first_tile = F.floor((F.col("_at") - F.col(span)) / F.col("_width")).cast("bigint")
        joined = edges.join(between, [*tile_keys, "_tile"], "left")
        reach = F.col("_tile") - first_tile
        middle = {n: F.when(~F.col("_start") & (reach == tiles), F.col("_w_" + n))
                  .when(~F.col("_start") & (reach == tiles - 1), F.col("_s_" + n)) for n in names}

        def with_middle(n):
            if n == "first_pos" or n.endswith("_min"):
                return F.least(F.col(n), middle[n])
            if n == "last_pos" or n.endswith("_max"):
                return F.greatest(F.col(n), middle[n])
            if n.endswith("_sum"):
                return F.when(F.col(n).isNull() & middle[n].isNull(), F.lit(None)).otherwise(
                    F.coalesce(F.col(n), F.lit(0.0)) + F.coalesce(middle[n], F.lit(0.0)))
            return F.col(n) + F.coalesce(middle[n], F.lit(0))
        edges = joined.select(*keys, "_id", "_start", *[with_middle(n).alias(n) for n in names])

    def both_edges(name):
        head, tail = F.max(F.when(F.col("_start"), F.col(name))), F.max(F.when(~F.col("_start"), F.col(name)))
        if name == "n" or name.endswith("_n"):
            return F.coalesce(head, F.lit(0)) + F.coalesce(tail, F.lit(0))
        if name.endswith("_sum"):
            return F.when(head.isNotNull() | tail.isNotNull(), F.coalesce(head, F.lit(0.0)) + F.coalesce(tail, F.lit(0.0)))
        return fold(name)
    return edges.groupBy(*keys, F.col("_id").alias(id_col)).agg(*[both_edges(n).alias(n) for n in names])


def as_of(probe: DataFrame, history: DataFrame | None, *, keys: list[str], pos: str, id_col: str,
          tile_width: int, values: list[str] | None = None) -> DataFrame:
    """Adds ``seen_pos`` (and ``seen_<v>``): the latest history row at or before each probe row.

    With ``history=None`` the probe rows are their own history and a row never finds itself: it gets the row
    before it in (position, id) order.
    """
    values = values or []
    tile = F.floor(F.col(pos) / F.lit(tile_width)).cast("bigint")
    if history is None:
        found = previous_row(probe, keys=keys, order=[pos, id_col], tile=tile, values=[pos, *values], prefix="_seen_")
        return found.withColumnsRenamed({f"_seen_{pos}": "seen_pos", **{f"_seen_{v}": f"seen_{v}" for v in values}})
    carried = F.struct(F.col(pos).alias("seen_pos"), *[F.col(v).alias(f"seen_{v}") for v in values])
    left = probe.select(*keys, F.col(pos).alias("_pos"), F.struct(*probe.columns).alias("_row"),
                        F.lit(1).alias("_kind"), F.lit(None).cast(history.select(carried).schema[0].dataType)
                        .alias("_hit"))
    right = history.select(*keys, F.col(pos).alias("_pos"),
                           F.lit(None).cast(left.schema["_row"].dataType).alias("_row"),
                           F.lit(0).alias("_kind"), carried.alias("_hit"))
    both = left.unionByName(right).withColumn("_tile", F.floor(F.col("_pos") / F.lit(tile_width)).cast("bigint"))
    inside = Window.partitionBy(*keys, "_tile").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = (both.withColumn("_near", F.last("_hit", ignorenulls=True).over(inside)))
    # the last hit of a tile comes from the history alone; of the probe rows only their tiles are needed
    last = both.filter("_kind = 0").groupBy(*keys, "_tile").agg(F.max_by("_hit", "_pos").alias("_tail"))
    asked = both.filter("_kind = 1").select(*keys, "_tile").distinct()
    tails = last.unionByName(asked.withColumn("_tail", F.lit(None).cast(last.schema["_tail"].dataType))).groupBy(*keys, "_tile").agg(
        F.any_value("_tail", True).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.withColumn("_tail", F.last("_tail", ignorenulls=True).over(earlier)).filter("_tail IS NOT NULL")
    picked = F.coalesce(F.col("_near"), F.col("_tail"))
    return (marked.filter("_kind = 1").join(tails, [*keys, "_tile"], "left")
            .select("_row.*", picked["seen_pos"].alias("seen_pos"), *[picked[f"seen_{v}"].alias(f"seen_{v}") for v in values]))


def attached(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row per ``on``; NULL keys meet NULL keys."""
    renamed = right.withColumnsRenamed({c: "_on_" + c for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col("_on_" + c))
    return left.join(renamed, same, "left").drop(*["_on_" + c for c in on])
