"""Predicates over a subject's own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegauge.functions import values as V
from rulegauge.operators.ordered import as_of, previous_row, trailing

SUBJECT = ["tenant_id", "subject"]
STATS = ["count", "sum_value", "avg_value", "min_value", "max_value", "oldest_ts", "newest_ts"]


def window_stats(probe: DataFrame, history: DataFrame | None = None, *, seconds: int | str, path: str | None = None,
                 value: str | None = None, bounds: str = "(]", keys: list[str] | None = None,
                 id_col: str = "measurement_id", tiles: int = 8) -> DataFrame:
    """Count, sum, mean, extremes and time bounds of a subject's records in the window ending at each probe row.

    ``seconds`` is one length or the name of a probe column holding one length per row. The aggregated number
    is the DOUBLE column ``value``, or what a dotted ``path`` finds in ``measurement``; text, booleans, nulls
    and objects there count as records but not as numbers. ``bounds`` is ``(]`` or ``[]``. A probe row without
    time or with a NULL length gets no result row. Results carry ``keys``: subjects may share ids.
    """
    keys = list(keys or SUBJECT)
    if bounds not in ("(]", "[]"):
        raise ValueError(f"bounds must be '(]' or '[]', got {bounds!r}")
    if isinstance(seconds, int) and seconds <= 0:
        raise ValueError(f"seconds must be positive, got {seconds}")

    def number():
        if value is not None:
            return F.col(value).cast("double")
        if path is not None:
            return V.number_or_null(V.lookup(F.col("measurement"), F.lit(path)))
        return F.lit(None).cast("double")

    length = F.lit(seconds) if isinstance(seconds, int) else F.col(seconds)
    span = (length.cast("bigint") * V.MICROS).alias("_span")
    left = probe.select(*keys, id_col, V.micros(F.col("ts")).alias("_us"), span,
                        (number() if history is None else F.lit(None).cast("double")).alias("val"))
    left = left.filter("_us IS NOT NULL AND _span > 0")
    right = None
    if history is not None:
        right = history.select(*keys, V.micros(F.col("ts")).alias("_us"), number().alias("val")) \
            .filter("_us IS NOT NULL")
        right = right.withColumn("_span", span) if isinstance(seconds, int) else right.join(
            left.select(*keys, "_span").distinct(), keys)
    elif not isinstance(seconds, int):
        # each length needs the subject's whole history, not only the rows that ask for that length
        whole = left.select(*keys, "_us", "val")
        right = whole.join(left.select(*keys, "_span").distinct(), keys)
    got = trailing(left, right, keys=keys, pos="_us", span="_span", id_col=id_col, values=["val"],
                   closed=bounds == "[]", tiles=tiles)
    return _named_stats(got, keys, id_col)


def _named_stats(got: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    return got.select(
        *keys, id_col, F.col("n").alias("count"), F.col("val_sum").alias("sum_value"),
        (F.col("val_sum") / F.col("val_n")).alias("avg_value"), F.col("val_min").alias("min_value"),
        F.col("val_max").alias("max_value"), F.timestamp_micros("first_pos").alias("oldest_ts"),
        F.timestamp_micros("last_pos").alias("newest_ts"))


def rule_window_stats(probe: DataFrame, history: DataFrame, *, id_col: str = "measurement_id",
                      keys: list[str] | None = None, closed: bool = False, tiles: int = 8) -> DataFrame:
    """As :func:`window_stats` with length and path taken per row from the columns ``seconds`` and ``metric``.

    The history is repeated once per distinct (length, path) that its subject's rows ask for.
    """
    keys = list(keys or SUBJECT)
    asks = probe.filter("seconds > 0 AND ts IS NOT NULL").withColumn(
        "_span", F.col("seconds").cast("bigint") * V.MICROS).withColumn("_path", F.coalesce("metric", F.lit("")))
    wanted = asks.select(*keys, "_span", "_path").distinct()
    number = F.when(F.col("_path") != "", V.number_or_null(V.lookup(F.col("measurement"), F.col("_path"))))
    right = (history.select(*keys, V.micros(F.col("ts")).alias("_us"), "measurement").filter("_us IS NOT NULL")
             .join(wanted, keys).withColumn("val", number).drop("measurement"))
    left = asks.select(*keys, "_span", "_path", id_col, V.micros(F.col("ts")).alias("_us"))
    got = trailing(left, right, keys=[*keys, "_path"], pos="_us", span="_span", id_col=id_col, values=["val"],
                   closed=closed, tiles=tiles)
    return _named_stats(got, keys, id_col)


def last_seen(probe: DataFrame, history: DataFrame | None = None, *, keys: list[str] | None = None,
              id_col: str = "measurement_id", tile_seconds: int = 6 * 3600) -> DataFrame:
    """Adds ``last_ts``: the subject's latest record at or before each probe row.

    With ``history=None`` the probe is its own history and the answer is the record before, never the row
    itself. Rows without a time get NULL.
    """
    keys = list(keys or SUBJECT)
    width = tile_seconds * V.MICROS
    left = probe.withColumn("_us", V.micros(F.col("ts")))
    if history is None:
        # rows without a time are kept apart and spread by id; they are nobody's predecessor
        apart = left.withColumn("_timed", F.col("_us").isNotNull())
        tile = F.when(F.col("_timed"), F.floor(F.col("_us") / F.lit(width)).cast("bigint")).otherwise(
            F.pmod(F.xxhash64(id_col), F.lit(1024)))
        found = previous_row(apart, keys=[*keys, "_timed"], order=["_us", id_col], tile=tile, values=["_us"])
        return found.withColumn("last_ts", F.when(F.col("_timed"), F.timestamp_micros("prev__us"))).drop(
            "_us", "_timed", "prev__us")
    right = history.select(*keys, V.micros(F.col("ts")).alias("_us")).filter("_us IS NOT NULL")
    found = as_of(left.filter("_us IS NOT NULL"), right, keys=keys, pos="_us", id_col=id_col, tile_width=width)
    out = found.withColumn("last_ts", F.timestamp_micros("seen_pos")).drop("_us", "seen_pos")
    untimed = left.filter("_us IS NULL").drop("_us").withColumn("last_ts", F.lit(None).cast("timestamp"))
    return out.unionByName(untimed)


def elapsed_seconds(ts: Column, last_ts: Column) -> Column:
    return (V.micros(ts) - V.micros(last_ts)) / F.lit(float(V.MICROS))


def fresh(ts: Column, last_ts: Column, within: Column) -> Column:
    return F.coalesce(elapsed_seconds(ts, last_ts) <= within, F.lit(False))
