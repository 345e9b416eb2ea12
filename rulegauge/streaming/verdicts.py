"""Verdicts online for rules over history, with late records put in their place.

State holds what the rules look up: the readings of every subject in tiles of time, and its newest record. A record that
follows all known ones is decided from state. A late record is written to the history like any other; it and every
answer that it changes are decided again from the history, and the new answers replace the old ones by version.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulegauge.functions import predicates as P
from rulegauge.functions import values as V
from rulegauge.operators import envelope as E
from rulegauge.operators import history as H
from rulegauge.operators import routing as R
from rulegauge.operators import rules as U
from rulegauge.operators.ordered import previous_row
from rulegauge.streaming.jobs import STATE_STORE, bucketed
from rulegauge.streaming.processors import MICROS, PerKey

SUBJECT = ["tenant_id", "subject"]
FACTS = ("tenant_id string, subject string, measurement_id string, us bigint, jurisdiction string, payload string, "
         "n array<bigint>, readings array<bigint>, total array<double>, peak array<double>, last_us bigint, late boolean")


class Lookups(PerKey):
    """Per record: count, readings, sum and peak of each asked window, and the record before.

    ``asks`` are (place of the path, span in microseconds, closed). ``late`` marks a record not newer than all of earlier
    batches; what it says of itself is not to be used. A subject's state is one value: the newest time, and what windows may still reach.
    """

    held = "newest bigint, us binary, vals binary"

    def __init__(self, asks: list[tuple[int, int, bool]], paths: int, tiles: int = 8):
        super().__init__(SUBJECT)
        self.asks, self.paths = asks, max(1, paths)
        self.span = max([span for _, span, _ in asks], default=MICROS)
        self.width = -(-self.span // tiles)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = initialState if isinstance(initialState, pd.DataFrame) else pd.concat(list(initialState), ignore_index=True)
        if len(rows):
            for name, mine in self.keys_of(rows.sort_values("us", ignore_index=True)):
                found = self.kept.getValue(name)
                self.kept.updateValue(name, self._kept(mine["us"].astype(np.int64), self._readings(mine["vals"]), found and found[0], *self._stored(found)))

    def _readings(self, vals: np.ndarray) -> np.ndarray:
        return np.array([[np.nan if x is None else x for x in v] if len(v) else [np.nan] for v in vals], np.float64)

    def _stored(self, found: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Times and readings held, by tile."""
        us, vals = (b"", b"") if found is None else (bytes(found[1]), bytes(found[2]))
        return np.frombuffer(us, np.int64), np.frombuffer(vals, np.float64).reshape(-1, self.paths)

    def _kept(self, us: np.ndarray, vals: np.ndarray, before: int | None, old_us: np.ndarray, old_vals: np.ndarray) -> tuple:
        newest = int(us.max()) if before is None else max(before, int(us.max()))
        all_us, all_vals = np.concatenate([old_us, us]), np.concatenate([old_vals, vals])
        tile = all_us // self.width
        order = np.argsort(tile, kind="stable")
        order = order[tile[order] >= (newest - self.span) // self.width]
        return newest, all_us[order].tobytes(), all_vals[order].tobytes()

    def answer(self, rows, found):
        us, vals = rows["us"].astype(np.int64), self._readings(rows["vals"])
        held = None if found is None else found[0]
        old_us, old_vals = self._stored(found)
        # the tiles that windows ending in this batch reach
        tile = old_us // self.width
        near = (tile >= (int(us.min()) - self.span) // self.width) & (tile <= int(us.max()) // self.width)
        all_us, all_vals = np.concatenate([us, old_us[near]]), np.concatenate([vals, old_vals[near]])
        order = np.argsort(all_us, kind="stable")
        all_us, all_vals = all_us[order], all_vals[order]
        hi = np.searchsorted(all_us, us, side="right")
        counts, readings, totals, peaks = [], [], [], []
        for path, span, closed in self.asks:
            lo = np.searchsorted(all_us, us - span, side="left" if closed else "right")
            column = all_vals[:, path]
            known = ~np.isnan(column)
            seen = np.concatenate([[0], np.cumsum(known)])
            sums = np.concatenate([[0.0], np.cumsum(np.where(known, column, 0.0))])
            padded = np.append(np.where(known, column, -np.inf), -np.inf)
            # maxima of [lo, hi): every second slice of reduceat; hi > lo, since a window holds its own record
            peak = np.maximum.reduceat(padded, np.stack([lo, hi], axis=1).ravel())[::2]
            counts.append(hi - lo)
            readings.append(seen[hi] - seen[lo])
            totals.append(sums[hi] - sums[lo])
            peaks.append(peak)
        late = np.zeros(len(us), bool) if held is None else us <= held
        before = np.concatenate([[-1 if held is None else held], us[:-1]])
        known = np.concatenate([[held is not None], np.ones(len(us) - 1, bool)])
        first = int(late.sum())
        if held is not None and first < len(us):
            before[first] = held
        told = {name: np.stack(parts, axis=1).tolist() if parts else [[] for _ in us]
                for name, parts in (("n", counts), ("readings", readings), ("total", totals), ("peak", peaks))}
        last = pd.array(before.astype(np.int64), dtype="Int64")
        last[~known | late] = pd.NA
        return {**{c: rows[c] for c in ("measurement_id", "us", "jurisdiction", "payload")}, **told, "last_us": last, "late": late}, self._kept(
            us, vals, held, old_us, old_vals)


class Decider:
    """A rule set online: what it asks of histories, how a batch with answers is decided, how any record is decided again."""

    #: (path, seconds, closed) of every window the rules ask for, each once. One small job over the rule set.
    asks: list[tuple[str, int, bool]]

    def at(self, path: Column, seconds: Column) -> Column:
        """The place (from 1) of a window among the asked ones; NULL where it is not asked."""
        places = [F.struct(F.lit(p).alias("path"), F.lit(s).cast("bigint").alias("seconds")) for p, s, _ in self.asks]
        if not places:
            return F.lit(None).cast("int")
        found = F.array_position(F.array(*places), F.struct(F.coalesce(path, F.lit("")).alias("path"), seconds.cast("bigint").alias("seconds")))
        return F.when(found > 0, found.cast("int"))

    def online(self, batch: DataFrame) -> DataFrame:
        raise NotImplementedError

    def again(self, records: DataFrame, history: DataFrame) -> DataFrame:
        raise NotImplementedError


class OneRule(Decider):
    """Records routed to one rule each (see ``operators.rules``)."""

    def __init__(self, registry: DataFrame, rules: DataFrame):
        self.registry, self.rules = registry, rules
        self.needs = U.history_needs(rules)
        asked = rules.filter(F.col("operator").isin(*P.WINDOW_OPERATORS) & (F.col("seconds") > 0)).select(
            F.coalesce("metric", F.lit("")).alias("path"), "seconds").distinct()
        self.asks = sorted((r.path, int(r.seconds), False) for r in asked.collect())

    def online(self, batch: DataFrame) -> DataFrame:
        routed = R.route(batch, self.registry, self.rules)
        place = self.at(F.col("metric"), F.col("seconds"))
        seen = F.get("readings", place - 1) > 0
        looked = routed.withColumns({
            "_last": F.timestamp_micros("last_us"), "_n": F.get("n", place - 1),
            "_sum": F.when(seen, F.get("total", place - 1)),
            "_avg": F.when(seen, F.get("total", place - 1) / F.get("readings", place - 1))})
        return U.decide(looked, [*SUBJECT, "measurement_id", "ts", "rule_id"])

    def again(self, records: DataFrame, history: DataFrame) -> DataFrame:
        routed = R.route(records, self.registry, self.rules)
        return U.evaluate_as_of(routed, history, id_col="measurement_id", needs=self.needs).select(
            *SUBJECT, "measurement_id", "ts", "rule_id", "verdict", "reasoning")


class AllObligations(Decider):
    """Records judged by every obligation their metrics map to (see ``operators.envelope``)."""

    def __init__(self, rules: DataFrame):
        self.rules = rules
        asked = rules.filter(F.col("operator").isin(*E.DUTY_WINDOWS) & (F.col("seconds") > 0)).select(
            F.coalesce("metric", F.lit("")).alias("path"), "seconds").distinct()
        self.asks = sorted((r.path, int(r.seconds), True) for r in asked.collect())

    def online(self, batch: DataFrame) -> DataFrame:
        pairs = E.pairs_with_gaps(batch, self.rules, ("seconds", "fresh_seconds"))
        place = self.at(F.col("metric"), F.col("seconds"))
        seen = F.get("readings", place - 1) > 0
        met = pairs.withColumns({
            "_last": F.timestamp_micros("last_us"), "_peak": F.when(seen, F.get("peak", place - 1)),
            "_mean": F.when(seen, F.get("total", place - 1) / F.get("readings", place - 1))})
        return E.tally(E.judged(met), "measurement_id", [*SUBJECT, "ts"])

    def again(self, records: DataFrame, history: DataFrame) -> DataFrame:
        return E.verdict_all(records, self.rules, carry=["ts"], history=history)


def _held(records: DataFrame, paths: list[str]) -> DataFrame:
    """What state holds of a record: its time and its readings."""
    readings = [V.number_or_null(V.lookup(F.col("measurement"), F.lit(p))) for p in paths] or [F.lit(None).cast("double")]
    return records.withColumn("us", V.micros(F.col("ts"))).filter("us IS NOT NULL").withColumn("vals", F.array(*readings))


def lookups(records: DataFrame, decider: Decider, initial: DataFrame | None = None) -> DataFrame:
    """Records as a stream with what their rules look up. ``initial``: the history that state starts from."""
    paths = sorted({p for p, _, _ in decider.asks})
    asks = [(paths.index(p), s * MICROS, closed) for p, s, closed in decider.asks]
    rows = _held(records, paths).select(*SUBJECT, "measurement_id", "us", "jurisdiction", F.to_json("measurement").alias("payload"), "vals")
    start = None if initial is None else _held(initial, paths).select(*SUBJECT, "us", "vals")
    start = None if start is None else bucketed(start, SUBJECT)
    return bucketed(rows, SUBJECT).transformWithStateInPandas(
        statefulProcessor=Lookups(asks, len(paths)), outputStructType=FACTS, outputMode="Append", timeMode="None", initialState=start)


def _records(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"ts": F.timestamp_micros("us"), "measurement": F.try_parse_json("payload")})


def affected(past: DataFrame, is_new: Column, reach_us: int) -> DataFrame:
    """Rows of ``past`` (subject, id, ``us``) whose answer late rows can change: the late rows, those whose window reaches
    back to one (by tiles of the longest window: a row touches its own tile and the next), and the row after each."""
    marked = past.withColumn("_new", is_new)
    after = previous_row(marked, keys=SUBJECT, order=["us", "measurement_id"], values=["_new"],
                         tile=F.floor(F.col("us") / F.lit(6 * 3600 * MICROS)).cast("bigint"))
    reached = F.floor(F.col("us") / F.lit(max(1, reach_us))).cast("bigint")
    touched = marked.filter("_new").select(*SUBJECT, F.explode(F.array(reached, reached + 1)).alias("_tile"), F.lit(True).alias("_hit")).distinct()
    found = after.withColumn("_tile", reached).join(touched, [*SUBJECT, "_tile"], "left")
    hit = F.col("_new") | F.coalesce(F.col("prev__new"), F.lit(False))
    return found.filter(hit | F.col("_hit").isNotNull() if reach_us else hit).drop("_new", "prev__new", "_tile", "_hit")


def sink(decider: Decider, out: str, *, history: str, start: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes answers by version under ``out`` and records under ``history``.

    Both go to a folder of the batch's number, so a batch that runs again replaces itself and sees nothing later.
    ``start`` (subject, id, ``us``, ``payload``, ``jurisdiction``) is history from before the stream.
    """
    reach = max([s for _, s, _ in decider.asks], default=0) * MICROS
    columns = [*SUBJECT, "measurement_id", "us", "jurisdiction", "payload"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = f"{history}/batch={number}"
        batch.write.mode("overwrite").parquet(rows)
        seen = spark.read.schema(FACTS).parquet(rows)
        decider.online(_records(seen.filter("NOT late"))).write.mode("overwrite").parquet(f"{out}/batch={number}/part=online")
        late = seen.filter("late")
        if late.isEmpty():
            return
        whose = late.select(*SUBJECT).distinct()
        past = spark.read.option("basePath", history).schema(FACTS + ", batch bigint").parquet(f"{history}/batch=*").filter(F.col("batch") <= number)
        past = past.select(*columns, "late", "batch")
        if start is not None:
            past = past.unionByName(start.select(*columns, F.lit(False).alias("late"), F.lit(-1).cast("bigint").alias("batch")))
        past = past.join(whose, SUBJECT)
        changed = affected(past, F.col("late") & (F.col("batch") == number), reach)
        decider.again(_records(changed), _records(past)).write.mode("overwrite").parquet(f"{out}/batch={number}/part=again")
    return write


def run(records: DataFrame, decider: Decider, out: str, *, history: str, state: str, initial: DataFrame | None = None) -> None:
    """Take the stream as far as its input goes; ``state`` carries over to the next call. ``initial`` (records) belongs to
    the first call: the stream starts from it, and it is history for late records in every call that names it."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    start = None if initial is None else _held(initial, []).withColumn("payload", F.to_json("measurement"))
    query = (lookups(records, decider, initial).writeStream.outputMode("append").option("checkpointLocation", state)
             .foreachBatch(sink(decider, out, history=history, start=start)).trigger(availableNow=True).start())
    query.awaitTermination()


def versions(spark: SparkSession, out: str) -> DataFrame:
    """All answers with ``version``: of a batch's two, the one that was decided again counts."""
    rows = spark.read.option("basePath", out).option("mergeSchema", "true").parquet(f"{out}/batch=*/part=*")
    return rows.withColumn("version", F.col("batch") * 2 + (F.col("part") == "again").cast("int")).drop("batch", "part")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest answer of every record."""
    rows = versions(spark, out)
    keys = [*SUBJECT, "measurement_id"]
    values = [c for c in rows.columns if c not in (*keys, "version")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v"), F.max("version").alias("version")).select(*keys, "v.*", "version")


def retractions(spark: SparkSession, out: str) -> DataFrame:
    """Answers that were replaced by another verdict: ``retracted``, ``verdict``, ``version``."""
    rows = versions(spark, out)
    linked = previous_row(rows, keys=[*SUBJECT, "measurement_id"], order=["version"], tile=F.lit(0), values=["verdict"])
    return linked.filter("prev_verdict <> verdict").select(
        *SUBJECT, "measurement_id", F.col("prev_verdict").alias("retracted"), "verdict", "version")
