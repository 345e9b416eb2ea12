"""Repeated windows of tokens over a whole corpus, without a row per token.

Every window of ``width`` tokens has an anchor: of the runs of ``gram`` tokens inside it, the one with the smallest
hash. The anchor depends on the window's content only, so equal windows have equal anchors. Consecutive windows with
one anchor form a stretch, and only stretches whose anchor occurs twice can hold repeated windows. Nothing is lost by
looking at anchors alone, and there is one per some dozens of tokens.

1. Anchors per document are counted over the corpus; those that occur once are dropped.
2. Stretches with the same content are one class. A class with several members is repeated as a whole.
3. Classes that share an anchor but not all content are compared window by window, as suffixes with that anchor's prefix:
   in one task while their number is below a limit, else by an aggregate over longer prefixes, the whole windows.

Counts and smallest ids are aggregates with map-side combining; what they find meets the rows again by joins whose crowded
keys Spark can split. Hashes of anchors, words and windows have 64 bits, those of classes 128.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegauge.llm.common import batches, drop_stored, numbered, parts, stored, texts_of

_STEP = 0x9E3779B97F4A7C15
_LOW, _HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
#: Counts as the id of a document without one: such a document is never the earlier one.
NO_ID = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))


def _powers(n: int, kept={}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006 - grown once per worker
    """Powers of the step and of its inverse modulo 2^64."""
    if n > len(kept.get("up", ())):
        n = max(1 << 16, 1 << n.bit_length())
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            kept[name] = np.cumprod(factors)
    return kept["up"], kept["down"]


class Sums:
    """Hashes of all runs of tokens: differences of a running sum, brought to a common place."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * up[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, length) -> np.ndarray:
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def byte_units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def word_units(text: bytes) -> np.ndarray:
    """A 64-bit hash per word."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[raw], [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return Sums(_BYTE[raw]).at(starts, ends - starts) if len(starts) else np.array([], np.uint64)


def tokens_of(units: np.ndarray) -> np.ndarray:
    return _BYTE[units] if units.dtype == np.uint8 else units


def stretches(units: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, window after the last) of each stretch of windows with one anchor."""
    if len(units) < width:
        none = np.array([], np.int64)
        return none.view(np.uint64), none, none
    hashes = Sums(tokens_of(units)).all(gram)
    least = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    size, most = 1, width - gram + 1
    while size * 2 <= most:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if most > size:
        least = np.minimum(least[:size - most], least[most - size:])
    place = (least & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return hashes[place[first]], first, np.concatenate([first[1:], [len(place)]])


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1]) if len(values) else np.array([], np.int64)
    return starts, np.append(starts[1:], len(values)).astype(np.int64)


Compare = Callable[[list[np.ndarray], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def repeated_spans(docs: DataFrame, *, units: Callable[[bytes], np.ndarray], width: int, gram: int, earlier: bool,
                   compare: Compare, limit: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(documents with ``_row``; per row its repeated windows as ``spans``: array of (from, to), ends not included).

    A window counts as repeated if it occurs anywhere else, or, with ``earlier``, if it also starts in a document with
    a smaller doc_id. ``compare`` looks at the classes of one or more anchors in a task.
    """
    spark = docs.sparkSession
    rows = stored(numbered(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"), "doc_id", "text")), "texts")

    def count_anchors(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in batches([batch], 8 << 20):
                found, uses, sizes = [], [], []
                for text in texts_of(part.column("text")):
                    anchors, n = np.unique(stretches(units(text), width, gram)[0], return_counts=True)
                    found.append(anchors)
                    uses.append(n)
                    sizes.append(len(anchors))
                yield pa.record_batch([
                    pa.array(np.concatenate(found).view(np.int64)), pa.array(np.repeat(part.column("_row").to_numpy(), sizes)),
                    pa.array(np.repeat(part.column("_doc").to_numpy(), sizes)), pa.array(np.concatenate(uses).astype(np.int32))],
                    names=["anchor", "_row", "_doc", "uses"])
    anchors = stored(rows.select("_row", "_doc", "text").mapInArrow(
        count_anchors, "anchor bigint, _row bigint, _doc bigint, uses int"), "anchors")
    often = F.min("_doc") < F.max("_doc") if earlier else F.sum("uses") > 1
    shared = stored(anchors.groupBy("anchor").agg(often.alias("often")).filter("often").select("anchor"), "shared")
    wanted = stored(anchors.join(shared, "anchor").groupBy("_row").agg(F.collect_list("anchor").alias("anchors")), "wanted")
    drop_stored(anchors, shared)

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in batches([batch], 8 << 20):
                columns: list[list] = [[] for _ in range(7)]
                for text, row, doc, hits in zip(texts_of(part.column("text")), part.column("_row").to_pylist(), part.column("_doc").to_pylist(),
                                                part.column("anchors")):
                    unit = units(text)
                    anchor, first, after = stretches(unit, width, gram)
                    held = np.isin(anchor, hits.values.to_numpy(zero_copy_only=False).view(np.uint64))
                    first, after = first[held], after[held]
                    data, size = memoryview(unit).cast("B"), unit.itemsize
                    bounds = zip((first * size).tolist(), ((after - 1 + width) * size).tolist())
                    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in bounds]), np.int64)
                    for column, value in zip(columns, (anchor[held].view(np.int64), digests[::2], digests[1::2],
                                                       np.full(len(first), row), np.full(len(first), doc), first, after)):
                        column.append(value)
                yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=_STRETCH)
    _STRETCH = ["anchor", "c1", "c2", "_row", "_doc", "first", "after"]
    schema = ", ".join(f"{c} bigint" for c in _STRETCH)
    found = stored(rows.select("_row", "_doc", "text").join(wanted, "_row").mapInArrow(cut, schema), "stretches")
    key = ["anchor", "c1", "c2"]
    kinds = stored(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("_doc").alias("least"),
                                           F.min(F.struct("_row", "first", "after")).alias("one")), "classes")
    crowds = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "crowds")
    mixed = kinds.join(crowds, "anchor")
    # what is known without looking: lone classes, and with ``earlier`` off all classes of several members
    lone = kinds.join(crowds, "anchor", "left_anti")
    whole = lone if earlier else lone.filter("n > 1").unionByName(mixed.filter("n > 1").drop("kinds"))
    size = F.col("one.after") - F.col("one.first")
    whole = whole.select(*key, F.lit(0).cast("long").alias("low"), size.alias("high"), "least")
    asked = stored(mixed.groupBy(F.col("one._row").alias("_row")).agg(F.collect_list(F.struct(
        *key, "n", "least", "kinds", F.col("one.first").alias("first"), F.col("one.after").alias("after"))).alias("asked")), "asked")
    content = stored(_contents(rows.join(asked, "_row").select("text", F.col("asked")), units, width), "contents")
    few = content.filter(F.col("kinds") <= limit).repartition(parts(spark), "anchor").sortWithinPartitions("anchor")
    answers = few.select(*key, "n", "least", "content").mapInArrow(
        _compared(compare, width, units(b"a").dtype), "anchor bigint, c1 bigint, c2 bigint, low bigint, high bigint, least bigint")
    many = _by_window(content.filter(F.col("kinds") > limit), width, units(b"a").dtype, earlier)
    spans = stored(whole.unionByName(answers).unionByName(many), "repeats")
    met = found.join(spans, key)
    if earlier:
        met = met.filter(F.col("_doc") > F.col("least"))
    spanned = stored(met.groupBy("_row").agg(F.collect_list(F.struct(
        (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))).alias("spans")), "spans")
    drop_stored(found, kinds, crowds, asked, content, spans, wanted)
    return rows, spanned


def _contents(rows: DataFrame, units, width: int) -> DataFrame:
    """The tokens of one member of each class that is asked for."""
    def take(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in batches([batch], 8 << 20):
                out, content = [], []
                for text, asked in zip(texts_of(part.column(0)), part.column(1).to_pylist()):
                    unit = units(text)
                    for x in asked:
                        out.append((x["anchor"], x["c1"], x["c2"], x["n"], x["least"], x["kinds"]))
                        content.append(unit[x["first"]:x["after"] - 1 + width].tobytes())
                columns = zip(*out) if out else [[]] * 6
                yield pa.record_batch([*[pa.array(c, pa.int64()) for c in columns], pa.array(content, pa.binary())],
                                      names=["anchor", "c1", "c2", "n", "least", "kinds", "content"])
    return rows.mapInArrow(take, "anchor bigint, c1 bigint, c2 bigint, n bigint, least bigint, kinds bigint, content binary")


def _compared(compare: Compare, width: int, kind: np.dtype, chunk: int = 4 << 20):
    """Classes of an anchor stand together; whole anchors are taken until they fill a chunk."""
    names = ["anchor", "c1", "c2", "low", "high", "least"]

    def work(held: list[tuple]) -> pa.RecordBatch:
        units = [np.frombuffer(x[5], kind) for x in held]
        group = np.array([x[0] for x in held], np.int64)
        n, least = (np.array([x[i] for x in held], np.int64) for i in (3, 4))
        counts = np.array([len(u) - width + 1 for u in units], np.int64)
        hit, smallest = compare(units, group, least)
        ends = np.cumsum(counts)
        out = []
        for i, (start, end) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
            own = np.where(hit[start:end], smallest[start:end], -1) if hit is not None else smallest[start:end]
            for a, b in zip(*(x.tolist() for x in runs(own))):
                if hit is None or hit[start + a]:
                    out.append((*held[i][:3], a, b, int(own[a])))
        columns = zip(*out) if out else [[]] * 6
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in source:
            for part in batches([batch], 1 << 20):
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    if size >= chunk and row[0] != held[-1][0]:
                        yield work(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
        if held:
            yield work(held)
    return run


def _by_window(content: DataFrame, width: int, kind: np.dtype, earlier: bool) -> DataFrame:
    """Classes of crowded anchors: a row per window, compared by an aggregate over all of the corpus."""
    def explode(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in batches([batch], 1 << 18):
                windows = [Sums(tokens_of(np.frombuffer(c, kind))).all(width).view(np.int64) for c in part.column("content").to_pylist()]
                sizes = [len(w) for w in windows]
                columns = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("anchor", "c1", "c2", "least")]
                place = np.concatenate([np.arange(s) for s in sizes]) if sizes else np.array([], np.int64)
                yield pa.record_batch([*columns, pa.array(np.concatenate(windows) if windows else place), pa.array(place)],
                                      names=["anchor", "c1", "c2", "least", "window", "place"])
    each = content.select("anchor", "c1", "c2", "least", "content").mapInArrow(
        explode, "anchor bigint, c1 bigint, c2 bigint, least bigint, window bigint, place bigint")
    totals = each.groupBy("anchor", "window").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("uses"))
    met = each.drop("least").join(totals if earlier else totals.filter("uses > 1"), ["anchor", "window"])
    return met.select("anchor", "c1", "c2", F.col("place").alias("low"), (F.col("place") + 1).alias("high"),
                      F.col("smallest").alias("least"))
