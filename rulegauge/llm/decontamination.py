"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegauge.llm.common import batches, lists, numbered, parts, scalar, stored, texts_of

# letters and digits of ASCII, lower-cased, and every byte beyond ASCII; all else separates
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def windows(items: DataFrame, width: int = 13) -> DataFrame:
    """``window, length, terms, items``: each distinct window of words once, with the item ids it occurs in.

    A window is ``width`` consecutive words; an item of fewer, but not none, is one window. NULL texts have none.
    """
    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in batches([batch], 1 << 20):
                ids, terms = [], []
                for item, text in zip(part.column(0).to_pylist(), texts_of(part.column(1))):
                    words = [w.decode() for w in words_of(text)]
                    for at in range(max(1, len(words) - width + 1) if words else 0):
                        ids.append(item)
                        terms.append(words[at:at + width])
                yield pa.record_batch([pa.array(ids, pa.string()), pa.array(terms, pa.list_(pa.string()))],
                                      names=["item_id", "terms"])
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")
    each = items.select(item, "text").mapInArrow(cut, "item_id string, terms array<string>")
    once = stored(each.distinct().withColumn("window", F.sha2(F.concat_ws(" ", "terms"), 256)), "windows")
    return once.select("window", F.size("terms").alias("length"), "terms", "item_id")


def index(docs: DataFrame, vocabulary: list[bytes], span: int, need: int) -> DataFrame:
    """Columns of ``docs`` but ``text``, ``n_words``, and the postings of test terms as ``places, terms`` (aligned arrays).

    A place is kept if some ``span`` consecutive words around it hold ``need`` test terms or more; no match can use
    another. The vocabulary travels with the task, so it must be of a bounded block of items.
    """
    known = frozenset(vocabulary)
    kept = [c for c in docs.columns if c != "text"]

    def post(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in batches([batch]):
                sizes, counts, terms, places = [], [], [], []
                for text in texts_of(part.column("text")):
                    words = words_of(text)
                    at = _dense(np.fromiter(map(known.__contains__, words), bool, len(words)), span, need)
                    sizes.append(len(words))
                    counts.append(len(at))
                    places.append(at)
                    terms += [words[i].decode() for i in at]
                flat = np.concatenate(places).astype(np.int32) if places else np.array([], np.int32)
                found_terms = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(terms, pa.string()))
                yield pa.record_batch(
                    [*[part.column(c) for c in kept], pa.array(sizes, pa.int64()), lists(flat, counts, pa.int32()), found_terms],
                    names=[*kept, "n_words", "places", "terms"])
    shape = docs.select(*kept).schema.add("n_words", "long").add("places", T.ArrayType(T.IntegerType())).add("terms", T.ArrayType(T.StringType()))
    return docs.select(*kept, "text").mapInArrow(post, shape)


def _dense(test: np.ndarray, span: int, need: int) -> np.ndarray:
    """Places of test terms in some run of ``span`` words (or the whole text) that holds ``need`` of them."""
    n = len(test)
    if test.sum() < need:
        return np.array([], np.int64)
    before = np.concatenate([[0], np.cumsum(test)])
    width = min(span, n)
    full = before[width:] - before[:n - width + 1] >= need
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(full)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return np.flatnonzero((np.cumsum(cover)[:n] > 0) & test)


def matches(wanted: DataFrame, postings: DataFrame, key: str, slop: int = 0) -> DataFrame:
    """``window, length, key, start, exact``: windows whose words all stand where they should, up to ``slop`` words.

    Each window looks up its rarest term; every posting of it names a place where the window would start, and the lists
    of the other terms, shifted by their offsets, must hold a word there. ``slop`` = 0 gives exact phrases.
    """
    rarity = postings.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    terms = wanted.select("window", "length", F.posexplode("terms").alias("offset", "term")).distinct()
    rated = terms.join(rarity, "term")
    rarest = rated.groupBy("window", "length").agg(F.min(F.struct("uses", "offset", "term")).alias("rare"),
                                                   F.count(F.lit(1)).alias("found"))
    rarest = stored(rarest.filter("found = length").select("window", "length", F.col("rare.offset").alias("anchor"),
                                                           F.col("rare.term").alias("term")), "rarest")
    starts = stored(rarest.join(postings, "term").select(
        "window", "length", "anchor", key, (F.col("place") - F.col("anchor")).alias("start"))
        .filter(F.col("start") >= -slop), "starts")
    shifts = F.explode(F.array(*[F.lit(s) for s in range(-slop, slop + 1)])) if slop else F.lit(0)
    other = terms.join(rarest.select("window", "anchor"), "window").filter("offset != anchor").select(
        "window", "offset", "term")
    asked = starts.join(other, "window").withColumn("shift", shifts).withColumn(
        "place", F.col("start") + F.col("offset") + F.col("shift"))
    held = asked.join(postings, [key, "term", "place"]).groupBy("window", "length", key, "start").agg(
        F.count_distinct("offset").alias("hits"), F.sum((F.col("shift") == 0).cast("int")).alias("straight"))
    several = held.filter(F.col("hits") == F.col("length") - 1).select(
        "window", "length", key, "start", (F.col("straight") == F.col("length") - 1).alias("exact"))
    single = starts.filter("length = 1").select("window", "length", key, "start", F.lit(True).alias("exact"))
    return several.unionByName(single)


def found(rows: DataFrame, items: DataFrame, *, width: int = 13, slop: int = 0,
          block_words: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(columns of ``rows`` but text, with n_words; matches with item ids) for texts (_row, text, ...) against items.

    Items are worked off in blocks of about ``block_words`` words, whatever the size of the benchmark; each block is
    one pass over the texts. The index is written once per block, range-partitioned on term and place, so a term that
    every document uses is spread over files and tasks.
    """
    spark = rows.sparkSession
    all_windows = windows(items, width)
    lengths = scalar(all_windows.agg(F.min("length"), F.max("length"), F.min(F.size(F.array_distinct("terms"))),
                                     F.sum("length")))
    shortest, longest, distinct, total = (int(x or 0) for x in lengths)
    blocks = max(1, -(-total // (block_words * width)))
    span, need = (longest + 2 * slop, distinct) if slop else (max(shortest, 1), max(shortest, 1))
    if blocks > 1:
        rows = stored(rows, "texts")
    counts, hits = None, None
    for block in range(blocks):
        mine = all_windows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        words = [r[0].encode() for r in mine.select(F.explode("terms")).distinct().collect()]
        posted = stored(index(rows, words, span, need), "postings")
        postings = stored(posted.select("_row", F.explode(F.arrays_zip("terms", "places")).alias("p")).select(
            F.col("p.terms").alias("term"), "_row", F.col("p.places").alias("place"))
            .repartitionByRange(parts(spark), "term", "_row", "place").sortWithinPartitions("term", "_row", "place"), "index")
        got = stored(matches(mine, postings, "_row", slop), "matches")
        got = got.join(mine.select("window", "item_id").distinct(), "window")
        counts = posted.drop("places", "terms") if counts is None else counts
        hits = got if hits is None else hits.unionByName(got)
    return counts, hits


def judged(rows: DataFrame, items: DataFrame, *, width: int = 13, share: int = 20) -> DataFrame:
    """Columns of ``rows`` (_row, text, ...) but the text, with ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A word inside any occurrence of a window is hit; a document is contaminated if it has hits and at least one word in
    ``share`` is hit. NULL and empty texts have no words and no hits; items without an id count as one with an empty id.
    """
    counts, hits = found(rows, items, width=width)
    spans = hits.select("_row", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    order = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest(F.col("start"), F.coalesce(F.max("end").over(order), F.lit(0)))
    covered = (spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - reached))
               .groupBy("_row").agg(F.sum("new").alias("n_hit")))
    named = hits.select("_row", "item_id").distinct().groupBy("_row").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    about = stored(covered.join(named, "_row"), "hits")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counts.join(about, "_row", "left").select(
        *counts.columns, n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"))


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``judged`` with the doc_id of every document. Repeated rows and ids are rows of their own; an empty benchmark
    hits nothing; an empty table gives no rows; other columns are not looked at."""
    return judged(numbered(docs.select("doc_id", "text")), items, **how).drop("_row")


def keep_clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, all columns kept."""
    rows = stored(numbered(docs.drop("_row")), "docs")
    bad = judged(rows.select("_row", "text"), items, **how).filter("contaminated").select("_row")
    return rows.join(stored(bad, "bad"), "_row", "left_anti").select(*[c for c in docs.columns if c != "_row"])
