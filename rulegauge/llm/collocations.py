"""Phrase collocations from a weighted de Bruijn graph of words.

The edges are the longest phrases, counted once over all texts; an edge leads from its first words to its last words. Each
shorter phrase is counted without reading the texts again: what leaves a node, plus the pieces that end there, is the
count of the node's words, and the same sum over first words gives the next shorter ones. Runs of edges that nothing
enters or leaves between are compacted to one path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulegauge.llm.common import batches, scalar, stored, texts_of

#: What ends a piece becomes a full stop, a tab becomes a space.
_CUTS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"." * 9 + b" ")
#: Bits of the filter of frequent pairs: 8 MB, however large the corpus.
FILTER_BITS = 26
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _numbered(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
    """Language, words and their numbers in running text; number 0 ends a piece. About ``most`` words at a time."""
    held: dict[bytes, tuple[dict, list]] = {}

    def taken() -> Iterator[tuple[bytes, list[bytes], np.ndarray]]:
        for lang, (known, runs) in held.items():
            if not runs:
                continue
            yield lang, list(known), np.concatenate(runs)
        held.clear()
    size = 0
    for batch in rows:
        for part in batches([batch]):
            for text, lang in zip(texts_of(part.column("text")), texts_of(part.column("lang"))):
                known, runs = held.setdefault(lang, ({b".": 0}, []))
                text = text.lower().translate(_CUTS)
                at = 0
                while at < len(text):
                    # long texts in slices that end where a piece ends
                    end = text.find(b".", at + (4 << 20)) + 1 or len(text)
                    words = (text[at:end] + b".").replace(b".", b" . ").split()
                    runs.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                    size, at = size + len(words), end
                    if size >= most:
                        yield from taken()
                        known, runs = held.setdefault(lang, ({b".": 0}, []))
                        size = 0
    yield from taken()


def _pair_codes(lang: bytes, words: list[bytes], numbers: np.ndarray) -> np.ndarray:
    """A code of every two neighbours in running text, those across the end of a piece included."""
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[numbers]
    mixed = codes[:-1] * _ODD[0] + (codes[1:] ^ np.uint64(xxhash.xxh64_intdigest(lang, 1))) * _ODD[1]
    mixed ^= mixed >> np.uint64(31)
    return mixed * _ODD[2]


def _pairs(most: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in _numbered(rows, most):
            inside = (numbers[:-1] > 0) & (numbers[1:] > 0)
            codes, counts = np.unique(_pair_codes(lang, words, numbers)[inside], return_counts=True)
            yield pa.record_batch([pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["code", "n"])
    return run


def _blocks(key: tuple, table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << 16, bool)
    bits[table.column("bit").to_numpy()] = True
    return pa.table({"block": [key[0].as_py()], "bits": [np.packbits(bits).tobytes()]})


def frequent_pairs(docs: DataFrame, *, least: int, most: int) -> np.ndarray:
    """A bit for every code of two neighbouring words that occur ``least`` times, in a filter of fixed size.

    No phrase of ``least`` occurrences holds two neighbours whose bit is unset. Bits of other pairs may be set by chance:
    they cost a few more rows and change no count. Once frequent pairs outnumber the bits the filter passes nearly all.
    """
    codes = docs.mapInArrow(_pairs(most), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    place = F.shiftrightunsigned("code", 64 - FILTER_BITS)
    bits = codes.select(F.shiftrightunsigned(place, 16).alias("block"), place.bitwiseAND(0xFFFF).cast("int").alias("bit")).distinct()
    packed = np.zeros((1 << FILTER_BITS - 16, 1 << 13), np.uint8)
    for block, row in bits.groupBy("block").applyInArrow(_blocks, "block long, bits binary").collect():
        packed[block] = np.frombuffer(row, np.uint8)
    return packed.reshape(-1)


def _suffixes(longest: int, most: int, shared):
    """Of every word the longest phrase that starts there, counted per language before anything is shuffled. It ends with
    the piece, or before a pair that is too rare; what is shorter than ``longest`` stands for such an end."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for lang, words, numbers in _numbered(rows, most):
            codes = _pair_codes(lang, words, numbers) >> np.uint64(64 - FILTER_BITS)
            goes = (bits[codes >> np.uint64(3)] >> (np.uint64(7) - (codes & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
            goes &= (numbers[:-1] > 0) & (numbers[1:] > 0)
            padded = np.concatenate([numbers, np.zeros(longest, np.int64)])
            goes = np.concatenate([goes, np.zeros(longest, bool)])
            grams = np.zeros((longest, len(numbers)), np.int64)
            grams[0], alive = numbers, np.ones(len(numbers), bool)
            for k in range(1, longest):
                alive = alive & goes[k - 1:k - 1 + len(numbers)]
                grams[k] = np.where(alive, padded[k:k + len(numbers)], 0)
            grams = grams[:, numbers > 0]
            order = np.lexsort(grams[::-1])
            grams = grams[:, order]
            first = np.ones(grams.shape[1], bool)
            first[1:] = (grams[:, 1:] != grams[:, :-1]).any(axis=0)
            starts = np.flatnonzero(first)
            counts = np.diff(np.append(starts, len(first)))
            for at in range(0, len(starts), 1 << 16):
                some = grams[:, starts[at:at + (1 << 16)]].T.tolist()
                heads = [lang + b"\t" + b" ".join([words[w] for w in gram[:longest - 1] if w]) for gram in some]
                lasts = [words[gram[-1]] if gram[-1] else None for gram in some]
                yield pa.record_batch([pa.array(heads, pa.binary()).cast(pa.string()), pa.array(lasts, pa.binary()).cast(pa.string()),
                                       pa.array(counts[at:at + (1 << 16)].astype(np.int64))], names=["head", "last", "n"])
    return run


def _fewer(phrase: Column, size: int) -> Column:
    """The first ``size`` words. (Words hold no space; the language before the tab may.)"""
    words = F.substring_index(phrase, "\t", -1)
    lang = F.substring(phrase, F.lit(1), F.length(phrase) - F.length(words))
    return F.concat(lang, F.substring_index(words, " ", size))


def _size(phrase: Column) -> Column:
    words = F.substring_index(phrase, "\t", -1)
    return F.length(words) - F.length(F.translate(words, " ", "")) + 1


def graph(docs: DataFrame, *, longest: int = 4, least: int = 30, most: int = 1_000_000) -> DataFrame:
    """``phrase, size, n``: all phrases of at most ``longest`` words with ``n >= least``, and all single words.

    ``phrase`` holds the language (NULL: ``und``), a tab and the words. Edges have ``longest`` words, nodes a word less;
    what leaves a node is the sum of its edges and of the pieces that end there. Each shorter size is the sum of the one
    above it over the first words, plus the pieces that end there. An edge is spun only where each two neighbours may be
    frequent (``frequent_pairs``); where they are not the piece counts as ended, so no count of frequent phrases changes
    and rare text is not shuffled. ``most`` words are counted in a task before they are sent on.
    """
    read = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_pairs(read, least=least, most=most))
    sent = stored(read.mapInArrow(_suffixes(longest, most, shared), "head string, last string, n long"), "grams")
    edges = (sent.filter(F.col("last").isNotNull()).groupBy("head", "last").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
             .select(F.concat_ws(" ", "head", "last").alias("phrase"), F.lit(longest).alias("size"), "n"))
    nodes = stored(sent.groupBy("head").agg(F.sum("n").alias("n")).select(
        F.col("head").alias("phrase"), _size(F.col("head")).alias("size"), "n"), "nodes")
    kept, level = edges, nodes
    for size in range(longest - 1, 0, -1):
        if size < longest - 1:
            # what is shorter already is a piece's end
            level = (level.groupBy(F.when(F.col("size") > size, _fewer(F.col("phrase"), size)).otherwise(F.col("phrase")).alias("phrase"),
                                   F.least("size", F.lit(size)).alias("size")).agg(F.sum("n").alias("n")))
        kept = kept.unionByName(level.filter((F.col("size") == size) & ((F.col("n") >= least) | F.lit(size == 1))))
    return stored(kept, "counts")


def paths(counts: DataFrame, *, longest: int = 4) -> DataFrame:
    """``first, at, phrase, n``: the frequent edges in compacted paths, with the path's first edge and the place in it.

    An edge goes on to the next where the node between them has no other flow: no other edge, no piece that starts or ends
    there. Every piece starts and ends somewhere, so paths are no circles, and none is longer than the longest piece.
    Places are found by pointer jumping, in about as many rounds as the logarithm of the longest path.
    """
    edges = counts.filter(F.col("size") == longest)
    words = F.substring_index("phrase", "\t", -1)
    lang = F.substring(F.col("phrase"), F.lit(1), F.length("phrase") - F.length(words))
    tail = F.concat(lang, F.substring_index(words, " ", -(longest - 1)))
    nodes = counts.filter(F.col("size") == longest - 1)
    before = (edges.select(F.col("phrase").alias("before"), tail.alias("node"), "n")
              .join(nodes.select(F.col("phrase").alias("node"), "n"), ["node", "n"]))
    after = edges.select("phrase", _fewer(F.col("phrase"), longest - 1).alias("node"), "n")
    at = stored(after.join(before, ["node", "n"], "left").select(
        "phrase", "n", F.coalesce("before", "phrase").alias("first"), F.col("before").isNotNull().cast("long").alias("at")), "jumps")
    while True:
        ahead = at.select(F.col("phrase").alias("first"), F.col("first").alias("next"), F.col("at").alias("more"))
        at = stored(at.join(ahead, "first").select(
            "phrase", "n", F.col("next").alias("first"), (F.col("at") + F.col("more")).alias("at"),
            (F.col("more") > 0).alias("moved")), "jumps")
        if not scalar(at.agg(F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved"))).moved:
            return at.select("first", "at", "phrase", "n")


def phrases(located: DataFrame) -> DataFrame:
    """``lang, phrase, n_words, n``: each compacted path as one phrase, however long; from ``paths``."""
    step = F.substring_index("phrase", " ", -1)
    ends = F.transform(F.array_sort(F.collect_list(F.struct("at", step.alias("word")))), lambda x: x["word"])
    joined = located.groupBy("first", "n").agg(ends.alias("ends"))
    words = F.substring_index("first", "\t", -1)
    whole = F.concat_ws(" ", F.array(words), F.slice("ends", F.lit(2), F.greatest(F.size("ends") - 1, F.lit(0))))
    return joined.select(F.substring(F.col("first"), F.lit(1), F.length("first") - F.length(words) - 1).alias("lang"),
                         whole.alias("phrase"), (_size(F.col("first")) + F.size("ends") - 1).alias("n_words"), "n")


def collocations(docs: DataFrame, *, longest: int = 4, least: int = 30, share: int = 80, top: int = 2000,
                 most: int = 1_000_000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of 2 to ``longest`` words of each language.

    A phrase's score is that of its worst cut into two parts, ``floor(2000000 * a / (l + r))``, in exact arithmetic.
    Phrases inside a longer one with ``share`` per cent of their count or more are left out. Reads ``text`` and ``lang`` only.
    NULL texts are empty, a NULL language is ``und``, repeated rows count again; ties end with the phrase in byte order; an
    empty table gives no rows; texts are read whole.
    """
    counts = graph(docs, longest=longest, least=least, most=most)
    located = stored(paths(counts, longest=longest), "paths")
    frequent = counts.filter(F.col("n") >= least)
    words = F.substring_index("phrase", "\t", -1)
    lang = F.substring(F.col("phrase"), F.lit(1), F.length("phrase") - F.length(words))
    # nodes inside a path have the count of the edges around them
    inner = located.filter("at > 0").select(_fewer(F.col("phrase"), longest - 1).alias("phrase"))
    candidates = frequent.filter("size > 1").join(inner, "phrase", "left_anti")
    # a phrase's longest neighbours: those with one word more; longer ones are no more frequent
    longer = frequent.filter("size > 2").select(
        F.explode(F.array(_without_last(), F.concat(lang, F.substring(words, F.instr(words, " ") + 1, F.length(words))))).alias("phrase"),
        F.col("n").alias("above")).groupBy("phrase").agg(F.max("above").alias("above"))
    kept = candidates.join(longer, "phrase", "left").filter(
        F.col("above").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("above") < F.lit(share).cast("decimal(20,0)") * F.col("n")))
    parted = kept.select("phrase", F.col("n").alias("a"), lang.alias("_lang"), F.split(words, " ").alias("_words")).select(
        "phrase", "a", "_lang", "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - 1)).alias("k"))
    parted = parted.select("phrase", "a", "k",
                           F.concat("_lang", F.array_join(F.slice("_words", F.lit(1), F.col("k")), " ")).alias("_left"),
                           F.concat("_lang", F.array_join(F.slice("_words", F.col("k") + 1, F.size("_words")), " ")).alias("_right"))
    part = frequent.filter(F.col("size") < longest)
    parted = (parted.join(part.select(F.col("phrase").alias("_left"), F.col("n").alias("l")), "_left")
              .join(part.select(F.col("phrase").alias("_right"), F.col("n").alias("r")), "_right"))
    score = F.expr("CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    scored = parted.groupBy("phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    named = scored.select(F.substring(lang, F.lit(1), F.length(lang) - 1).alias("lang"), words.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = named.withColumn("rank", rank).filter(F.col("rank") <= top)
    single = counts.filter("size = 1")
    total = single.groupBy(F.substring(lang, F.lit(1), F.length(lang) - 1).alias("lang")).agg(F.sum("n").alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _without_last() -> Column:
    """The phrase without its last word."""
    return F.substring(F.col("phrase"), F.lit(1), F.length("phrase") - F.length(F.substring_index("phrase", " ", -1)) - 1)
