"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so the
one-edit neighbourhoods of the reduced words are generated (a few dozen keys each instead of hundreds over all letters)
and meet the reduced vocabulary by an equi-join. The words behind two reduced words meet on the half of the word that the
edit leaves alone, and are verified as they are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulegauge.llm.common import scalar, stored

#: Letters of a run: A-Z (lower-cased), a-z and U+00C0 to U+00FF.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def words(docs: DataFrame, *, least_length: int = 7, least_n: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: letter runs of all texts with their occurrences, after the keyed loss of letters.

    A run whose CRC-32 of ``<doc_id>:<run>`` is divisible by ``every`` loses the letter at that number modulo its length.
    A NULL text has no runs; a NULL doc_id is written as nothing. Repeated rows count again.
    """
    # maximal runs only: shorter runs cannot become a word
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LOWER}\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    one = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    one = one.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")).alias("_h"))
    place = (F.col("_h") % F.length("_run")).cast("int")
    less = F.concat(F.substring(F.col("_run"), F.lit(1), place), F.substring(F.col("_run"), place + 2, F.length("_run")))
    one = one.select(F.when(F.col("_h") % every == 0, less).otherwise(F.col("_run")).alias("word"))
    return (one.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_n))


def _reduced(word: Column, symbols: int) -> Column:
    """Every letter as one of ``symbols`` characters."""
    if not 1 <= symbols <= 60:
        raise ValueError("symbols must be 1 to 60")
    hashed = "".join(chr(65 + (ord(c) * 0x9E3779B1 % (1 << 32) >> 16) % symbols) for c in LETTERS)
    return F.translate(word, LETTERS, hashed)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and symbol matrices (as unsigned longs) of the reduced words of each length."""
    found = [x.encode() for x in column.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        step = max(1, (1 << 20) // int(size))
        for first in range(0, len(at), step):
            some = at[first:first + step]
            yield some, np.frombuffer(b"".join(found[i] for i in some), np.uint8).reshape(len(some), size).astype(np.uint64)


def _powers(size: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64))]).astype(np.uint64)


def _codes(values: np.ndarray) -> np.ndarray:
    """Polynomial code of each row of symbols, modulo 2**64."""
    return (values * _powers(values.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def _coded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        codes = np.zeros(batch.num_rows, np.uint64)
        for at, values in _by_length(batch.column("reduced")):
            codes[at] = _codes(values)
        yield pa.record_batch([batch.column("reduced"), pa.array(codes.view(np.int64))], names=["reduced", "code"])


def _neighbours(symbols: int):
    """The half of each one-edit neighbourhood that reaches every pair of reduced words from one end: the word itself, a
    symbol lost, a symbol replaced by a greater one. ``edit``: 0 and 1 keep the length, 2 and 3 lose a symbol; the even
    ones change the second half of the shorter word and leave its first half, the odd ones the other way round."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, values in _by_length(batch.column("reduced")):
                n, size = values.shape
                powers = _powers(size)
                code = _codes(values)
                whole = np.arange(size)
                codes, nears, edits = [code, code], [code, code], [np.zeros(n, np.uint8), np.ones(n, np.uint8)]
                # lost: what follows moves down by one power
                terms = values * powers[:-1]
                ahead = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
                lost = ahead + (code[:, None] - ahead - terms) * np.uint64(_BACK)
                side = (2 + (whole < (size - 1) // 2)).astype(np.uint8)
                # equal neighbours in a run of one symbol: one key per side
                first = np.ones((n, size), bool)
                first[:, 1:] = (values[:, 1:] != values[:, :-1]) | (side[1:] != side[:-1])
                codes.append(np.repeat(code, first.sum(axis=1)))
                nears.append(lost[first])
                edits.append(np.broadcast_to(side, (n, size))[first])
                side = (whole < size // 2).astype(np.uint8)
                for more in range(1, symbols):
                    fits = values + np.uint64(more) < 65 + symbols
                    near = code[:, None] + np.uint64(more) * powers[:-1]
                    codes.append(np.repeat(code, fits.sum(axis=1)))
                    nears.append(near[fits])
                    edits.append(np.broadcast_to(side, (n, size))[fits])
                yield pa.record_batch([pa.array(np.concatenate(codes).view(np.int64)), pa.array(np.concatenate(nears).view(np.int64)),
                                       pa.array(np.concatenate(edits).astype(np.int8))], names=["code", "near", "edit"])
    return run


def _kept_half(word: Column, length: Column, odd: Column) -> Column:
    """The half that the edit leaves alone, for a shorter word of ``length`` letters: its first letters or its last."""
    half = F.floor(length / 2).cast("int")
    return F.when(odd, F.substring(word, F.length(word) - (length - half) + 1, length - half)).otherwise(F.substring(word, F.lit(1), half))


def near_pairs(vocabulary: DataFrame, *, symbols: int = 6) -> DataFrame:
    """``a, b, a_n, b_n``: every pair of words of ``vocabulary`` (word, n; words distinct) one edit apart, once."""
    listed = vocabulary.select("word", "n", _reduced(F.col("word"), symbols).alias("reduced"))
    reduced = stored(listed.select("reduced").distinct().mapInArrow(_coded, "reduced string, code long"), "reduced")
    links = (reduced.select("reduced").mapInArrow(_neighbours(symbols), "code long, near long, edit byte")
             .join(reduced.select(F.col("code").alias("near")), "near", "left_semi"))
    coded = stored(listed.join(reduced, "reduced").select("word", "n", "code"), "coded")
    length = F.length("word")
    index = coded.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "code", length.alias("_size"),
                         F.explode(F.array(F.lit(False), F.lit(True))).alias("_odd"))
    index = index.select("b", "b_n", F.xxhash64("code", "_odd", _kept_half(F.col("b"), F.col("_size"), F.col("_odd"))).alias("_key"))
    shorter = length - (F.col("edit") >= 2).cast("int")
    odd = F.col("edit") % 2 == 1
    asked = links.join(coded, "code").select(
        F.col("word").alias("a"), F.col("n").alias("a_n"), (F.col("near") == F.col("code")).alias("_same"),
        F.xxhash64("near", odd, _kept_half(F.col("word"), shorter, odd)).alias("_key"))
    met = asked.join(index, "_key").filter((~F.col("_same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b", "a_n", "b_n").distinct()


def variants(docs: DataFrame, *, least_length: int = 7, least_n: int = 2, every: int = 31, times: int = 10,
             symbols: int = 6) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (doc_id, text).

    A word's form is the word one edit away that occurs most (ties: the first in code-point order), if that is at least
    ``times`` as often as the word; the root is reached from form to form. Words without a form are their own root.
    NULL and empty texts have no words, repeated rows count again, an empty table gives no rows, runs may be of any length,
    and other columns are not looked at.
    """
    vocabulary = stored(words(docs.select("doc_id", "text"), least_length=least_length, least_n=least_n, every=every), "vocabulary")
    pairs = stored(near_pairs(vocabulary, symbols=symbols), "near")
    both = pairs.select("a", F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("near")).unionByName(
        pairs.select(F.col("b").alias("a"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word")).alias("near")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    known = F.col("near.less") * -1
    found = vocabulary.join(best, F.col("word") == F.col("a"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(known >= times * F.col("n"), F.struct(F.col("near.word").alias("form"), known.alias("form_n"))).alias("near"))
    found = stored(found.select("word", "n", "n_near", "near.form", "near.form_n"), "forms")
    roots = _roots(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """``word, root``: each word's last form. Rounds double the way; a form occurs more often than its word, so there is
    no circle."""
    at = stored(steps, "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(at.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not scalar(after.agg(F.coalesce(F.bool_or("moved"), F.lit(False)).alias("moved"))).moved:
            return after.select("word", "root")
        at = after.select("word", "root")
