"""Quality rules: base counts of a text, and its divergence from its language's reference histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegauge.llm.common import batches, stored, texts_of

#: Frequent function words per language; words of a text are lower-cased and stripped of punctuation before the lookup.
COMMON_WORDS = {
    "en": "the of and to in a is that it on for was be by with as at are this from or have not but which".split(),
    "fr": "de la le et les des en un du une est que pour qui dans a par plus pas au sur ne se ce il".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le".split(),
}
SYMBOLS = b"#*$%&|<>"
_EDGES = b".,;:!?\"'()[]"
#: Classes: lower case, upper case, digit, blank, line end, sentence mark, symbol of the base rules, other ASCII,
#: start of a Latin-1 letter, of another two-byte letter, of a longer character, and bytes that only continue one.
_CLASSES = 12


def _class_of(byte: int) -> int:
    if byte >= 0x80:
        return 11 if byte < 0xC0 else 8 if byte in (0xC2, 0xC3) else 9 if byte < 0xE0 else 10
    char = chr(byte)
    if char.isalpha():
        return 0 if char.islower() else 1
    if char.isdigit():
        return 2
    if byte == 10:
        return 4
    if byte == 32 or 9 <= byte <= 13:
        return 3
    return 5 if char in ".,;:!?\"'()-" else 6 if byte in SYMBOLS else 7


_CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)


def repeated_words(codes: np.ndarray, kinds: int, width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more; ``codes`` number the words from 0 to ``kinds``."""
    n = len(codes) - width + 1
    if n < 2:
        return 0
    window = codes[:n]
    for step in range(1, width):
        _, window = np.unique(window * kinds + codes[step:step + n], return_inverse=True)
    often = np.flatnonzero(np.bincount(window)[window] > 1)
    inside = np.zeros(len(codes), bool)
    for step in range(width):
        inside[often + step] = True
    return int(inside.sum())


def measured(text: bytes, lang: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class counts, common-word counts (last: all others)."""
    raw = np.frombuffer(text, np.uint8)
    classes = np.bincount(_CLASS[raw], minlength=_CLASSES)
    words = text.split()
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    common = _common().get(lang)
    counts = None
    if common is not None:
        counts = np.zeros(len(common) + 1, np.int64)
        times = np.bincount(codes, minlength=len(seen)).tolist()
        for word, n in zip(seen, times):
            counts[common.get(word.strip(_EDGES).lower(), -1)] += n
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), int(classes.sum() - classes[3] - classes[4] - classes[11]), int(classes[6]),
            len(lines) - len(set(lines)), repeated_words(codes, max(1, len(seen))), classes[:11], counts)


def _common(cache={}):  # noqa: B006 - made once per worker
    if not cache:
        cache.update({lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in COMMON_WORDS.items()})
    return cache


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def profiled(docs: DataFrame, *, keep_text: bool) -> DataFrame:
    """``docs`` with one column ``_profile``: the base counts and the two histograms of each text.

    NULL texts are empty; a language without a list of common words has no word histogram.
    """
    kept = [c for c in docs.columns if keep_text or c != "text"]
    ints, shape = T.ArrayType(T.LongType()), T.StructType()
    for name in _COUNTS:
        shape = shape.add(name, "long")
    shape = shape.add("classes", ints).add("common", ints)
    arrow = pa.struct([*[(n, pa.int64()) for n in _COUNTS], ("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in batches([batch]):
                found = [measured(t, g) for t, g in zip(texts_of(part.column("text")), part.column("_lang").to_pylist())]
                values = pa.array([dict(zip((*_COUNTS, "classes", "common"), f)) for f in found], arrow)
                yield pa.record_batch([*[part.column(c) for c in kept], values], names=[*kept, "_profile"])
    source = docs.select(*docs.columns, F.col("lang").cast("string").alias("_lang"))
    return source.mapInArrow(run, docs.select(*kept).schema.add("_profile", shape))


def _base_failed(profile: str = "_profile") -> Column:
    n = F.col(f"{profile}.n_words")
    return (n < 50) | (F.col(f"{profile}.n_repeat_words") * 100 > n * 50)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


_UNIT = 1_000_000


def _shares(counts: Column) -> Column:
    """Counts as whole millionths of their sum."""
    return F.transform(counts, lambda x: F.floor(x * _UNIT / _total(counts)).cast("long"))


def references(profiles: DataFrame, *, min_words: int = 50) -> DataFrame:
    """``_name, _texts, _class_ref, _word_ref`` per language: mean shares over its texts that pass the base rules and
    have ``min_words``.

    Every text weighs the same. Shares are summed as whole millionths, so the order of summing does not matter.
    """
    good = profiles.filter(~_base_failed() & (F.col("_profile.n_words") >= min_words))
    sums = [F.count(F.lit(1)).alias("texts")]
    widest = max(len(w) for w in COMMON_WORDS.values()) + 1
    for name, n in (("classes", _CLASSES - 1), ("common", widest)):
        good = good.withColumn(f"_{name}", _shares(F.col(f"_profile.{name}")))
        sums.append(F.array(*[F.coalesce(F.sum(F.get(f"_{name}", F.lit(i))), F.lit(0)) for i in range(n)]).alias(name))
    return good.groupBy("lang").agg(*sums).select(F.col("lang").alias("_name"), F.col("texts").alias("_texts"),
                                                  F.col("classes").alias("_class_ref"), F.col("common").alias("_word_ref"))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two histograms; NULL if one is NULL or empty."""
    a, b = _total(counts), _total(reference)

    def term(x, other):
        return F.when(x > 0, x * F.log2(2 * x / (x + other))).otherwise(0.0)
    both = F.zip_with(counts, F.slice(reference, F.lit(1), F.size(counts)), lambda x, y: term(x / a, y / b) + term(y / b, x / a))
    divergence = F.aggregate(both, F.lit(0.0), lambda s, x: s + x) / 2
    return F.when((a > 0) & (b > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


_OWN = ("_lang", "_profile", "_name", "_texts", "_class_ref", "_word_ref")


def verdict(*, min_words: int = 50, min_common: int = 50, min_texts: int = 20, class_limit: float = 0.32,
            word_limit: float = 0.27, short_words: int = 100, short_slope: float = 0.0015) -> dict[str, Column]:
    """``base_failed, class_distance, word_distance, kept`` over the columns of a profile and its language's references.

    A text is judged by its characters only if it has ``min_words`` words, by its common words only if it has
    ``min_common``, and by either only if its language has ``min_texts`` texts in the reference; too short texts and
    too rare languages are not held against a document. Shares of few words scatter: for each word that a text has less than
    ``short_words``, its ``word_limit`` is wider by ``short_slope``. ``kept`` is false if a base rule fails or a distance is above
    its limit. NULL languages form a language of their own.
    """
    known, n = F.col("_texts") >= min_texts, F.col("_profile.n_words")
    classes = F.when(known & (n >= min_words), js_distance(F.col("_profile.classes"), F.col("_class_ref")))
    words = F.when(known & (n >= min_common), js_distance(F.col("_profile.common"), F.col("_word_ref")))
    allowed = F.lit(word_limit) + F.greatest(F.lit(short_words) - n, F.lit(0)) * F.lit(short_slope)
    far = (F.coalesce(classes, F.lit(0.0)) > class_limit) | (F.coalesce(words, F.lit(0.0)) > allowed)
    return {"base_failed": _base_failed(), "kept": ~_base_failed() & ~far, "class_distance": classes, "word_distance": words}


def _with_references(profiles: DataFrame, refs: DataFrame) -> DataFrame:
    return profiles.join(refs, F.col("lang").eqNullSafe(F.col("_name")), "left")


def report(docs: DataFrame, **limits) -> DataFrame:
    """Counts, distances and verdict of every document, ``kept`` included. Repeated rows are rows of their own; an empty table
    gives no rows; columns other than doc_id, text and lang are not looked at."""
    profiles = stored(profiled(docs.select("doc_id", "text", "lang"), keep_text=False), "profiles")
    refs = stored(references(profiles), "references")
    counts = [F.col(f"_profile.{c}").alias(c) for c in _COUNTS]
    return _with_references(profiles, refs).select("doc_id", *counts, *[x.alias(name) for name, x in verdict(**limits).items()])


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, all columns with them, but columns named as in ``_OWN`` give way. Texts are measured
    twice and never shuffled."""
    docs = docs.drop(*_OWN)
    refs = stored(references(profiled(docs.select("text", "lang"), keep_text=False)), "references")
    return _with_references(profiled(docs, keep_text=True), refs).filter(verdict(**limits)["kept"]).select(*docs.columns)
