"""Cross-entropy difference: how much more a text reads like a target corpus than like the background.

A target model (documents labelled good) and a background model (all documents) have the same order, vocabulary and
smoothing, and are brought to the same number of tokens. A document's score is the mean over its tokens of target loss
minus background loss, in bits: the lower, the nearer to the target. A text that the models were made of would know itself;
``leave_out`` takes its own counts out of both models before it is scored, so that training texts and new ones compare.

All words and all pairs of words are counted. Texts are worked on in slices; a slice names each of its words and pairs
once, in a row per bucket of their 64-bit hashes. A bucket's task sums the counts of all slices and answers each slice in
its own order; a slice turns the answers into losses. A slice asks only buckets it has words or pairs for, so there are never more
rows than distinct pairs in slices, however many buckets a corpus has. No table of the corpus is broadcast or collected, and a frequent pair
weighs no more than the slices it occurs in. Equality of words and pairs rests on the hashes.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegauge.llm.common import batches, scalar, stored, texts_of

#: What stands for words outside an explicit vocabulary, by the looks of the word; 0 stands for the start of a text.
_OTHERS = ("start", "with digit", "with sign", "upper case", "other")
#: Bytes of text in a slice, and bytes of text per bucket.
_SLICE, _BUCKET = 8 << 20, 8 << 20


def _looks(word: bytes) -> int:
    core = word.strip(b".,;:!?\"'()")
    if any(48 <= c <= 57 for c in core):
        return 1
    if any(c < 128 and not 65 <= c <= 90 and not 97 <= c <= 122 and c not in b"-'" for c in core):
        return 2
    return 3 if core != core.lower() and core == core.upper() else 4


def vocabulary(docs: DataFrame, size: int) -> list[bytes]:
    """The ``size`` most frequent words of all texts, ties in byte order. Words are counted in the tasks, then over the corpus."""
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in batches([batch]):
                seen = Counter()
                for text in texts_of(part.column(0)):
                    seen.update(text.split())
                yield pa.record_batch([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                      names=["word", "n"])
    totals = docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    best = stored(totals.orderBy(F.desc("n"), "word").limit(size), "vocabulary")
    return [bytes(r[0]) for r in best.orderBy(F.desc("n"), "word").collect()]


class _Codes(dict):
    """Numbers of the words of a slice, from 1 in the order they come; 0 is the start. ``names`` is what is hashed."""

    def __init__(self, known: frozenset[bytes] | None):
        self.known, self.names = known, {b" ": 0}

    def __missing__(self, word: bytes) -> int:
        name = word if self.known is None or word in self.known else b" %d" % _looks(word)
        code = self[word] = self.names.setdefault(name, len(self.names))
        return code


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes before all second ones. Compressed here, they are small on the way, too."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = before * np.uint64(0x9E3779B97F4A7C15) + word
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    return key ^ (key >> np.uint64(31))


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ``keys``, and the place of each key in it."""
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int32)
    place[order] = np.arange(len(keys), dtype=np.int32)
    return order, place


_SLICES = "slice binary, keys binary, tokens binary, lengths binary, good binary"


def _slices(docs: DataFrame, known: frozenset[bytes] | None) -> DataFrame:
    """``docs`` (doc_id, text, good) in slices: the sorted keys of the words of a slice, the start among them, and its texts as places
    among these."""
    shape = T.StructType.fromDDL(_SLICES).add("docs", T.ArrayType(docs.schema["doc_id"].dataType))
    names = shape.names

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in batches([batch], _SLICE):
                codes, runs = _Codes(known), []
                for text in texts_of(part.column("text")):
                    words = text.split()
                    runs.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
                keys = np.fromiter(map(xxhash.xxh64_intdigest, codes.names), np.uint64, len(codes.names))
                order, place = _ranked(keys)
                good = part.column("good").to_numpy(zero_copy_only=False).astype(np.uint8)
                cells = (uuid.uuid4().bytes, _pack_sorted(keys[order]), _pack(place[np.concatenate([np.zeros(0, np.int32), *runs])]),
                         _pack(np.array([len(r) for r in runs], np.int32)), _pack(good))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
                yield pa.record_batch([*[pa.array([c], pa.binary()) for c in cells], ids], names=names)
    return stored(docs.select("doc_id", "text", "good").mapInArrow(run, shape), "slices")


def _grams(keys: bytes, tokens: bytes, lengths: bytes):
    """Of a slice: keys of its words; word before and word of each token; sorted keys of its pairs, words of the pairs, pair of each
    token; tokens of each text."""
    keys, word, lengths = _unpack_sorted(keys), _unpack(tokens, np.int32), _unpack(lengths, np.int32)
    before = np.concatenate([word[:1], word[:-1]])
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = np.searchsorted(keys, np.uint64(xxhash.xxh64_intdigest(b" ")))
    pairs, at = np.unique(before.astype(np.int64) * len(keys) + word, return_inverse=True)
    ends = np.stack([pairs // len(keys), pairs % len(keys)])
    pair_keys = _pair_keys(*keys[ends])
    order, place = _ranked(pair_keys)
    return keys, before, word, pair_keys[order], ends[:, order], place[at], lengths


_ASKED = "bucket int, slice binary, asks boolean, words binary, word_counts binary, pairs binary, pair_counts binary"


def _asked(slices: DataFrame, buckets: int, *, counted: bool = True, asks: bool = True) -> DataFrame:
    """A row per slice and bucket with the words and pairs of the slice and, if ``counted``, how often they occur in it."""
    names = [c.split()[0] for c in _ASKED.split(", ")]
    kinds = (pa.int32(), pa.binary(), pa.bool_(), *[pa.binary()] * 4)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for me, *cells, good in zip(*[batch.column(c).to_pylist() for c in ("slice", "keys", "tokens", "lengths", "good")]):
                keys, before, word, pair_keys, _, at, lengths = _grams(*cells)
                target = np.repeat(_unpack(good, np.uint8).astype(bool), lengths)
                sides = []
                for own, of in ((keys, (word, before)), (pair_keys, (at,))):
                    counts = np.stack([np.bincount(x[y], minlength=len(own)) * counted for x in of for y in (target, slice(None))]).astype(np.int32)
                    sides.append((own, counts, (own >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)))
                filled = np.union1d(*[at for *_, at in sides])
                cuts = [np.stack([np.searchsorted(at, filled, side) for side in ("left", "right")], axis=1).tolist() for *_, at in sides]
                out = []
                for b, *spans in zip(filled.tolist(), *cuts):
                    found = [x for (own, counts, _), (s, e) in zip(sides, spans) for x in (_pack_sorted(own[s:e]), _pack(counts[:, s:e]))]
                    out.append((b, me, asks, *found))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
    return slices.select("slice", "keys", "tokens", "lengths", "good").mapInArrow(run, _ASKED)


_ANSWERS = "slice binary, bucket int, word_counts binary, pair_counts binary, kinds bigint, target double, background double"


def _answers(asked: DataFrame) -> DataFrame:
    """Counts over all rows of a bucket, to each slice that asks, in its order; and a row (no slice) with the bucket's number of
    words and sums of counts."""
    def total(bucket: tuple, table: pa.Table) -> pa.Table:
        sides = []
        for name, n in (("word", 4), ("pair", 2)):
            keys = [_unpack_sorted(x) for x in table.column(f"{name}s").to_pylist()]
            counts = [_unpack(x, np.int32).reshape(n, -1) for x in table.column(f"{name}_counts").to_pylist()]
            kinds, place = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate(counts, axis=1)
            sums = np.stack([np.bincount(place, weights=c, minlength=len(kinds)) for c in counts]).astype(np.int64)
            sides.append((sums, np.split(place, np.cumsum([len(k) for k in keys])[:-1])))
        out = []
        for i, (me, asks) in enumerate(zip(table.column("slice").to_pylist(), table.column("asks").to_pylist())):
            if asks:
                out.append((me, bucket[0].as_py(), *[_pack(sums[:, places[i]]) for sums, places in sides], None, None, None))
        words = sides[0][0]
        out.append((None, None, None, None, int((words[1] > 0).sum()), float(words[0].sum()), float(words[1].sum())))
        types = (pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64())
        names = ("slice", "bucket", "word_counts", "pair_counts", "kinds", "target", "background")
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), types)], names=names)
    return stored(asked.groupBy("bucket").applyInArrow(total, _ANSWERS), "answers")


class Models:
    """Counts of words and pairs of both models as tables, their totals, and how losses are made of them."""

    def __init__(self, docs: DataFrame, slices: DataFrame, answers: DataFrame, buckets: int, known: frozenset[bytes] | None, mix: float, floor: float):
        self.docs, self.slices, self.answers, self.buckets, self.known = docs, slices, answers, buckets, known
        words, *self.totals = (x or 0 for x in scalar(answers.filter("slice is null").agg(*[F.sum(c) for c in ("kinds", "target", "background")])))
        self.kinds = (words if known is None else len(known)) + len(_OTHERS)
        self.mix, self.floor = mix, floor


def _losses(word: np.ndarray, before: np.ndarray, pair: np.ndarray, total, even, kinds: int, mix: float, floor: float) -> np.ndarray:
    """Loss in bits of a word after another: counts of it, of the one before and of both, where ``total`` tokens stand for ``even``."""
    scale = even / np.maximum(1, total)
    single = (word * scale + floor) / (total * scale + floor * kinds)
    seen = np.divide(pair, before, out=np.zeros(len(pair)), where=before > 0)
    share = np.where(before > 0, mix, 0.0)
    return -np.log2(share * seen + (1 - share) * single)


def _own(doc: np.ndarray, of: np.ndarray, kinds: int) -> np.ndarray:
    """How often the text of each token holds what ``of`` numbers there."""
    _, at, n = np.unique(doc * kinds + of, return_inverse=True, return_counts=True)
    return n[at]


def train(docs: DataFrame, labels: DataFrame, *, size: int | None = None, mix: float = 0.7, floor: float = 0.5) -> Models:
    """Bigram models of ``docs`` (doc_id, text): target documents are those that ``labels`` give quality 1.

    Counts are over all documents, words and pairs; the driver sees three sums. Loss of a word: ``mix`` parts of its share
    after the word before, the rest of its share in all; every word has ``floor`` more than it was seen. With a ``size``, only so
    many of the most frequent words are told apart and the others count by their looks. Without target documents the models are the
    same shape but flat.
    """
    known = None if size is None else frozenset(vocabulary(docs, size))
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    # labels grow with the documents: the join is the same at every size, not a broadcast while they are few
    marked = docs.select("doc_id", "text").join(good.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    buckets = 1 + int(scalar(docs.agg(F.sum(F.octet_length("text"))))[0] or 0) // _BUCKET
    slices = _slices(marked, known)
    return Models(docs, slices, _answers(_asked(slices, buckets)), buckets, known, mix, floor)


def scored(docs: DataFrame, models: Models, *, leave_out: bool = False) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score``: mean losses per word in bits and their difference.

    Texts without words, NULL among them, have no losses and no score; repeated rows are scored each; an empty table gives no rows; other
    columns are not looked at. The frame the models were made of is scored from what was gathered then; any other asks the models' buckets.

    With ``leave_out`` each row of the frame the models were made of meets models without that row: its tokens, words and pairs are
    taken from the counts (of the target only where it is a target document), the vocabulary stays. Repeated rows and copies know
    each other. Other frames are in no count and are scored as without it.
    """
    slices, answers = models.slices, models.answers
    if docs is not models.docs:
        slices = _slices(docs.select("doc_id", "text", F.lit(False).alias("good")), models.known)
        answers = _answers(_asked(models.slices, models.buckets, asks=False).unionByName(_asked(slices, models.buckets, counted=False)))
    kinds, totals, mix, floor = models.kinds, models.totals, models.mix, models.floor
    leave_out = leave_out and docs is models.docs
    shape = docs.select("doc_id").schema.add("n_tokens", "long").add("target_loss", "double").add("background_loss", "double").add("score", "double")

    def score(of: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        ids = texts.column("docs").combine_chunks().flatten()
        keys, before, word, _, ends, at, lengths = _grams(*[texts.column(c)[0].as_py() for c in ("keys", "tokens", "lengths")])
        found = found.sort_by("bucket")
        words, pairs = (np.concatenate([np.zeros((n, 0), np.int64), *[_unpack(x, np.int64).reshape(n, -1) for x in found.column(c).to_pylist()]], axis=1)
                        for c, n in (("word_counts", 4), ("pair_counts", 2)))
        doc, n, means = np.repeat(np.arange(len(lengths)), lengths), lengths.astype(np.int64), []
        if leave_out:
            own = [_own(doc, x, k) for x, k in ((word, len(keys)), (before, len(keys)), (at, pairs.shape[1]))]
            inside = (_unpack(texts.column("good")[0].as_py(), np.uint8).astype(np.int64), np.ones_like(n))
            left = [totals[i] - inside[i] * n for i in (0, 1)]
            even = np.maximum(1, np.minimum(*left))
        for i in (0, 1):
            if leave_out:
                mine = inside[i][doc]
                counts = [x - mine * o for x, o in zip((words[i][word], words[2 + i][before], pairs[i][at]), own)]
                loss = _losses(*counts, left[i][doc], even[doc], kinds, mix, floor)
            else:
                loss = _losses(words[i][ends[1]], words[2 + i][ends[0]], pairs[i], totals[i], min(totals) or 1, kinds, mix, floor)[at]
            means.append(np.bincount(doc, weights=loss, minlength=len(n)) / np.maximum(n, 1))
        empty = n == 0
        columns = [pa.array(x, mask=empty) for x in (*means, means[0] - means[1])]
        return pa.table([ids, pa.array(n), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
    texts = slices.select("slice", "docs", "keys", "tokens", "lengths", "good")
    found = answers.filter("slice is not null").select("slice", "bucket", "word_counts", "pair_counts")
    return texts.groupBy("slice").cogroup(found.groupBy("slice")).applyInArrow(score, shape)
