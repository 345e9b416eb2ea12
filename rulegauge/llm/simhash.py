"""SimHash near-duplicates: fingerprints, and all pairs within a few bits by a self-join of a binary trie.

``simhash_components`` links fingerprints of 64 bits; ``near_copies`` and ``keep_one_similar`` link texts by the similarity of their
shingle sets, for which several short fingerprints name the candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulegauge.llm.common import batches, drop_stored, lists, numbered, scalar, short_lived_shuffles, stored, texts_of
from rulegauge.llm.components import components

BITS = 64


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Bits set in over half the hashes of the word shingles of a text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1:].tolist()
    hash64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash64(joined[s:e], seed) for s, e in zip(starts, ends)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, width: int = 4, seed: int = 42) -> DataFrame:
    """Adds ``_print`` (the fingerprint as a signed long) to the columns of ``docs`` but ``text``."""
    kept = [c for c in docs.columns if c not in ("text", "_print")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in batches([batch]):
                prints = np.array([fingerprint(t, width, seed) for t in texts_of(part.column("text"))], np.uint64)
                yield pa.record_batch([*[part.column(c) for c in kept], pa.array(prints.view(np.int64))], names=[*kept, "_print"])
    shape = docs.select(*kept).schema.add("_print", "long")
    return docs.select(*kept, "text").mapInArrow(run, shape)


# ---- the trie ----------------------------------------------------------------------------------------

def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j; ``root`` points at the smallest member."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low < high
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _ends(root: np.ndarray) -> np.ndarray:
    """Where the run of equal roots that holds a place ends."""
    cut = np.flatnonzero(root[1:] != root[:-1]) + 1
    at = np.searchsorted(cut, np.arange(len(root)), side="right")
    return np.append(cut, len(root))[at]


def trie_links(keys: np.ndarray, split: int, depth: int, differ: int, near: int, budget: int, half: int, *,
               exact: int = 0, small: int = 9, found: list | None = None) -> np.ndarray:
    """Smallest linked key (as a place) of each of the sorted unsigned ``keys``, by self-join of their binary trie.

    A node is a run of keys with a common prefix. The walk starts at the pair of runs [0, split) and [split, n), whose
    prefixes of ``depth`` bits differ in ``differ`` bits; split = 0 pairs the whole with itself. Node pairs go down
    together, a bit at a time; the bits that differ add up and a pair is dropped once they exceed ``half`` within the
    first 32 bits or ``budget`` in all. Small pairs of nodes are compared key by key. Neighbours in order are linked first, and pairs of nodes
    whose keys are linked already need no visit, so dense groups are not walked pair by pair. Pairs wait on a stack in slices
    of at most ``near``: memory does not grow with their number. No bit may differ within the first ``exact``; node pairs of at
    most ``small`` pairs of keys are compared key by key; ``found`` takes the places of the linked keys that joined two trees.
    """
    n, one = len(keys), np.uint64(1)
    root = np.arange(n)
    close = np.flatnonzero(np.bitwise_count(keys[1:] ^ keys[:-1]) <= budget)
    if found is not None:
        found.append((close, close + 1))
    _merge(root, close, close + 1)
    ends = _ends(root)
    start = (0, split, split, n) if split else (0, n, 0, n)
    stack = [(depth, *[np.array([x]) for x in start], np.array([differ]))]
    while stack:
        level, a, b, c, d, bits = stack.pop()
        if len(a) > near:
            stack += [(level, *[x[at:at + near] for x in (a, b, c, d, bits)]) for at in range(0, len(a), near)]
            continue
        known = (root[a] == root[c]) & (ends[a] >= b) & (ends[c] >= d)
        few = ((b - a) * (d - c) <= small) | (level >= BITS)
        take = few & ~known
        if take.any():
            rows, columns = (b - a)[take], (d - c)[take]
            size = rows * columns
            within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i = np.repeat(a[take], size) + within // np.repeat(columns, size)
            j = np.repeat(c[take], size) + within % np.repeat(columns, size)
            linked = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (root[i] != root[j])
            if linked.any():
                if found is not None:
                    found.append((i[linked], j[linked]))
                _merge(root, i[linked], j[linked])
                ends = _ends(root)
        go = ~few & ~known
        if not go.any():
            continue
        a, b, c, d, bits = a[go], b[go], c[go], d[go], bits[go]
        shift = np.uint64(BITS - 1 - level)
        left = np.searchsorted(keys, ((keys[a] >> shift) | one) << shift)
        right = np.searchsorted(keys, ((keys[c] >> shift) | one) << shift)
        left, right = np.clip(left, a, b), np.clip(right, c, d)
        most = 0 if level < exact else half if level < BITS // 2 else budget
        twins, more = a == c, bits + 1 <= most
        new = [(a, left, c, right, bits, None), (left, b, right, d, bits, None),
               (a, left, right, d, bits + 1, more), (left, b, c, right, bits + 1, more & ~twins)]
        joined = []
        for w, x, y, z, count, allowed in new:
            alive = (w < x) & (y < z) & ((w != y) | (x - w > 1))
            joined.append([v[alive if allowed is None else alive & allowed] for v in (w, x, y, z, count)])
        stack.append((level + 1, *[np.concatenate(v) for v in zip(*joined)]))
    return root


def _masks(depth: int, most: int) -> list[int]:
    return [m for m in range(1 << depth) if m.bit_count() <= most]


def _turned(keys: np.ndarray, turn: int) -> np.ndarray:
    return keys if not turn else (keys << np.uint64(32)) | (keys >> np.uint64(32))


def links(prints: DataFrame, *, budget: int = 4, depth: int = 6) -> DataFrame:
    """Edges ``a, b`` that connect all distinct ``_print`` of ``prints`` within ``budget`` bits, not all such pairs.

    Two prints within the budget differ in at most half of it in the first 32 bits, or in fewer than the rest in the
    last 32: the trie is walked in both bit orders, each with a small budget for its first half. Pairs of subtries of
    ``depth`` bits within the budget are the tasks; a subtrie goes to the pairs it is part of. Copies share a print, and
    a group of near copies has no more prints than the Hamming ball around them holds, so no subtrie grows with copies.
    """
    distinct = prints.select("_print").distinct()
    orders = [(0, budget // 2), (1, budget - budget // 2 - 1)]
    sent = None
    for turn, most in orders:
        if most < 0:
            continue
        key = F.col("_print") if not turn else F.shiftleft("_print", 32).bitwiseOR(F.shiftrightunsigned("_print", 32))
        masks = F.array(*[F.lit(m) for m in _masks(depth, most)])
        one = distinct.select(key.alias("key"), F.explode(masks).alias("mask")).withColumn(
            "node", F.shiftrightunsigned("key", BITS - depth).cast("int"))
        one = one.select("key", F.struct(F.lit(turn).alias("turn"), F.lit(most).alias("most"), "mask",
                                         F.least("node", F.col("node").bitwiseXOR(F.col("mask"))).alias("node")).alias("task"))
        sent = one if sent is None else sent.unionByName(one)

    def walk(task: tuple, table: pa.Table) -> pa.Table:
        turn, most, mask, node = (task[0].as_py()[k] for k in ("turn", "most", "mask", "node"))
        keys = np.sort(table.column("key").to_numpy().view(np.uint64))
        split = int(np.searchsorted(keys >> np.uint64(BITS - depth), node, side="right")) if mask else 0
        if len(keys) < 2 or mask and split in (0, len(keys)):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        root = trie_links(keys, split, depth, mask.bit_count(), 1 << 17, budget, most)
        hit = np.flatnonzero(root != np.arange(len(keys)))
        keys = _turned(keys, turn).view(np.int64)
        return pa.table({"a": keys[hit], "b": keys[root[hit]]})
    return sent.groupBy("task").applyInArrow(walk, "a bigint, b bigint")


def classes(prints: DataFrame, **how) -> DataFrame:
    """``_print, root`` for every distinct print of ``prints``: the smallest print of its component."""
    stars = components(links(prints, **how))
    return (prints.select("_print").distinct().join(stars, F.col("_print") == F.col("node"), "left")
            .select("_print", F.coalesce("root", "_print").alias("root")))


def simhash_components(docs: DataFrame, *, width: int = 4, seed: int = 42, budget: int = 4, depth: int = 6) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    NULL and empty texts have the fingerprint zero and are linked like any other. Repeated rows and ids are rows of
    their own; NULL ids are never a component's id unless it has no other. An empty table gives no rows. Other columns
    are not looked at.
    """
    prints = stored(fingerprints(docs.select("doc_id", "text"), width=width, seed=seed), "prints")
    roots = stored(classes(prints, budget=budget, depth=depth), "roots")
    least = stored(prints.groupBy("_print").agg(F.min("doc_id").alias("_least")), "least")
    ids = roots.join(least, "_print").groupBy("root").agg(F.min("_least").alias("component_id"))
    named = stored(roots.join(ids, "root").select("_print", "component_id"), "components")
    return prints.join(named, "_print").select(
        "doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, width: int = 4, seed: int = 42, budget: int = 4, depth: int = 6) -> DataFrame:
    """The document with the smallest id of every component, all columns kept; equal ids: the first row as stored."""
    rows = stored(numbered(docs.drop("_row")), "docs")
    prints = stored(fingerprints(rows.select("_row", "doc_id", "text"), width=width, seed=seed), "prints")
    roots = stored(classes(prints, budget=budget, depth=depth), "roots")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    by_print = stored(prints.groupBy("_print").agg(F.min(first).alias("first")), "first")
    best = roots.join(by_print, "_print").groupBy("root").agg(F.min("first").alias("first"))
    kept = stored(best.select(F.col("first._row").alias("_row")), "kept")
    # as many ids as documents stay: the join is the same at every size, not a broadcast while they are few
    return rows.join(kept.hint("merge"), "_row", "left_semi").select(*[c for c in docs.columns if c != "_row"])


# ---- near copies by similarity -----------------------------------------------------------------------

#: 64-bit words of a signature. Its 32-bit parts are the short fingerprints; where they are walked, the three pieces of
#: a part that take turns in front, as (turn, bits).
_WORDS = 10
_PIECES = ((0, 11), (11, 11), (22, 10))
#: Bits that may differ in a short fingerprint, and in it and the next one together.
_PART, _BOTH = 2, 11
#: Short fingerprints whose keys are sent at once, and most bits of the filter of rows whose texts are compared.
_TURN, _FILTER = 5, 1 << 26
#: Keys of a trie walked by one task, and pairs of keys compared at once.
_KEYS, _SMALL = 1 << 16, 256


def shingles(text: bytes, width: int = 5, seed: int = 42) -> tuple[bytes, np.ndarray]:
    """The words of a text, lower-cased and joined by spaces, and the sorted distinct hashes of its word shingles; fewer words are one
    shingle, no words none."""
    words = text.lower().split()
    joined = b" ".join(words)
    if not words:
        return joined, np.zeros(0, np.uint64)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1:].tolist()
    hash64 = xxhash.xxh64_intdigest
    return joined, np.unique(np.fromiter((hash64(joined[s:e], seed) for s, e in zip(starts, ends)), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    """``_WORDS`` SimHash words of a set of hashes: bits set in over half of the values mixed from each."""
    ones, n = np.zeros(_WORDS * BITS, np.int64), len(hashes)
    salts = np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, 255):
        mixed = hashes[at:at + 255, None] + salts
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def _signatures(rows: DataFrame, width: int, seed: int) -> DataFrame:
    """``_row, doc_id, _copy, _bits`` of ``rows``: 128 bits that equal word sequences share, and the signature."""
    shape = rows.select("_row", "doc_id").schema.add("_copy", "binary").add("_bits", T.ArrayType(T.LongType()))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in batches([batch]):
                copies, bits = [], []
                for text in texts_of(part.column("text")):
                    joined, hashes = shingles(text, width, seed)
                    copies.append(xxhash.xxh3_128_digest(joined))
                    bits.append(signature(hashes))
                flat = np.concatenate([np.zeros(0, np.uint64), *bits]).view(np.int64)
                yield pa.record_batch([part.column("_row"), part.column("doc_id"), pa.array(copies, pa.binary()),
                                       lists(flat, [_WORDS] * len(bits), pa.int64())], names=shape.names)
    return rows.select("_row", "doc_id", "text").mapInArrow(run, shape)


def _candidates(signed: DataFrame, depth: int, most: int, prints: range) -> DataFrame:
    """``a, b, differ`` of rows of ``signed`` (_row, _bits): in the trie of each of the short fingerprints ``prints``, a forest over
    those within ``_PART`` bits that also differ in at most ``_BOTH`` bits with the next fingerprint; of its edges those whose
    signatures differ in at most ``most`` bits.

    Of three pieces of a fingerprint one is equal in both: each takes its turn in front, and tries are cut into tasks by their
    first ``depth`` bits, where nothing may differ. Signatures travel with the keys, so edges that they rule out never leave the
    task: a group of similar texts below the limit has some in every trie.
    """
    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if not part.num_rows:
                    continue
                words = np.ascontiguousarray(part.column("_bits").flatten().to_numpy())
                signs = pa.Array.from_buffers(pa.binary(8 * _WORDS), part.num_rows, [None, pa.py_buffer(words)]).cast(pa.binary())
                flat = words.view(np.uint32).reshape(part.num_rows, -1).astype(np.uint64)
                after = np.roll(flat, -1, axis=1)
                for t in prints:
                    for o, (turn, _) in enumerate(_PIECES):
                        turned = (flat[:, t] << np.uint64(turn) | flat[:, t] >> np.uint64(32 - turn)) & np.uint64(0xFFFFFFFF)
                        key = (turned << np.uint64(32) | after[:, t]).view(np.int64)
                        task = (t * len(_PIECES) + o << depth) + (turned >> np.uint64(32 - depth)).astype(np.int64)
                        yield pa.record_batch([pa.array(task.astype(np.int32)), pa.array(key), part.column("_row"), signs],
                                              names=["task", "key", "_row", "sign"])

    def walk(task: tuple, table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys, ids, found = keys[order], table.column("_row").to_numpy()[order], []
        exact = _PIECES[(task[0].as_py() >> depth) % len(_PIECES)][1]
        if len(keys) > 1:
            trie_links(keys, 0, depth, 0, (1 << 20) // _SMALL, _BOTH, _PART, exact=exact, small=_SMALL, found=found)
        i, j = (np.concatenate([np.zeros(0, np.int64), *[pair[k] for pair in found]]) for k in (0, 1))
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint64).reshape(-1, _WORDS)
        differ = np.zeros(len(i), np.int64)
        for word in range(_WORDS):
            differ += np.bitwise_count(signs[order[i], word] ^ signs[order[j], word])
        near = differ <= most
        a, b = ids[i[near]], ids[j[near]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "differ": differ[near]})
    sent = signed.select("_row", "_bits").mapInArrow(send, "task int, key bigint, _row bigint, sign binary")
    return sent.groupBy("task").applyInArrow(walk, "a bigint, b bigint, differ bigint").distinct()


def _bits_at(similarity: float) -> int:
    """Bits of two signatures that differ on average where sets of one size have this similarity."""
    return round(_WORDS * BITS * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _with_both(edges: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """``edges`` with column ``name`` of ``of`` (_row, name) for both ends, as ``name_a`` and ``name_b``."""
    for end in ("a", "b"):
        edges = edges.join(of.select(F.col("_row").alias(end), F.col(name).alias(f"{name}_{end}")), end)
    return edges


def _sets(texts: DataFrame, ends: DataFrame, width: int, seed: int) -> DataFrame:
    """``_row, _set`` (sorted hashes of the shingles) of the rows of ``texts`` named in ``ends``, and of a few more.

    A filter of the names, a bit each in at most ``_FILTER`` bits, goes to the texts: those not asked for are not shuffled.
    """
    most = scalar(ends.agg(F.count(F.lit(1))))[0]
    size = min(_FILTER, 1 << max(15, (16 * most).bit_length()))
    bit = F.xxhash64("_row").bitwiseAND(F.lit(size - 1))
    asked = ends.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    known = np.zeros(size >> 3, np.uint8)
    with short_lived_shuffles(ends.sparkSession):
        for at, bits in asked.collect():
            known[(at - 1) * len(bits):at * len(bits)] = np.frombuffer(bits, np.uint8)
    known = ends.sparkSession.sparkContext.broadcast(known)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            bits = batch.column("_bit").to_numpy()
            batch = batch.filter(pa.array((known.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1))
            for part in batches([batch], 4 << 20):
                found = [shingles(text, width, seed)[1].view(np.int64) for text in texts_of(part.column("text"))]
                flat = np.concatenate([np.zeros(0, np.int64), *found])
                yield pa.record_batch([part.column("_row"), lists(flat, [len(f) for f in found], pa.int64())], names=["_row", "_set"])
    return texts.select("_row", bit.alias("_bit"), "text").mapInArrow(run, "_row bigint, _set array<bigint>")


def near_copies(texts: DataFrame, signed: DataFrame, *, width: int = 5, seed: int = 42, similarity: float = 0.8,
                lower: float = 0.7, sure: float = 0.9) -> DataFrame:
    """``node, root`` (stored) of the rows of ``signed`` (_row, _bits; stored) that have near copies there; ``texts`` holds their _row, text.

    Candidates whose signatures tell a similarity below ``lower`` are dropped, from ``sure`` on they are linked; those between,
    unless sure links connect them already, are linked if the exact similarity of their shingle sets is ``similarity`` or more.
    """
    depth = min(10, max(0, math.ceil(math.log2(max(1, scalar(signed.agg(F.count(F.lit(1))))[0]) / _KEYS))))
    # some fingerprints at a time: what is sent for them is freed before the next are
    turns = [stored(_candidates(signed, depth, _bits_at(lower), range(t, min(t + _TURN, 2 * _WORDS))), "candidates")
             for t in range(0, 2 * _WORDS, _TURN)]
    told = turns[0]
    for turn in turns[1:]:
        told = told.unionByName(turn)
    told = stored(told.distinct(), "told")
    drop_stored(*turns)
    linked = stored(components(told.filter(F.col("differ") <= _bits_at(sure))), "linked")
    open_ = told.filter(F.col("differ") > _bits_at(sure)).select("a", "b")
    for end in ("a", "b"):
        known = linked.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        open_ = open_.join(known, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    open_ = stored(open_.filter("root_a != root_b").select("a", "b"), "open")
    ends = open_.select(F.col("a").alias("_row")).unionByName(open_.select(F.col("b").alias("_row"))).distinct()
    held = stored(_sets(texts, ends, width, seed), "sets")
    common = F.size(F.array_intersect("_set_a", "_set_b"))
    proven = _with_both(open_, held, "_set").withColumn("common", common).filter(
        F.col("common") >= similarity * (F.size("_set_a") + F.size("_set_b") - F.col("common"))).select("a", "b")
    roots = stored(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(proven)), "roots")
    drop_stored(told, linked, open_, held)
    return roots


def keep_one_similar(docs: DataFrame, *, width: int = 5, seed: int = 42, similarity: float = 0.8) -> DataFrame:
    """The document with the smallest id of every group of near copies, all columns kept; equal ids: the first row as stored.

    Groups are connected by pairs of texts whose sets of ``width``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``similarity`` or more. Texts of the same words are one text: NULL, empty and blank ones are copies of each other, and repeated
    rows go. A pair at 0.8 is found with a chance of 0.9, nearer ones with more; groups need one path of found pairs. A NULL id
    stays only where the group has no other. An empty table gives no rows; extra columns are carried along, whatever their names.
    """
    own = "_row"
    while own in docs.columns:
        own += "_"
    rows = stored(numbered(docs, own), "docs")
    known = rows.select(F.col(own).alias("_row"), "doc_id", "text")
    prints = stored(_signatures(known, width, seed), "prints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "_bits")
    texts = stored(prints.groupBy("_copy").agg(F.min(first).alias("first")).select("first.*"), "texts")
    drop_stored(prints)
    roots = near_copies(known, texts, width=width, seed=seed, similarity=similarity)
    best = texts.join(roots, F.col("_row") == F.col("node"), "left").groupBy(F.coalesce("root", "_row").alias("root")).agg(
        F.min(F.struct("none", "doc_id", "_row")).alias("first"))
    kept = stored(best.select(F.col("first._row").alias(own)), "kept")
    drop_stored(texts, roots)
    # as many ids as documents stay: the join is the same at every size, not a broadcast while they are few
    return rows.join(kept.hint("merge"), own, "left_semi").select(*docs.columns)
