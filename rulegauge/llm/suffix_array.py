"""Substring removal by a depth-limited radix sort of suffixes, over the UTF-8 bytes of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulegauge.llm.common import batches, texts_of
from rulegauge.llm.repeats import Sums, byte_units, repeated_spans, tokens_of


def equal_groups(units: list[np.ndarray], group: np.ndarray, width: int, digits: int = 4) -> np.ndarray:
    """Which windows of ``width`` tokens equal another of their group: flags over all windows of all ``units`` in turn.

    Suffixes are ordered through ``width`` tokens only, most significant digit first; a digit is the hash of a slice of
    tokens. Each pass splits the groups by the next digit and drops those of one suffix, so a pass looks at what is
    still equal to something. Groups left after the last digit are exactly the repeated windows.
    """
    counts = np.array([len(u) - width + 1 for u in units], np.int64)
    ends = np.cumsum(counts)
    sums = Sums(tokens_of(np.concatenate(units)))
    ids = np.arange(ends[-1])
    begin = np.cumsum([0, *[len(u) for u in units[:-1]]])
    place = ids - np.repeat(ends - counts, counts) + np.repeat(begin, counts)
    _, owner = np.unique(group, return_inverse=True)
    owner = np.repeat(owner, counts)
    edges = np.linspace(0, width, digits + 1).astype(int)
    for low, high in zip(edges[:-1], edges[1:]):
        digit = sums.at(place + low, int(high - low))
        order = np.lexsort((digit, owner))
        ids, place, owner, digit = ids[order], place[order], owner[order], digit[order]
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (digit[1:] != digit[:-1])]) if len(ids) else np.array([], bool)
        owner = np.cumsum(new)
        several = np.bincount(owner, minlength=1)[owner] > 1 if len(ids) else new
        ids, place, owner = ids[several], place[several], owner[several]
        if not len(ids):
            break
    flags = np.zeros(ends[-1], bool)
    flags[ids] = True
    return flags


def covered(spans: list[dict] | None, width: int, n: int) -> np.ndarray:
    """Flags of the tokens inside the windows that ``spans`` name."""
    change = np.zeros(n + 1, np.int64)
    if spans:
        low = np.array([s["low"] for s in spans])
        high = np.array([s["high"] for s in spans]) - 1 + width
        np.add.at(change, low, 1)
        np.add.at(change, high, -1)
    return np.cumsum(change[:n]) > 0


def removed(docs: DataFrame, *, width: int = 200, gram: int = 100, limit: int = 20_000, texts: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, ``kept`` of every document.

    Each byte inside a string of ``width`` bytes that also starts anywhere else, in the same document or another, is
    removed; strings are judged on the input. ``kept`` are the remaining bytes. NULL and empty texts have no bytes; equal rows are
    copies of each other, whatever their ids; an empty table gives no rows; other columns are not looked at.
    """
    def compare(units, group, least):
        return equal_groups(units, group, width), np.zeros(sum(len(u) - width + 1 for u in units), np.int64)
    rows, spans = repeated_spans(docs, units=byte_units, width=width, gram=gram, earlier=False, compare=compare, limit=limit)

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in batches([batch]):
                out, kept = [], []
                for text, hits in zip(texts_of(part.column("text")), part.column("spans").to_pylist()):
                    gone = covered(hits, width, len(text))
                    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    out.append((len(text), int(gone.sum()), starts, hashlib.sha256(rest).hexdigest()))
                    kept.append(rest if texts else None)
                sizes, removed_, starts, shas = zip(*out) if out else [()] * 4
                yield pa.record_batch([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed_, starts)],
                                       pa.array(shas, pa.string()), pa.array(kept, pa.binary())],
                                      names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    shape = rows.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        shape = shape.add(name, kind)
    return rows.join(spans, "_row", "left").select("doc_id", "text", "spans").mapInArrow(cut, shape).drop(*[] if texts else ["kept"])
