"""Substring removal by prefix-partitioned suffix trees, over the words of whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulegauge.llm.common import batches, texts_of
from rulegauge.llm.repeats import repeated_spans, word_units
from rulegauge.llm.suffix_array import covered


def deep_nodes(units: list[np.ndarray], group: np.ndarray, least: np.ndarray, depth: int) -> np.ndarray:
    """The smallest ``least`` below the node of ``depth`` words that each window leads to, for all windows in turn.

    The suffixes of a group share a prefix and make up one subtree. In sorted order two neighbours meet at the node whose depth is
    their common prefix; a run of neighbours that meet at ``depth`` or deeper hangs below one internal node, and its label is a
    repeat. Suffixes are followed down to ``depth`` words and no further.
    """
    counts = np.array([len(u) - depth + 1 for u in units], np.int64)
    ends = np.cumsum(counts)
    words = np.concatenate(units)
    begin = np.cumsum([0, *[len(u) for u in units[:-1]]])
    place = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(begin, counts)
    group, least = np.repeat(group, counts), np.repeat(least, counts)
    order = np.lexsort([*[words[place + i] for i in range(depth - 1, -1, -1)], group])
    place, group = place[order], group[order]
    common = np.zeros(max(0, len(place) - 1), np.int64)
    alike = group[1:] == group[:-1]
    for i in range(depth):
        alike &= words[place[1:] + i] == words[place[:-1] + i]
        common += alike
    first = np.concatenate([[0], np.flatnonzero(common < depth) + 1])
    below = np.minimum.reduceat(least[order], first)
    out = np.empty(len(place), np.int64)
    out[order] = np.repeat(below, np.diff(np.append(first, len(place))))
    return out


def removed(docs: DataFrame, *, width: int = 13, gram: int = 5, limit: int = 20_000, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``texts``, ``kept`` of every document.

    Each word inside a window of ``width`` words that also starts in a document with a smaller id is removed; windows
    are judged on the input. ``kept`` are the remaining words, joined by one space. NULL and empty texts have no words. A NULL id is larger than any;
    documents with the same id do not touch each other; an empty table gives no rows; other columns are not looked at.
    """
    def compare(units, group, least):
        return None, deep_nodes(units, group, least, width)
    rows, spans = repeated_spans(docs, units=word_units, width=width, gram=gram, earlier=True, compare=compare, limit=limit)

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in batches([batch]):
                out = []
                for text, hits in zip(texts_of(part.column("text")), part.column("spans").to_pylist()):
                    words = text.split()
                    gone = covered(hits, width, len(words))
                    kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if hits else words)
                    out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
                sizes, removed_, shas, kept_texts = zip(*out) if out else [()] * 4
                yield pa.record_batch([part.column("doc_id"), *[pa.array(x, pa.int64()) for x in (sizes, removed_)],
                                       *[pa.array(x, pa.string()) for x in (shas, kept_texts)]],
                                      names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    shape = rows.select("doc_id").schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept", "string")):
        shape = shape.add(name, kind)
    return rows.join(spans, "_row", "left").select("doc_id", "text", "spans").mapInArrow(cut, shape).drop(*[] if texts else ["kept"])
