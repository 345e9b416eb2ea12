"""Edit-aware token counts: a segment tree per document, so that an edit re-encodes only what it touches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulegauge.llm.common import batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of the byte-level tokenizers: a fixed value of the vocabulary files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 256

TREE = T.StructType().add("lengths", T.ArrayType(T.IntegerType())).add("tokens", T.ArrayType(T.IntegerType()))


def encoder(path: str, pattern: str):
    """``text -> number of tokens`` of a vocabulary file."""
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def is_cut(text: str, at: int) -> bool:
    """A blank between two characters that are not white always starts a pre-token, whatever stands around it."""
    return 0 < at < len(text) - 1 and text[at] == " " and not text[at - 1].isspace() and not text[at + 1].isspace()


def segments(text: str, size: int = LEAF) -> list[str]:
    """Runs of whole pre-tokens of about ``size`` characters; a stretch without a safe cut stays in one."""
    out, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at >= 0 and not is_cut(text, at):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    return [*out, text[start:]]


class Tree:
    """Sums over segments: node i has the children 2i and 2i + 1; leaves stand in the last half."""

    def __init__(self, lengths: list[int], tokens: list[int]):
        self.half = 1 << max(0, len(lengths) - 1).bit_length()
        self.lengths = [0] * self.half + lengths + [0] * (self.half - len(lengths))
        self.tokens = [0] * self.half + tokens + [0] * (self.half - len(tokens))
        for i in range(self.half - 1, 0, -1):
            self._add(i)

    def _add(self, i):
        self.lengths[i] = self.lengths[2 * i] + self.lengths[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the segment that holds the character ``at``; the end of the text is in the last one."""
        i, start = 1, 0
        at = min(at, self.lengths[1] - 1)
        while i < self.half:
            i *= 2
            if at >= start + self.lengths[i] and self.lengths[i + 1]:
                start += self.lengths[i]
                i += 1
        return i - self.half, start

    def put(self, leaf: int, length: int, tokens: int) -> None:
        i = leaf + self.half
        self.lengths[i], self.tokens[i] = length, tokens
        while i > 1:
            i //= 2
            self._add(i)


def edited(text: str, tree: Tree, at: int, remove: int, insert: str, count) -> tuple[str, int]:
    """The text after one edit, its tree brought up to date, and how many characters were encoded anew.

    The segments that the edit touches are encoded again, and one more on a side where the cut between segments may
    have lost its footing: the edit changed the characters that made it safe.
    """
    if not tree.lengths[1]:
        text = insert
        tree.put(0, len(text), count(text))
        return text, len(text)
    at = min(max(at, 0), len(text))
    remove = min(max(remove, 0), len(text) - at)
    first, start = tree.find(at)
    last, last_start = tree.find(max(at, at + remove - 1))
    end = last_start + tree.lengths[last + tree.half]
    new = text[:at] + insert + text[at + remove:]
    grown = len(insert) - remove
    while start > 0 and not is_cut(new, start):
        first, start = tree.find(start - 1)
    while end < len(text) and not is_cut(new, end + grown):
        last, after = tree.find(end)
        end = after + tree.lengths[last + tree.half]
    region = new[start:end + grown]
    places = last - first + 1
    pieces = segments(region, max(LEAF, -(-len(region) // places)))
    for leaf in range(first, last + 1):
        piece = pieces[leaf - first] if leaf - first < len(pieces) else ""
        tree.put(leaf, len(piece), count(piece))
    return new, len(region)


def _mapped(docs: DataFrame, kept: list[str], name: str, kind, work) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    arrow = to_arrow_type(kind)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        for batch in rows:
            for part in batches([batch]):
                values = [one(row) for row in part.to_pylist()]
                yield pa.record_batch([*[part.column(c) for c in kept], pa.array(values, arrow)], names=[*kept, name])
    return docs.mapInArrow(run, docs.select(*kept).schema.add(name, kind))


def with_trees(docs: DataFrame, *, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with a column ``tree``: characters and tokens of each segment of its text.

    NULL texts are empty. Trees are kept with the documents, a few bytes per segment; nothing is shuffled.
    """
    def work():
        count = encoder(path, pattern)

        def one(row):
            parts = segments(row["text"] or "")
            return {"lengths": [len(p) for p in parts], "tokens": [count(p) for p in parts]}
        return one
    return _mapped(docs, [c for c in docs.columns if c != "tree"], "tree", TREE, work)


COUNTS = T.StructType([T.StructField(name, T.LongType()) for name in ("before", "after", "encoded", "length")])


def recounted(docs: DataFrame, *, path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Columns of ``docs`` (text, tree, edits, ...) but those three, with ``counts``.

    Edits are applied in order: from character ``at`` (cut to the text), ``remove`` characters go and ``insert`` comes.
    NULL fields are 0 and nothing. ``counts``: tokens before and after, characters encoded anew by all edits, and the
    characters of the new text.
    """
    def work():
        count = encoder(path, pattern)

        def one(row):
            text, tree = row["text"] or "", Tree(row["tree"]["lengths"], row["tree"]["tokens"])
            before, encoded = tree.tokens[1], 0
            for edit in row["edits"] or []:
                text, n = edited(text, tree, edit["at"] or 0, edit["remove"] or 0, edit["insert"] or "", count)
                encoded += n
            return {"before": before, "after": tree.tokens[1], "encoded": encoded, "length": len(text)}
        return one
    return _mapped(docs, [c for c in docs.columns if c not in ("text", "tree", "edits")], "counts", COUNTS, work)
