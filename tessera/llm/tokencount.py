"""Edit-aware token counts: a segment tree of pre-token counts per document, kept and updated where edits touch.

A document's text is cut into segments that end where the pre-tokeniser certainly cuts: before a space
that follows a non-space and precedes a letter, digit or mark. Encoding segments apart therefore gives
the tokens of the whole. Leaves hold the segments' characters and token counts, inner nodes the sums; the
tree is a column beside the text (``build_trees``). An edit (``apply_edits``) re-encodes the segments it
touches, with the neighbours on both sides as context, puts what comes of them into the same leaves, and adds
the differences to the sums on the paths to the root. Leaves may be empty, or hold several segments; only an
edit that makes far more segments than it touched builds the sums anew, from counts that are known.

Null texts count as empty and have no tokens; edits of them insert only. Edit positions are code points
of the original text, ends exclusive; positions beyond the end are cut to it, and overlapping edits are
applied in order, the later one to what the earlier left. A document without edits keeps its count; a null
tree is built first. Repeated rows are counted each on its own, an empty table gives no rows, and very long
texts have deeper trees: an edit of one costs no more than its segments and the tree's depth. A column of
the input that bears the name of an output column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tessera.llm.packing import encode, load_encoder
from tessera.llm.text import append_columns

#: A cut before one space between a letter or digit and a letter; the pre-tokeniser always cuts there.
_CUT = re.compile(r"(?<=[^\W_])(?= [^\W\d_])")
#: Pre-tokens are gathered to segments of at least so many characters.
SEGMENT = 64


def segments(text: str, least: int = SEGMENT) -> list[str]:
    """The text in pieces that end at sure cuts, each of ``least`` characters or more but the last."""
    out, at = [], 0
    n = len(text)
    while n - at > least:
        m = _CUT.search(text, at + least)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < n:
        out.append(text[at:])
    return out


class CountTree:
    """Token and character counts of one text's segments, with sums over blocks of segments in a binary tree.

    ``sums`` are the two trees as arrays: node k has the children 2k and 2k + 1, and the leaves come last.
    """

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], sums: tuple[np.ndarray, np.ndarray] | None = None, least: int = SEGMENT):
        self.count, self.least, self.encoded = count, least, 0
        if sums is None:
            self.parts = segments(text, least)
            self._build(self._counts(self.parts))
            return
        self.tokens, self.chars = (np.array(x, dtype=np.int64) for x in sums)
        self.size = len(self.tokens) // 2
        ends = np.cumsum(self.chars[self.size :]).tolist()
        self.parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        while self.parts and not self.parts[-1]:
            self.parts.pop()

    def _counts(self, parts: list[str]) -> list[int]:
        self.encoded += sum(map(len, parts))
        return self.count(parts)

    def _build(self, leaves: list[int]) -> None:
        size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.size = size
        self.tokens = np.zeros(2 * size, dtype=np.int64)
        self.chars = np.zeros(2 * size, dtype=np.int64)
        self.tokens[size : size + len(leaves)] = leaves
        self.chars[size : size + len(leaves)] = [len(p) for p in self.parts]
        width = size
        while width > 1:
            for sums in (self.tokens, self.chars):
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(axis=1)
            width //= 2

    @property
    def total(self) -> int:
        """Tokens of the whole text: the root's sum."""
        return int(self.tokens[1])

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The segment that holds a character, and where it starts; found by walking down from the root."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, tokens: int, chars: int) -> None:
        node = leaf + self.size
        more, longer = tokens - self.tokens[node], chars - self.chars[node]
        while node:
            self.tokens[node] += more
            self.chars[node] += longer
            node //= 2

    def _neighbour(self, leaf: int, step: int) -> int | None:
        """The next leaf that is not empty, in one direction."""
        leaf += step
        while 0 <= leaf < len(self.parts) and not self.parts[leaf]:
            leaf += step
        return leaf if 0 <= leaf < len(self.parts) else None

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of the characters from start to end."""
        n = int(self.chars[1])
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if not n:
            self.parts = segments(new, self.least)
            self._build(self._counts(self.parts))
            return
        first, begin = self.leaf_at(start)
        last, _ = self.leaf_at(max(start, end - 1))
        before, after = self._neighbour(first, -1), self._neighbour(last, 1)
        if before is not None:  # the segment before is context: the edit may undo the cut between them
            first = before
            begin -= len(self.parts[first])
        last = last if after is None else after
        old = "".join(self.parts[first : last + 1])
        fresh = segments(old[: start - begin] + new + old[end - begin :], self.least)
        counts = self._counts(fresh)
        slots = last - first + 1
        if len(fresh) > 8 * slots:  # many new segments: leaves of their own, with the counts known for all
            leaves = self.tokens[self.size : self.size + len(self.parts)].tolist()
            self.parts[first : last + 1] = fresh
            self._build(leaves[:first] + counts + leaves[last + 1 :])
            return
        for k in range(slots):
            own = slice(k, k + 1) if k + 1 < slots else slice(k, None)  # the last leaf takes what is left
            part = "".join(fresh[own])
            self.parts[first + k] = part
            self._set(first + k, sum(counts[own]), len(part))


EDIT = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("new", T.StringType())])
TREE = T.StructType([T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("chars", T.ArrayType(T.LongType()))])
_TREE = pa.struct([("tokens", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64()))])
FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_tokens_after", T.LongType()),
    T.StructField("chars_encoded", T.LongType()),
    T.StructField("text_after", T.StringType()),
    T.StructField("tree_after", TREE),
]


class _Counter:
    """Counts tokens; the encoder is loaded once a task."""

    def __init__(self, vocabulary: str | None):
        self.vocabulary, self.encoder = vocabulary, None

    def __call__(self, parts: list[str]) -> list[int]:
        if self.encoder is None:
            self.encoder = load_encoder(self.vocabulary)
        return [len(encode(self.encoder, p)) for p in parts]


def _arrays(tree: CountTree) -> dict[str, np.ndarray]:
    return {"tokens": tree.tokens, "chars": tree.chars}


def build_trees(docs: DataFrame, *, text: str = "text", out: str = "tree", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the column ``out``: each text's tree of token and character counts."""
    count = _Counter(vocabulary)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_arrays(CountTree(v.as_py() or "", count)) for v in batch.column(batch.schema.get_field_index(text))], _TREE)]

    return append_columns(docs, [T.StructField(out, TREE)], compute, needs=[text])


def apply_edits(docs: DataFrame, *, text: str = "text", tree: str = "tree", edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with token counts before and after its edits, the characters encoded for them, and the text and tree after.

    ``edits`` is an array of (start, end, new), positions in the original text; ``tree`` is what build_trees or
    an earlier call gave for the text.
    """
    count = _Counter(vocabulary)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        columns = (batch.column(batch.schema.get_field_index(c)) for c in (text, tree, edits))
        for value, known, changes in zip(*columns, strict=True):
            sums = None if not known.is_valid else tuple(known[c].values.to_numpy(zero_copy_only=False) for c in ("tokens", "chars"))
            own = CountTree(value.as_py() or "", count, sums)
            own.encoded, before, shift = 0, own.total, 0
            for e in sorted((e for e in changes.as_py() or [] if e is not None), key=lambda e: (e["start"] or 0, e["end"] or 0)):
                size = int(own.chars[1])
                own.replace((e["start"] or 0) + shift, (e["end"] or 0) + shift, e["new"] or "")
                shift += int(own.chars[1]) - size
            rows.append((before, own.total, own.encoded, own.text, _arrays(own)))
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), _TREE))]

    return append_columns(docs, FIELDS, compute, needs=[text, tree, edits])


def count_edits(docs: DataFrame, *, text: str = "text", edits: str = "edits", vocabulary: str | None = None) -> DataFrame:
    """build_trees and apply_edits in one pass, for texts whose trees are not kept."""
    return apply_edits(build_trees(docs, text=text, out="__tree", vocabulary=vocabulary), text=text, tree="__tree", edits=edits, vocabulary=vocabulary).drop("__tree")
