"""Benchmark decontamination: one FM-index per training shard, searched for all test phrases.

A shard is the words of some consecutive documents of one Arrow batch. Words that no test phrase has
are separators of the index; since a phrase cannot cross them, search stays exact. Words are compared
as words (their bytes; beyond 16 bytes a 128-bit digest), not by a 64-bit hash. Documents never move: a
task indexes and searches what it reads.

Null texts have no words. A test item without an id counts under the id ``null``. Empty tables give empty
results. A column of ``docs`` that bears the name of an output column is replaced. Repeated documents and
repeated ids are judged row by row. A very long text makes shards of its own, which overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.fm import FMIndex
from tessera.llm.text import ALNUM_WORD, Words, append_columns, slices, utf8, words
from tessera.session import stage

#: Words of a window; a shorter test item is one window.
WINDOW = 13
#: Test phrases of more bytes than this are searched block by block. A Python worker needs about 40 times a
#: block's bytes to hold its phrases.
BLOCK_BYTES = 8 << 20
#: Windows that are searched at a time.
SEARCHED = 1 << 15
#: Bytes of text in a shard; a longer document is a shard of its own, or several.
SHARD_BYTES = 2 << 20

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(SPAN)),
]


class Phrases:
    """All distinct windows of some test items, and the items of each window.

    A window is a place in the items' symbol sequence and a length; its symbols are only laid out when it is
    searched, so that memory stays in proportion to the items.
    """

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        data, offsets = utf8(pa.array([t for _, t in items], pa.large_string()))
        w = words(data, offsets, ALNUM_WORD)
        length = (w.ends - w.starts).astype(np.int64)
        # the vocabulary, in the order of hashes; different words of one hash lie next to each other
        order = np.lexsort((length, w.high, w.low, w.hashes))
        same = np.zeros(len(order), dtype=bool)
        for x in (w.hashes, w.low, w.high, length):
            same[1:] |= x[order][1:] != x[order][:-1]
        same[:1] = True
        kind = np.cumsum(same) - 1
        firsts = order[same]
        self.vocabulary = (w.hashes[firsts], w.low[firsts], w.high[firsts], length[firsts])
        self.most_alike = int(np.unique(self.vocabulary[0], return_counts=True)[1].max(initial=1))
        self.symbols = np.empty(len(order), dtype=np.int32)
        self.symbols[order] = kind + 1
        counts = np.diff(w.first)
        per = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        item = np.repeat(np.arange(len(items)), per)
        starts = w.first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(per) - per, per)
        lengths = np.minimum(counts, window)[item]
        self.width = window
        # equal windows are one: sorted by what they contain, last symbol first
        keys = self._matrix(starts, lengths)
        order = np.lexsort((*keys.T, lengths)) if len(starts) else np.zeros(0, dtype=np.int64)
        fresh = np.ones(len(order), dtype=bool)
        if len(order):
            fresh[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        del keys
        which = np.cumsum(fresh) - 1
        self.starts, self.lengths = starts[order[fresh]], lengths[order[fresh]]
        owner = np.array([number[i] for i, _ in items], dtype=np.int64)[item][order]
        pairs = np.unique(which * (len(self.names) + 1) + owner)
        self.item = pairs % (len(self.names) + 1)
        self.item_first = np.searchsorted(pairs // (len(self.names) + 1), np.arange(len(self.starts) + 1))

    def _matrix(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols of windows, right-aligned, 0 before them."""
        out = np.zeros((len(starts), self.width), dtype=np.int32)
        for k in range(self.width):
            own = lengths > k
            out[own, self.width - 1 - k] = self.symbols[starts[own] + lengths[own] - 1 - k]
        return out

    def translate(self, w: Words) -> np.ndarray:
        """The symbols of a text's words; 0 for words that no item has."""
        hashes, low, high, length = self.vocabulary
        out = np.zeros(len(w.hashes), dtype=np.int64)
        if not len(hashes):
            return out
        at = np.searchsorted(hashes, w.hashes)
        for _ in range(self.most_alike):
            here = np.minimum(at, len(hashes) - 1)
            alike = (hashes[here] == w.hashes) & (low[here] == w.low) & (high[here] == w.high) & (length[here] == w.ends - w.starts)
            out[alike] = here[alike] + 1
            at = at + 1
        return out

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Windows some at a time: the first one's number, their symbols and their lengths."""
        for a in range(0, len(self.starts), SEARCHED):
            own = slice(a, a + SEARCHED)
            yield a, self._matrix(self.starts[own], self.lengths[own]).astype(np.int64), self.lengths[own]


def _occurrences(symbols: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which windows begin, and the windows, over shards of one word sequence."""
    starts, found = [], []
    step = FMIndex.MOST - phrases.width
    for at in range(0, len(symbols), step):
        part = symbols[at : at + step + phrases.width - 1]
        text = np.append(part, 0)
        keep = np.ones(len(text), dtype=bool)
        keep[1:] = (text[1:] != 0) | (text[:-1] != 0)  # a run of foreign words is one separator
        place = np.flatnonzero(keep)
        index = FMIndex(text[keep], len(phrases.vocabulary[0]) + 1)
        for base, patterns, lengths in phrases.blocks():
            which, low, high = index.search(patterns, lengths)
            count = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
            where = place[index.locate(rows)]
            which = np.repeat(which + base, count)
            own = where < step  # what begins in the overlap belongs to the next shard
            starts.append(where[own] + at)
            found.append(which[own])
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(found)


def search(texts: pa.Array, phrases: Phrases) -> Iterator[tuple[int, list[str], list[dict]]]:
    """For each text: words, ids of items that occur, and merged hit spans.

    A span has its first and last word's bounds in code points (start, end) and in words (first, past).
    """
    data, offsets = utf8(texts)
    for a, b in slices(offsets, SHARD_BYTES):
        own = data[offsets[a] : offsets[b]]
        w = words(own, offsets[a : b + 1] - offsets[a], ALNUM_WORD)
        counts = np.diff(w.first)
        n = len(w.hashes)
        if not n or not len(phrases.lengths):
            yield from ((int(c), [], []) for c in counts)
            continue
        symbols = phrases.translate(w)
        # a separator between documents keeps windows inside them
        word = np.arange(n) + np.repeat(np.arange(b - a), counts)
        spread = np.zeros(n + b - a, dtype=np.int64)
        spread[word] = symbols
        back = np.cumsum(np.bincount(word, minlength=len(spread))) - 1
        start, which = _occurrences(spread, phrases)
        start = back[start]
        delta = np.zeros(n + 1, dtype=np.int64)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + phrases.lengths[which], -1)
        hit = np.cumsum(delta[:-1]) > 0
        hits = np.concatenate([[0], np.cumsum(hit)])
        n_hit = hits[w.first[1:]] - hits[w.first[:-1]]
        doc = np.searchsorted(w.first, start, "right") - 1
        pairs = np.unique(np.stack([doc, which], axis=1), axis=0)
        bounds = np.searchsorted(pairs[:, 0], np.arange(b - a + 1))
        for d in range(b - a):
            if not n_hit[d]:
                yield int(counts[d]), [], []
                continue
            items: set[int] = set()
            for p in np.unique(pairs[bounds[d] : bounds[d + 1], 1]).tolist():
                items.update(phrases.item[phrases.item_first[p] : phrases.item_first[p + 1]].tolist())
            lo, hi = w.first[d], w.first[d + 1]
            edge = np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]]))
            first, past = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            base = offsets[a + d] - offsets[a]
            points = np.cumsum((own[base : offsets[a + d + 1] - offsets[a]] & 0xC0) != 0x80)
            places = zip((points[w.starts[lo + first] - base] - 1).tolist(), points[w.ends[lo + past - 1] - 1 - base].tolist(), first.tolist(), past.tolist(), strict=True)
            yield int(counts[d]), sorted(phrases.names[i] for i in items), [dict(zip(("start", "end", "first", "past"), x, strict=True)) for x in places]


_RUN = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "end", "first", "past")]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("runs", _RUN)]
_ARROW = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "end", "first", "past")])))


def _pass(docs: DataFrame, text: str, items: list[tuple[str, str]], window: int) -> DataFrame:
    """``docs`` with n_words, items and runs (spans of hit words) of some items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    built: list[Phrases] = []

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        if not built:
            built.append(Phrases(shared.value, window))
        rows = list(search(batch.column(batch.schema.get_field_index(text)), built[0]))
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)]

    return append_columns(docs, _FOUND, compute, needs=[text])


def _results(n_hit: Column) -> list[Column]:
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return [F.col("n_words"), n_hit.alias("n_hit"), F.col("items"), spans.alias("spans")]


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids, sorted) and spans (removal spans in code points).

    The benchmark's size is measured first. Up to ``block_bytes`` it is broadcast and searched in one
    pass over ``docs``. A larger one is split by id into blocks of about that size: the documents get
    row numbers in a staged table, each block leaves only what it finds, by row number, and the runs
    found are merged, so that the result is the same.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = 1 + int(total) // block_bytes
    taken = {f.name for f in FIELDS}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    length = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["past"] - r["first"])
    if blocks == 1:
        source = docs.select(*kept, F.col(f"`{text}`").alias("__text"))
        return _pass(source, "__text", [(r.i, r.t) for r in items.collect()], window).select(*kept, *_results(length))
    numbered = stage(docs.select(*kept, F.col(f"`{text}`").alias("__text"), F.monotonically_increasing_id().alias("__row")), "numbered")
    parts = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        part = _pass(numbered.select("__row", "__text"), "__text", [(r.i, r.t) for r in own.collect()], window)
        part = stage(part.select("__row", "items", "runs").where("size(runs) > 0"), "hits")
        parts = part if parts is None else parts.unionByName(part)
    merged = parts.groupBy("__row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("runs")), lambda x, y: F.when(x["first"] < y["first"], -1).when(x["first"] > y["first"], 1).otherwise(0)).alias("runs"),
    )
    merged = merged.withColumn("runs", F.expr(_MERGE))
    counted = _pass(numbered, "__text", [], window).drop("items", "runs")
    joined = counted.join(merged, "__row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>"))).withColumn("runs", F.coalesce("runs", F.array().cast(_RUN)))
    return joined.select(*kept, *_results(length))


#: Runs in order, those that touch or overlap joined.
_MERGE = """aggregate(runs, cast(array() AS array<struct<start:bigint,end:bigint,first:bigint,past:bigint>>), (out, r) ->
  IF(size(out) > 0 AND r.first <= element_at(out, -1).past,
     concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, r.end),
       'first', element_at(out, -1).first, 'past', greatest(element_at(out, -1).past, r.past)))),
     concat(out, array(r))))"""


def is_contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def strip_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their removal spans cut out of the text."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    starts = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda x: F.substring(F.col(text), x["e"].cast("int") + 1, (x["s"] - x["e"]).cast("int")))
    return found.withColumn(text, F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col(text)))


