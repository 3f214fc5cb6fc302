"""Substring dedup: repeated paragraphs are found by MinHash banding and cut, but for their first copy.

Paragraphs are a text's lines; those of fewer than ``min_words`` words are left alone (with 1, the default,
blank lines only). A paragraph of fewer words than a shingle has one shingle, all of it, so that it repeats
by exact equality. Equal paragraphs collapse to one first. Of each one's shingles, those of the least hashes are
its MinHash sketch: of n shingles n - ceil(0.8 n) + 1, which is so many that two paragraphs at the threshold share
one for certain. Paragraphs that share one are joined, their exact Jaccard similarity on word
shingles is verified, and the verified links make clusters, of which the paragraph of the smallest document
id stays (of one document, the first).

A passage can also repeat inside paragraphs that differ. Such passages are found by winnowed fingerprints
of PASSAGE_WORDS words: of every PASSAGE_WINDOW fingerprints in a row one is chosen by its value, so that
two documents that share PASSAGE_WORDS + PASSAGE_WINDOW - 1 = 50 words in a row share a chosen one, and
each run of PASSAGE_WORDS of these words begins less than PASSAGE_WINDOW words from a shared chosen one (an
anchor), with no smaller fingerprint between. Anchors, and the runs around them where what is shared may end,
are compared by a 128-bit BLAKE2b digest of their words, so that spans cover all words that agree, and no
others. Nothing can end between two neighbours of which each, wherever it stands in any text, has the other at
the same distance (and the same words between). Of each run the smallest id's first one stays. Equal texts are
one here: each copy is a span as a whole.

Null texts have no paragraph. Rows with a null id are left alone. Rows that share an id and differ in text
are documents of their own, told apart by ``text_hash``; repeated rows share what is decided for them. Ids are any
64-bit numbers. Very long texts are read whole. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.components import split_join
from tessera.llm.neardup import Settings, cluster_rows, number_rows
from tessera.llm.text import NON_SPACE, append_columns, grams, lowered, mix, slices, utf8, winnow_parts, words
from tessera.session import stage, unstage

PASSAGE_WORDS, PASSAGE_WINDOW = 24, 27
SETTINGS = Settings(band_miss=1e-3, miss=1e-12, hashes=30, exact=True)


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (own, t, body): id, hash of the text, and text of each document; repeated rows are one."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("own"), F.xxhash64(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("body")).where("own is not null and body is not null")


def paragraphs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """Rows (own, t, i, text): every paragraph that counts, with its document and its line's number."""
    lines = _source(docs, key, text).select("own", "t", F.posexplode(F.split("body", "\n", -1)).alias("i", "text"))
    if min_words == 1:  # the first word tells, whatever follows
        return lines.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return lines.where(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= min_words)


def find_repeats(docs: DataFrame, settings: Settings = SETTINGS, *, key: str = "doc_id", text: str = "text", min_words: int = 1) -> DataFrame:
    """Rows (doc_id, text_hash, paragraph, cluster_doc_id, cluster_paragraph, removed).

    One row for each paragraph that repeats; the cluster's columns name its first copy, which stays.
    """
    rows = number_rows(paragraphs(docs, key=key, text=text, min_words=min_words))
    passing = [rows]
    judged = cluster_rows(rows, settings, order=F.struct("own", "i", "t"), passing=passing)
    judged = stage(judged.select("order", "first").where("order <> first").distinct(), "repeats")
    unstage(*passing)
    firsts = judged.select(F.col("first").alias("order"), "first").distinct()
    shown = judged.unionByName(firsts)
    return shown.select(
        F.col("order.own").alias("doc_id"),
        F.col("order.t").alias("text_hash"),
        F.col("order.i").alias("paragraph"),
        F.col("first.own").alias("cluster_doc_id"),
        F.col("first.i").alias("cluster_paragraph"),
        (F.col("order") != F.col("first")).alias("removed"),
    )


def _list_of(*names: str) -> tuple[T.ArrayType, pa.DataType]:
    """A list of structs of longs, for Spark and for Arrow."""
    return T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in names])), pa.list_(pa.struct([(n, pa.int64()) for n in names]))


PRINTS, _PRINTS = _list_of("h", "at", "between")
GRAMS, _GRAMS = _list_of("h", "h2", "at", "start", "end")
SPANS, _SPANS = _list_of("first", "start", "end")


def _lists(counts: list[int], found: list[tuple[np.ndarray, ...]], kind: pa.DataType) -> pa.Array:
    names = [f.name for f in kind.value_type]
    edges = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
    columns = [np.concatenate([np.zeros(0, dtype=np.int64), *(f[i] for f in found)]) for i in range(len(names))]
    return pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)).cast(kind)


def _prints(batch: pa.RecordBatch) -> list[pa.Array]:
    """Chosen fingerprints of each text, with the numbers of their first words, and where its words begin and end.

    ``between`` tells the words that lie between one's run and the next one's, if there are any.
    """
    data, offsets = utf8(batch.column(batch.schema.get_field_index("body")))
    counts, found, begins, ends = [], [], [], []
    for a, b in slices(offsets):
        own, first = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        w = words(own, first, NON_SPACE)
        hashes = grams(w.hashes, PASSAGE_WORDS)
        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        lo, hi = w.first[:-1], np.maximum(w.first[1:] - PASSAGE_WORDS + 1, w.first[:-1])
        at = winnow_parts(hashes, lo, hi, PASSAGE_WINDOW)
        doc = np.searchsorted(lo, at, "right") - 1
        counts += np.bincount(doc, minlength=b - a).tolist()
        between = np.zeros(len(at), dtype=np.uint64)
        gap = np.where(doc[1:] == doc[:-1], np.diff(at), 0)
        for k in range(PASSAGE_WORDS, PASSAGE_WINDOW):
            apart = np.flatnonzero(gap > k)
            between[apart] = mix(between[apart] ^ w.hashes[at[apart] + k])
        found.append((hashes[at].view(np.int64), at - lo[doc], between.view(np.int64)))
        begin, end = np.zeros((2, b - a), dtype=np.int64)
        full = np.flatnonzero(hi > lo)
        begin[full] = points[w.starts[lo[full]]] - points[first[full]]
        end[full] = points[w.ends[w.first[full + 1] - 1]] - points[first[full]]
        begins += begin.tolist()
        ends += end.tolist()
    return [_lists(counts, found, _PRINTS), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())]


def _edges(at: np.ndarray, fixed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Anchors, and the places around them at which something shared may begin or end.

    ``fixed`` tells whether an anchor has the same left (1) and right (2) neighbour wherever it stands, and
    ``hashes`` are all fingerprints of the text. An anchor is the least of what is shared around it, so that nothing
    is looked for beyond a smaller one, nor up to the last of those that always follow one another. Where the runs
    of neighbours do not overlap, one more between them does, with both.
    """
    n = len(hashes)
    order = np.argsort(at)
    at, fixed = at[order], fixed[order]
    reach = np.arange(1, PASSAGE_WINDOW)
    change = np.zeros(n + 1, dtype=np.int64)
    right, left = at[:, None] + reach, at[:, None] - reach
    own = hashes[at][:, None]
    after = np.logical_and.accumulate((right < n) & (hashes[np.minimum(right, n - 1)] >= own), axis=1).sum(axis=1)
    before = np.logical_and.accumulate((left >= 0) & (hashes[np.maximum(left, 0)] >= own), axis=1).sum(axis=1)
    met = (fixed[:-1] & 2 > 0) & (fixed[1:] & 1 > 0)
    heads, tails = np.flatnonzero(np.concatenate([[True], ~met])), np.flatnonzero(np.concatenate([~met, [True]]))
    each = np.arange(len(at))
    first, last = at[heads[np.searchsorted(heads, each, "right") - 1]], at[tails[np.searchsorted(tails, each)]]
    for start, end in ((at - before, first), (last + 1, at + after + 1)):
        some = start < end
        np.add.at(change, start[some], 1)
        np.add.at(change, end[some], -1)
    looked = np.cumsum(change)[:n] > 0
    apart = np.flatnonzero(met & (np.diff(at) >= PASSAGE_WORDS))
    looked[at] = looked[at[apart] + PASSAGE_WORDS // 2] = True
    return np.flatnonzero(looked)


def _near_anchors(batch: pa.RecordBatch) -> list[pa.Array]:
    """Anchors and the runs of PASSAGE_WORDS words at the edges of what is shared.

    Each has the digest of its words (lower-cased, one space between them) and its place in code points.
    """
    data, offsets = utf8(batch.column(batch.schema.get_field_index("body")))
    anchors = batch.column(batch.schema.get_field_index("anchors"))
    counts, found = [], []
    for a, b in slices(offsets):
        own, first = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        w = words(own, first, NON_SPACE)
        hashes = grams(w.hashes, PASSAGE_WORDS)
        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        plain, begin, end = lowered(own, w)
        for d in range(b - a):
            lo, n = w.first[d], w.first[d + 1] - w.first[d] - PASSAGE_WORDS + 1
            places, fixed = (anchors[a + d].values.field(x).to_numpy(zero_copy_only=False) for x in ("at", "fixed"))
            at = _edges(places, fixed, hashes[lo : lo + n])
            counts.append(len(at))
            base = points[first[d]]
            runs = zip(begin[at + lo].tolist(), end[at + lo + PASSAGE_WORDS - 1].tolist(), strict=True)
            digests = np.frombuffer(b"".join(blake2b(plain[x:y], digest_size=16).digest() for x, y in runs), dtype="<i8").reshape(-1, 2)
            found.append((digests[:, 0], digests[:, 1], at, points[w.starts[at + lo]] - base, points[w.ends[at + lo + PASSAGE_WORDS - 1]] - base))
    return [_lists(counts, found, _GRAMS)]


def _uncovered(first: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans (in words) that those of smaller first documents do not cover together, from word to word without a break.

    A run at an edge in one document may lie between anchors in another, which does not tell it; the anchors cover it.
    """
    keep = np.ones(len(first), dtype=bool)
    if not len(first):
        return keep
    low = int(begin.min())
    lo, hi = 2 * (begin - low), 2 * (end - low) - 1  # words have even places, and what lies between two has an odd one
    covered = np.zeros(int(hi.max()), dtype=bool)
    for own in np.unique(first):
        mine = np.flatnonzero(first == own)
        for i in mine.tolist():
            keep[i] = not covered[lo[i] : hi[i]].all()
        for i in mine.tolist():
            covered[lo[i] : hi[i]] = True
    return keep


def _joined_spans(batch: pa.RecordBatch) -> list[pa.Array]:
    """Runs of a text that meet, in their first document as here, as spans. They come in any order, and again for repeated rows."""
    out = []
    for row in batch.column(batch.schema.get_field_index("grams")):
        g = row.values
        at, one = np.unique(g.field("at").to_numpy(zero_copy_only=False), return_index=True)
        start, end, first, first_d, first_at = (g.field(n).to_numpy(zero_copy_only=False)[one] for n in ("start", "end", "first", "first_d", "first_at"))
        cut = np.flatnonzero((np.diff(at) > PASSAGE_WORDS) | (first[1:] != first[:-1]) | (first_d[1:] != first_d[:-1]) | (np.diff(first_at) != np.diff(at)))
        heads, tails = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
        keep = _uncovered(first[heads], at[heads], at[tails] + PASSAGE_WORDS)
        out.append((first[heads][keep], start[heads][keep], end[tails][keep]))
    return [_lists([len(x[0]) for x in out], out, _SPANS)]


def _neighbours(x: str, y: str) -> Column:
    """What tells the prints ``x`` and ``y``, one after the other, and how they lie; 0 if one of them is not there."""
    x, y = F.col(x), F.col(y)
    return F.when(x.isNull() | y.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(x["h"], y["h"], y["at"] - x["at"], x["between"]))


def find_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, start, end, cluster_doc_id, removed): passages that other documents have as well.

    Every passage of 50 words or more that repeats is covered whole, and none of fewer than PASSAGE_WORDS
    is found. A span is a run of words that stands in the cluster's document as it is, which is the first
    that tells its runs of PASSAGE_WORDS words; where that document or the place in it changes, another span
    begins, which overlaps the last one by up to PASSAGE_WORDS - 1 words. Since a word is only removed where
    a smaller document has the run it belongs to, each word that is removed is left in some document.
    """
    source = _source(docs, key, text)
    made = [T.StructField("p", PRINTS), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]
    printed = append_columns(source.withColumn("m", F.md5(F.encode("body", "UTF-8"))), made, _prints, needs=["body"]).where("size(p) > 0")
    printed = stage(printed.select("own", "t", "m", "lo", "hi", "p"), "prints")
    # equal texts are one, with its first document's id
    texts = printed.groupBy("m").agg(F.min(F.struct("own", "t", "p")).alias("f"), F.max("own").alias("last"), F.count("*").alias("w"))
    texts = texts.select("m", F.col("f.own").alias("own"), F.col("f.t").alias("t"), F.col("f.p").alias("p"), "last", "w")
    texts = stage(texts.withColumn("d", F.monotonically_increasing_id()), "texts")
    copied = texts.where("own < last").select("m", F.col("own").alias("first"), "w")
    whole = split_join(printed.select("own", "t", "m", "lo", "hi"), copied, "m", "w").select("own", "t", F.col("lo").alias("start"), F.col("hi").alias("end"), "first").distinct()
    whole = stage(whole, "copies")
    unstage(printed)
    # each print with what tells its neighbours; 0 if it has none
    none = F.array(F.lit(None).cast(PRINTS.elementType))
    told = F.arrays_zip(F.col("p").alias("x"), F.concat(none, "p").alias("before"), F.slice("p", F.lit(2), F.size("p")).alias("after"))
    each = texts.select("own", F.inline(told)).where("x is not null").select("own", F.col("x.h").alias("h"), _neighbours("before", "x").alias("left"), _neighbours("x", "after").alias("right"))
    same = lambda side: (F.min(side) == F.max(side)) & (F.min(side) != 0)
    fixed = (F.when(same("left"), 1).otherwise(0) + F.when(same("right"), 2).otherwise(0)).cast("long")
    shared = each.groupBy("h").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("w"), fixed.alias("fixed")).where("lo < hi")
    shared = stage(shared.select("h", "w", "fixed"), "shared")
    places = texts.select("d", F.inline("p")).select("d", "h", "at")
    anchors = split_join(places, shared, "h", "w").groupBy("d").agg(F.collect_list(F.struct("at", "fixed")).alias("anchors"))
    anchors = stage(texts.select("own", "t", "d").join(anchors, "d"), "anchors")
    unstage(texts, shared)
    near = append_columns(source.join(anchors, ["own", "t"]), [T.StructField("g", GRAMS)], _near_anchors, needs=["body", "anchors"])
    near = stage(near.select("own", "d", F.inline("g")), "grams")
    firsts = near.groupBy("h", "h2").agg(F.min(F.struct("own", "d", "at")).alias("f"), F.max("own").alias("hi"), F.count("*").alias("w")).where("f.own < hi")
    firsts = stage(firsts.select("h", "h2", "w", F.col("f.own").alias("first"), F.col("f.d").alias("first_d"), F.col("f.at").alias("first_at")), "firsts")
    again = split_join(near.drop("own"), firsts, ["h", "h2"], "w")
    again = again.groupBy("d").agg(F.collect_list(F.struct("at", "start", "end", "first", "first_d", "first_at")).alias("grams"))
    spans = append_columns(again, [T.StructField("s", SPANS)], _joined_spans, needs=["grams"]).select("d", F.inline("s"))
    spans = stage(spans, "spans")
    unstage(near, firsts)
    spans = spans.join(anchors.select("own", "t", "d"), "d").select("own", "t", "start", "end", "first").unionByName(whole)
    return spans.select(F.col("own").alias("doc_id"), F.col("t").alias("text_hash"), "start", "end", F.col("first").alias("cluster_doc_id"), (F.col("own") != F.col("first")).alias("removed"))


def remove_repeats(docs: DataFrame, found: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the paragraphs that ``found`` (of find_repeats) removes."""
    gone = found.where("removed").groupBy(F.col("doc_id").alias("__own"), F.col("text_hash").alias("__t")).agg(F.collect_set("paragraph").alias("__gone"))
    joined = docs.join(gone, (F.col(f"`{key}`") == F.col("__own")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__t")), "left")
    kept = F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1), lambda x, i: ~F.array_contains("__gone", i)), "\n")
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept)).select(*[f"`{c}`" for c in docs.columns])


def remove_passages(docs: DataFrame, found: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the passages that ``found`` (of find_passages) removes; spans that overlap are cut once."""
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    gone = found.where("removed").groupBy(F.col("doc_id").alias("__own"), F.col("text_hash").alias("__t")).agg(spans.alias("__gone"))
    joined = docs.join(gone, (F.col(f"`{key}`") == F.col("__own")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__t")), "left")
    # what lies before each span, from where the furthest one before it ends
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    piece = lambda acc, s: F.substring(F.col(f"`{text}`"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["parts"], piece(acc, s)).alias("parts"))
    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col(f"`{text}`"), (acc["at"] + 1).cast("int"), F.length(F.col(f"`{text}`"))))
    kept = F.aggregate("__gone", state, step, rest)
    return joined.withColumn(text, F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(kept)).select(*[f"`{c}`" for c in docs.columns])
