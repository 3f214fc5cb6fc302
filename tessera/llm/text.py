"""Vectorised text primitives shared by the operators of this package.

All of them work on whole UTF-8 buffers with numpy, so no Python code runs per character or word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tessera.session import ship

#: Bytes of text that are tokenised at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that are turned to Python objects at once; one row may have more.
PIECE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte classes. Every byte of a multi-byte UTF-8 character is 128 or more.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x41:0x5B] = True  # lower-cased before use
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _TABLES[i] = np.multiply.accumulate(table)
    return _TABLES[0], _TABLES[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``most`` bytes together, or that are one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about ``most`` bytes each."""
    rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


@dataclass
class Words:
    """Words of some documents: byte bounds, identities, two 64-bit hashes, and where each document's words begin.

    ``low`` and ``high`` with the length tell words apart: they are the bytes of words of up to 16, and a
    128-bit BLAKE2b digest of longer ones. ``hashes`` and ``checks`` are mixed from them independently.
    """

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    checks: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # n + 1 word offsets


#: The low bytes of a 64-bit number, by how many of them count.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_BY_VALUE = 16


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of ``is_word`` bytes within documents, identified with A-Z lower-cased."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        same = none.astype(np.uint64)
        return Words(none, none, same, same, same, same, np.zeros(len(offsets), dtype=np.int64))
    inside = is_word[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    lower = np.zeros(n + _BY_VALUE, dtype=np.uint8)
    lower[:n] = _LOWER[data]
    eight = np.ndarray((n + 9,), dtype="<u8", buffer=lower, strides=(1,))  # eight bytes from each place
    size = ends - starts
    low = eight[starts] & _LOW_BYTES[np.minimum(size, 8)]
    high = eight[np.minimum(starts + 8, n + 8)] & _LOW_BYTES[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > _BY_VALUE)
    if len(long):
        view = memoryview(lower)
        digests = b"".join(blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        low[long], high[long] = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
    length = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashes = mix(low ^ mix(high ^ length))
    checks = mix(high ^ mix(low + length + np.uint64(0xA24BAED4963EE407)))
    return Words(starts, ends, hashes, checks, low, high, np.searchsorted(starts, offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each document as hashes, ascending, second hashes of them, and n + 1 offsets.

    A document of fewer than k words, but not none, has one shingle: its whole word sequence.
    """
    counts = np.diff(w.first)
    n = len(w.hashes)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - w.first[doc] if n else np.zeros(0, dtype=np.int64)
    keep = (counts[doc] - place >= k) | ((counts[doc] < k) & (place == 0))
    short = np.flatnonzero((counts > 0) & (counts < k))
    rolled = []
    for h in (w.hashes, w.checks):
        roll = np.zeros(n, dtype=np.uint64)
        for i in range(min(k, n)):
            roll[: n - i] = mix(roll[: n - i] ^ h[i:])
        part = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):  # shorter documents end before what follows them
            more = counts[short] > i
            part[more] = mix(part[more] ^ h[w.first[short[more]] + i])
        roll[w.first[short]] = part
        rolled.append(roll[keep])
    one, other = rolled
    doc = doc[keep]
    order = np.lexsort((one, doc)) if len(one) < 64 else _by_doc(one, doc, len(counts))
    one, other, doc = one[order], other[order], doc[order]
    fresh = np.ones(len(one), dtype=bool)
    fresh[1:] = (one[1:] != one[:-1]) | (doc[1:] != doc[:-1])
    doc = doc[fresh]
    return one[fresh], other[fresh], np.searchsorted(doc, np.arange(len(counts) + 1))


def lowered(data: np.ndarray, w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with A-Z lower-cased and a space after each, as bytes, and where each begins and ends in them."""
    size = w.ends - w.starts
    end = np.cumsum(size + 1) - 1
    begin = end - size
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[end] = False
    source = np.arange(len(out)) + np.repeat(w.starts - begin, size + 1)
    out[inside] = _LOWER[data[source[inside]]]
    return out.tobytes(), begin, end


def _by_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The order by document, then value; documents are already in order."""
    bounds = np.searchsorted(doc, np.arange(n + 1))
    out = np.empty(len(values), dtype=np.int64)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b] = np.argsort(values[a:b]) + a
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, one per first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(max(n, CHUNK_BYTES))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * power[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def _sliding(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Minima or maxima of all runs of ``width`` values, by doubling."""
    m, s = x, 1
    while 2 * s <= width:
        m, s = least(m[:-s], m[s:]), 2 * s
    return least(m[: len(x) - width + 1], m[width - s :])


def winnow(x: np.ndarray, width: int) -> np.ndarray:
    """Places of values that are the least of some run of ``width`` values (of all, if there are fewer).

    Two sequences that share ``width`` values in a row share a place chosen in both.
    """
    return winnow_parts(x, np.zeros(1, dtype=np.int64), np.full(1, len(x)), width)


def winnow_parts(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """The places that ``winnow`` chooses in each of the parts ``x[lo:hi]``, which are in order and do not overlap."""
    chosen = np.zeros(len(x), dtype=bool)
    long = hi - lo > width
    if long.any():
        low = _sliding(x, width, np.minimum)
        within = np.zeros(len(low) + 1, dtype=np.int8)  # runs that lie inside a part
        within[lo[long]] += 1
        np.subtract.at(within, hi[long] - width + 1, 1)
        low[np.cumsum(within[:-1]) == 0] = 0
        edge = np.zeros(width - 1, dtype=x.dtype)
        inside = np.zeros(len(x) + 1, dtype=np.int8)
        inside[lo[long]] += 1
        np.subtract.at(inside, hi[long], 1)
        chosen = (x == _sliding(np.concatenate([edge, low, edge]), width, np.maximum)) & (np.cumsum(inside[:-1]) > 0)
    short = np.flatnonzero((hi > lo) & ~long)
    if len(short):
        size = hi[short] - lo[short]
        at = np.arange(size.sum()) + np.repeat(lo[short] - np.cumsum(size) + size, size)
        least = np.minimum.reduceat(x[at], np.cumsum(size) - size)
        chosen[at] = x[at] == np.repeat(least, size)
    return np.flatnonzero(chosen)


def append_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list[pa.Array]], *, needs: list[str]) -> DataFrame:
    """``df`` with the columns ``fields``, computed batch by batch on executors, without a shuffle.

    ``compute`` gets Arrow batches that have the columns ``needs`` under these names. Columns of
    ``df`` whose names clash with ``fields`` are replaced.
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new or c in needs]
    out = [c for c in kept if c.lower() not in new]
    source = df.select(*[f"`{c}`" for c in kept])
    schema = T.StructType([source.schema[c] for c in out] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        types = target.types
        for batch in (p for b in batches for p in pieces(b)):
            made = compute(batch)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in out] + list(made)
            yield pa.RecordBatch.from_arrays([a.cast(t) if a.type != t else a for a, t in zip(arrays, types, strict=True)], names=target.names)

    return source.mapInArrow(run, schema)
