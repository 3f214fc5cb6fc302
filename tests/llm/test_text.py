"""Vectorised words and shingles against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm.text import ALNUM_WORD, NON_SPACE, lowered, pieces, shingles, slices, utf8, words

UPPER = {i: i + 32 for i in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="aAbZ09 \n\t.é日😀_", max_size=40) | st.none(), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    data, offsets = utf8(pa.array(texts, pa.string()))
    for is_word, pattern in ((ALNUM_WORD, ALNUM), (NON_SPACE, SPACED)):
        w = words(data, offsets, is_word)
        want = [pattern.findall((t or "").translate(UPPER)) for t in texts]
        assert np.diff(w.first).tolist() == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        got = [bytes(data[a:b]).decode().translate(UPPER) for a, b in zip(w.starts, w.ends, strict=True)]
        assert got == flat
        by_word = dict(zip(flat, w.hashes.tolist(), strict=True))
        assert [by_word[x] for x in flat] == w.hashes.tolist() and len(set(by_word.values())) == len(by_word)
        whole = set(zip(w.low.tolist(), w.high.tolist(), (w.ends - w.starts).tolist(), strict=True))
        assert len(whole) == len(set(flat)) == len(set(w.checks.tolist()))
        plain, begin, end = lowered(data, w)
        assert [plain[a:b].decode() for a, b in zip(begin, end, strict=True)] == flat


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_shingles(texts, k):
    data, offsets = utf8(pa.array(texts, pa.string()))
    sets, others, first = shingles(words(data, offsets, NON_SPACE), k)
    assert len(others) == len(sets) and (len(set(others.tolist())) == len(set(sets.tolist())))
    want = []
    for t in texts:
        ws = SPACED.findall((t or "").translate(UPPER))
        want.append({tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set())
    assert np.diff(first).tolist() == [len(s) for s in want]
    own = [set(sets[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    for i in range(len(texts)):
        for j in range(i):
            assert len(own[i] & own[j]) == len(want[i] & want[j])


def alike_under_powers(length: int = 2048):
    """Two different words of a letters and b letters whose polynomials modulo 2 ** 64 agree for every odd base."""
    one = [0]
    while len(one) < length:
        one += [1 - x for x in one]
    return "".join("ab"[x] for x in one), "".join("ba"[x] for x in one)


def test_long_words_that_defeat_polynomials_differ():
    one, other = alike_under_powers()
    data, offsets = utf8(pa.array([one, other, one[:16], other[:16], one[:17], other[:17]], pa.string()))
    w = words(data, offsets, NON_SPACE)
    assert len(set(w.hashes.tolist())) == len(set(w.checks.tolist())) == len(set(w.low.tolist())) == 6


def test_slices_and_sliced_columns():
    column = pa.array(["aa", None, "", "bbbb", "c"], pa.string()).slice(1, 4)
    data, offsets = utf8(column)
    assert bytes(data) == b"bbbbc" and offsets.tolist() == [0, 0, 0, 4, 5]
    assert list(slices(offsets, 3)) == [(0, 2), (2, 3), (3, 4)]
    assert utf8(pa.array([], pa.string()))[1].tolist() == [0]
    batch = pa.record_batch({"a": pa.array(["x" * 100] * 10)})
    assert [p.num_rows for p in pieces(batch, 300)] == [2] * 5 and list(pieces(batch.slice(0, 0))) == []
