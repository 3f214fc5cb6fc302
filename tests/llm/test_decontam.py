"""FM-indexes and contamination search against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import decontam, queries
from tessera.llm.fm import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=6))
def test_index_finds_all_occurrences(symbols, patterns):
    text = np.array([*symbols, 0], dtype=np.int64)
    index = FMIndex(text, 4)
    matrix = np.zeros((len(patterns), 5), dtype=np.int64)
    for i, p in enumerate(patterns):
        matrix[i, 5 - len(p) :] = p
    which, low, high = index.search(matrix, np.array([len(p) for p in patterns]))
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
    for i, p in enumerate(patterns):
        want = [j for j in range(len(symbols)) if symbols[j : j + len(p)] == p]
        assert found.get(i, []) == want


def brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                own = windows.get(tuple(w[i : i + size]))
                if own:
                    found |= own
                    hit |= set(range(i, i + size))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["the", "of", "é", "Cat", "dog", "x1", "tion", "ér"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 12, 13, 30]))) for i in range(12)] + [(90, None), (91, "..."), (92, "short one"), (93, "short one")]
    docs = [(i, text(200) + ". " + items[i % 12][1].upper().replace("É", "é") + "! " + text(50)) for i in range(30)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, "Short, ONE."), (104, items[3][1]), (104, items[3][1]), (None, items[3][1]), (105, "zebra " * 50_000 + items[2][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs, items


def test_query_against_brute_force(spark, tables):
    folder, docs, items = tables
    got = sorted(map(tuple, queries.op1_decontaminate(spark, folder).collect()), key=str)
    assert got == sorted(brute(docs, items), key=str)


def test_blocks_of_a_large_benchmark_agree_with_one_pass(spark, tables):
    folder, docs, items = tables
    frames = [spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark")]
    shape = lambda df: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in df.where("doc_id is not null").collect())
    assert shape(decontam.find_contamination(*frames)) == shape(decontam.find_contamination(*frames, block_bytes=400))


def test_empty_tables_clashing_columns_and_stripping(spark):
    docs = spark.createDataFrame([(1, "we saw the quick brown fox today", "mine", 7)], "doc_id long, text string, spans string, n_words int")
    items = spark.createDataFrame([("q", "Quick brown FOX")], "item_id string, text string")
    row = decontam.find_contamination(docs, items).first()
    assert (row.n_words, row.n_hit, row["items"], [tuple(s) for s in row.spans]) == (7, 3, ["q"], [(11, 26)])
    assert decontam.strip_spans(decontam.find_contamination(docs, items)).first().text == "we saw the  today"
    none = decontam.find_contamination(docs, items.limit(0)).first()
    assert (none.n_words, none.n_hit) == (7, 0)
    assert decontam.find_contamination(docs.limit(0), items).count() == 0
    assert decontam.find_contamination(docs, items).where(decontam.is_contaminated()).select(F.col("doc_id")).count() == 1
