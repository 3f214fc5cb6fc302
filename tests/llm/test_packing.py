"""Plans over histograms, and packed documents held against the tokenizer."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import packing, queries
from tokenizers import Tokenizer


def check_plan(histogram, plan):
    placed = defaultdict(int)
    for config, times in plan.used:
        assert sum(x * n for x, n in config.items()) <= plan.capacity
        for x, n in config.items():
            placed[x] += n * times
    assert dict(placed) == {x: n for x, n in histogram.items() if n}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(0, 40), max_size=20))
def test_plans_place_every_piece(histogram):
    plan = packing.make_plan(histogram, 50, rounds=60)
    check_plan(histogram, plan)
    bound = -(-sum(x * n for x, n in histogram.items()) // 50)
    best_fit = sum(n for _, n in packing.best_fit_decreasing({x: n for x, n in histogram.items() if n}, 50))
    assert bound <= math.ceil(plan.bound - 1e-6) <= plan.sequences <= best_fit


def least_sequences(histogram, capacity):
    """The best plan of all, by trying every way to fill the sequence of the largest piece left."""

    @cache
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        found = [1 + best(tuple(rest))]

        def fill(at, space, taken):
            for i in range(at, len(rest)):
                if rest[i] <= space and (i == at or rest[i] != rest[i - 1]):
                    own = (*taken, i)
                    found.append(1 + best(tuple(x for j, x in enumerate(rest) if j not in own)))
                    fill(i + 1, space - rest[i], own)

        fill(0, capacity - first, ())
        return min(found)

    return best(tuple(sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True)))


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(0, 3), max_size=4))
def test_bound_is_one_of_the_best_plan(histogram):
    plan = packing.make_plan(histogram, 12, rounds=40)
    least = least_sequences(histogram, 12)
    assert plan.bound <= least + 1e-6 and least <= plan.sequences <= least + 1


def test_program_closes_its_gap():
    """Fractional covers come near to the bound, also where the volume bound is far from it."""
    for histogram, capacity in (({14: 3, 18: 6, 26: 9}, 50), ({6: 300, 7: 300, 15: 300}, 30), ({x: 7 for x in range(35, 56)}, 100)):
        count = np.array([histogram[x] for x in sorted(histogram)], dtype=float)
        solution = packing.solve(histogram, capacity, rounds=400)
        cost = sum(solution.used.values()) / solution.covered.min()
        for config in solution.used:
            assert sum(x * n for x, n in config) <= capacity
        covered = {x: 0.0 for x in histogram}
        for config, times in solution.used.items():
            for x, n in config:
                covered[x] += n * times
        assert np.allclose([covered[x] for x in sorted(histogram)], solution.covered * count)
        assert solution.bound <= cost + 1e-6 and cost <= 1.05 * solution.bound, (histogram, solution.bound, cost)
    assert packing.make_plan({14: 3, 18: 6, 26: 9}, 50).sequences == 9


def test_knapsack_is_optimal():
    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 20), 5)))
        values = np.array([rng.random() for _ in sizes])
        picked = packing.knapsack(sizes, values, 30)
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes.tolist(), values.tolist(), strict=True) if s <= c)])
        at = dict(zip(sizes.tolist(), values.tolist(), strict=True))
        assert sum(s * n for s, n in picked.items()) <= 30 and abs(sum(at[s] * n for s, n in picked.items()) - best[30]) < 1e-9


def test_large_histogram_is_near_the_bound():
    rng = np.random.default_rng(0)
    for sizes in (np.clip(rng.lognormal(6.3, 0.9, 40_000).astype(int), 1, 2048), rng.integers(700, 1100, 3_000), rng.integers(1, 2049, 20_000), np.full(1000, 700)):
        lengths, counts = np.unique(sizes, return_counts=True)
        histogram = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
        plan = packing.make_plan(histogram)
        check_plan(histogram, plan)
        assert plan.sequences <= sum(n for _, n in packing.best_fit_decreasing(dict(histogram), 2048))
        assert 0 <= plan.gap <= 0.01


def test_cut():
    assert [packing.cut(n, 10) for n in (1, 10, 11, 25)] == [[1], [10], [1, 10], [5, 10, 10]]


def test_query(spark, tmp_path):
    rng = random.Random(4)
    texts = ["word " * rng.randrange(1, 900) for _ in range(60)] + [None, "", "é" * 9000, "x", "x", "a <|endoftext|> b", "の" * 3000, " \n\t " * 50]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_best_fit_packing(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in rows}
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert set(docs) == set(ids)
    for i, own in docs.items():
        assert [(n, s, x) for n, s, x in sorted(own)] == [(n, sum(packing.cut(len(ids[i]), 2048)[:n]), x) for n, x in enumerate(packing.cut(len(ids[i]), 2048))]
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) + 1
    assert 50256 in ids[65].tolist()


def test_ids_are_the_tokenizer_s():
    tokenizer, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.load_encoder()
    for text in ("hello <|endoftext|> world", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n  x", "<|endoftext|", "a  b\u00a0 c\t\n d's 123 é日本 \U0001f600 ", ""):
        assert packing.encode(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_repeated_rows_and_hot_lengths(spark):
    """Equal rows, also without an id, fill as many places as there are rows, whatever the partitions."""
    rows = [(7, "same")] * 4000 + [(None, "same")] * 3000 + [(i, "word " * (i % 50)) for i in range(500)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    places = [(r.sequence_id, r.offset + k) for r in got for k in range(r.length)]
    assert len(got) == len(rows) and len(set(places)) == len(places)
    assert len({r.sequence_id for r in got}) == -(-len(places) // 2048)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, pieces string")
    assert packing.pack(empty).count() == 0
