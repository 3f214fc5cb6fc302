"""The pipeline over the smallest sample, stage by stage, against plain Python."""

from __future__ import annotations

import re
from collections import defaultdict
from fractions import Fraction

import corpus_pipeline
import pytest
from tessera.llm import secrets
from test_decontam import brute as contamination
from test_neardup import brute as near

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["documents"] = docs
    for name, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER).cache()
        out[name] = docs
    return {k: v.collect() for k, v in out.items()}


def test_columns(stages):
    want = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(stages[k][0].asDict()) == want for k, _ in corpus_pipeline.STAGES[:-1])


def test_stages_against_brute_force(spark, stages):
    kept = {r.doc_id: r.text for r in stages["language_id"]}
    assert len(kept) >= 0.98 * len(stages["documents"]) and all(re.search(r"[^\W\d_]", t) for t in kept.values())
    want, _ = near(sorted(kept.items()), 5, Fraction(4, 5))
    kept = {d: t for d, t in kept.items() if want[d] == d}
    assert {r.doc_id: r.text for r in stages["near_dedup"]} == kept
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {row[0] for row in contamination(sorted(kept.items()), items) if row[5]}
    kept = {d: t for d, t in kept.items() if d not in dirty}
    assert {r.doc_id: r.text for r in stages["decontaminate"]} == kept
    rows = {r.doc_id: r for r in stages["secret_scan"]}
    assert set(rows) == set(kept)
    for d, t in kept.items():
        if not secrets.scan(t):
            assert rows[d].text == t
        else:
            assert "[REDACTED]" in rows[d].text and not [s for s in secrets.base_spans(rows[d].text) if s[2] > 0]
        assert rows[d].n_chars == len(rows[d].text)


def test_packed_rows(spark, stages):
    per = defaultdict(int)
    for r in stages["best_fit_packing"]:
        per[r.sequence_id] += r.length
    assert {r.doc_id for r in stages["best_fit_packing"]} == {r.doc_id for r in stages["secret_scan"]} and max(per.values()) <= 2048
    assert len(per) <= -(-sum(per.values()) // 2048) + 1


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    shape = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert shape(got) == shape(stages["best_fit_packing"])
