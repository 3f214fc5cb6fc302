"""Near-dedup, its components, and repeated paragraphs against brute force."""

from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest
from tessera.llm import neardup, paragraphs, queries
from tessera.llm.components import components, split_join
from tessera.llm.neardup import Settings
from tessera.llm.text import winnow, winnow_parts
from test_text import alike_under_powers

WORD = re.compile("[^\x20\x09-\x0d]+")
UPPER = {i: i + 32 for i in range(65, 91)}


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text, k):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(docs, k, threshold):
    sets, union = [(d, shingle_set(t, k)) for d, t in docs], Union()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) * threshold.denominator >= len(x | y) * threshold.numerator:
                union.join(a, b)
    return {d: union.find(d) for d, _ in docs}, dict(sets)


def near_copies(rng, text, n, most):
    out = []
    for _ in range(n):
        w = text.split(" ")
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = "w%d" % rng.randrange(10**6)
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(7)
    text = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    base, other = text(120), text(200)
    texts = near_copies(rng, base, 90, 14) + near_copies(rng, other, 30, 25) + [base] * 40 + [base.upper()] + [text(rng.randrange(1, 80)) for _ in range(60)]
    texts += [None, "", " \n", "one", "One", "one two", "one two", "x" * 100_000, text(20_000)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_query_against_brute_force(spark, tmp_path, documents):
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want, sets = brute(documents, 3, Fraction(85, 100))
    got = queries.op6_minhash_near_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(documents)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_blocks_find_what_hubs_leave(spark, documents, monkeypatch):
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 2)
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    settings = Settings(words=2, threshold=Fraction(9, 10))
    want, _ = brute(documents, 2, Fraction(9, 10))
    assert {r.doc_id: r.component_id for r in neardup.find_components(docs, settings).collect()} == want


def test_defaults_null_ids_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, text, 1), (3, text, 1), (None, text, 1), (7, other, 1), (5, other, 1), (9, None, 1), (9, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.find_components(docs).collect()), key=str)
    assert got == sorted([(5, 3, False), (3, 3, True), (None, None, True), (7, 3, False), (5, 3, False), (9, 9, True), (9, 9, True)], key=str)
    assert neardup.find_components(docs.limit(0)).count() == 0
    assert Settings().words == 5 and Settings().threshold == Fraction(4, 5)


def test_settings_keep_misses_rare():
    for s in (Settings(), Settings(threshold=Fraction(85, 100)), paragraphs.SETTINGS):
        t = float(s.threshold)
        assert (1 - t**s.rows) ** (s.hashes // s.rows) <= s.band_miss
        assert [n for n, _ in s.least_matches()][-1] == s.hashes
    rng = np.random.default_rng(0)
    same = rng.random((20_000, neardup.HASHES)) < 0.8  # signatures of pairs at the threshold
    one, other = np.zeros(same.shape, dtype=np.uint16), (~same).astype(np.uint16)
    assert neardup._survives(one, other, Settings().least_matches()).all()
    assert not neardup._survives(one, np.ones_like(one), Settings().least_matches()).any()


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((30, 20), (60, 40), (40, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 130)] * (m > 0)
        union = Union()
        for a, b in edges:
            union.join(a, b)
        found = components(spark.createDataFrame(edges, "a long, b long"))
        assert {r.node: r.component for r in found.collect()} == {x: union.find(x) for e in edges for x in e if union.find(x) != x}


def test_repeated_paragraphs(spark):
    rng = random.Random(9)
    line = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    shared, long = line(60), line(100)
    near = long.split(" ")
    near[50] = "changed"
    docs = [(1, f"{line(30)}\n{shared}\n{line(25)}"), (2, f"{shared}\n{line(40)}"), (3, f"{line(22)}\n{long}"), (4, " ".join(near)), (5, f"short line\n{line(30)}"), (6, "short line"), (7, None), (8, ""), (None, shared), (2, line(50))]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, removed string")
    found = paragraphs.find_repeats(frame, min_words=20)
    got = sorted((r.doc_id, r.paragraph, r.cluster_doc_id, r.cluster_paragraph, r.removed) for r in found.collect())
    assert got == [(1, 1, 1, 1, False), (2, 0, 1, 1, True), (3, 1, 3, 1, False), (4, 0, 3, 1, True)]
    clean = paragraphs.remove_repeats(spark.createDataFrame(docs[:9], "doc_id long, text string"), found)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert after[1] == docs[0][1] and after[2] == docs[1][1].split("\n")[1] and after[4] == "" and after[7] is None and after[None] == shared
    assert paragraphs.find_repeats(frame.limit(0)).count() == 0
    far = [((1 << 62) + 5, line(30)), (-(1 << 63), shared), ((1 << 63) - 1, shared)]  # any 64-bit ids
    got = paragraphs.find_repeats(spark.createDataFrame(far, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.cluster_doc_id, r.removed) for r in got) == [(-(1 << 63), -(1 << 63), False), ((1 << 63) - 1, -(1 << 63), True)]


def test_rows_of_one_id_keep_their_own_paragraphs(spark):
    docs = spark.createDataFrame([(1, "the same line"), (2, "the same line\nfirst of two"), (2, "another line\nthe same line"), (2, "another line\nthe same line")], "doc_id long, text string")
    found = paragraphs.find_repeats(docs)
    clean = sorted(r.text for r in paragraphs.remove_repeats(docs, found).collect())
    assert clean == ["another line", "another line", "first of two", "the same line"]


def test_paragraph_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    pool = [" ".join("w%d" % rng.randrange(300) for _ in range(30)) for _ in range(25)]
    docs = [(i, "\n".join(rng.choice(near_copies(rng, rng.choice(pool), 2, 3)) for _ in range(4))) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    units = [((d << 24) + i, x) for d, t in docs for i, x in enumerate(t.split("\n"))]
    want, _ = brute(units, 5, Fraction(4, 5))
    rows = queries.op3_substring_dedup(spark, str(tmp_path)).where("kind = 'paragraph'").collect()
    got = {(r.doc_id << 24) + r.paragraph: (r.cluster_doc_id << 24) + r.cluster_paragraph for r in rows}
    groups = {c for u, c in want.items() if u != c}
    assert got == {u: c for u, c in want.items() if c in groups}


def test_short_paragraphs_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    pool = [" ".join("w%d" % rng.randrange(300) for _ in range(n)) for n in range(1, 25) for _ in range(2)]
    pool += ["Licensed under the terms of the licence above.", "See also", "See also:"]
    docs = [(i, "\n".join(rng.choice([*near_copies(rng, rng.choice(pool), 2, 2), "", "See  ALSO"]) for _ in range(6))) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    units = [((d << 24) + i, x) for d, t in docs for i, x in enumerate(t.split("\n"))]
    want, sets = brute(units, 5, Fraction(4, 5))
    groups = {c for u, c in want.items() if u != c}
    want = {u: c for u, c in want.items() if c in groups}
    rows = queries.op3_substring_dedup(spark, str(tmp_path)).where("kind = 'paragraph'").collect()
    assert {(r.doc_id << 24) + r.paragraph: (r.cluster_doc_id << 24) + r.cluster_paragraph for r in rows} == want
    n_words = {len(WORD.findall(x)) for u, x in units if u in want}
    assert n_words >= {1, 2, 5, 8, 15, 20} and sum(len(sets[u]) > 0 for u in want) == len(want)


def test_no_paragraph_at_the_threshold_is_missed(spark):
    """6,000 pairs of 36 and 45 shingles, 36 of them shared: 0.8 exactly."""
    words = [f"w{i}" for i in range(49 * 6000)]
    lines = [" ".join(words[49 * i : 49 * i + n]) for i in range(6000) for n in (40, 49)]
    found = paragraphs.find_repeats(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert {(r.doc_id, r.cluster_doc_id) for r in found.collect()} == {(i, i - i % 2) for i in range(12000)}


def test_least_hashes_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = rng.integers(0, 1 << 60, n).astype(np.uint64)
        cut = n - int(rng.integers(0, n // 5 + 1))
        more = rng.integers(0, 1 << 60, int(rng.integers(0, max(1, 5 * cut // 4 - n + 1)))).astype(np.uint64)
        pair = [np.sort(x), np.sort(np.concatenate([x[:cut], more]))]
        if 5 * cut >= 4 * (n + len(more)):
            values, count = neardup._least(np.concatenate(pair), np.array([0, n, n + cut + len(more)]), paragraphs.SETTINGS)
            assert {*values[: count[0]].tolist()} & {*values[count[0] :].tolist()}


def test_repeated_passages(spark, tmp_path):
    rng = random.Random(11)
    line = lambda n: " ".join("wé%d" % rng.randrange(10**6) for _ in range(n))
    passages = [line(rng.randrange(50, 90)) for _ in range(12)]
    docs, homes = [], {}
    for i in range(60):
        own = line(rng.randrange(30, 200)).split(" ")
        p = rng.choice(passages) if i % 2 else None
        if p:
            own.insert(rng.randrange(len(own)), p.translate({i: i - 32 for i in range(97, 123)}) if i % 3 else p.replace(" ", "\n", 3))
            homes.setdefault(p, []).append(i)
        docs.append((i, " ".join(own)))
    docs += [(70, None), (71, ""), (72, "short"), (73, line(24)), (74, " ".join(docs[0][1].split(" ")[:20]))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [r for r in queries.op3_substring_dedup(spark, str(tmp_path)).collect() if r.kind == "passage"]
    want = {i: min(own) for own in homes.values() if len(own) > 1 for i in own}
    assert {r.doc_id: r.cluster_doc_id for r in rows} == want
    assert all(r.removed == (r.doc_id != want[r.doc_id]) for r in rows)
    texts = dict(docs)
    for r in rows:
        span = texts[r.doc_id][r.start : r.end].lower().split()
        assert 24 <= len(span) <= 90 and " ".join(span) in " ".join(texts[want[r.doc_id]].lower().split())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.find_passages(empty).count() == 0
    assert paragraphs.find_repeats(empty).count() == 0
    got = {r.doc_id: r.n_shared for r in queries.passage_repeats(spark, str(tmp_path)).collect()}
    runs = {}
    for i, t in docs:
        w = (t or "").lower().split()
        for j in range(len(w) - 49):
            runs.setdefault(" ".join(w[j : j + 50]), []).append(i)
    shared = [i for own in runs.values() if len(set(own)) > 1 for i in own]
    assert got == {i: shared.count(i) for i in set(shared)} and got


def test_passages_are_covered_whole_and_one_copy_stays(spark):
    rng = random.Random(13)
    some = lambda n: ["wé%d" % rng.randrange(10**6) for _ in range(n)]
    passages = [some(n) for n in (50, 51, 60, 80, 120, 200, 400)]
    docs, want = [], {}
    for i in range(40):
        left, p = some(rng.randrange(40)), passages[i % 7]
        docs.append((i, " ".join(left + p + some(rng.randrange(40)))))
        want[i] = set(range(len(left), len(left) + len(p)))
    # 60 has 80 words of 51, of which 50 has the middle ones only
    long = some(80)
    for i, own in ((50, long[25:55]), (51, long), (60, long)):
        left = some(10)
        docs.append((i, " ".join(left + own + some(10))))
        want[i] = set(range(10, 10 + len(own)))
    texts, covered, gone = dict(docs), {}, {}
    for r in paragraphs.find_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        span = texts[r.doc_id][r.start : r.end]
        assert f" {span} " in f" {texts[r.cluster_doc_id]} " and len(span.split()) >= 24
        at = len(texts[r.doc_id][: r.start].split())
        for seen in (covered, gone) if r.removed else (covered,):
            seen.setdefault(r.doc_id, set()).update(range(at, at + len(span.split())))
    assert {i: c for i, c in covered.items() if i != 50} == {i: c for i, c in want.items() if i != 50}
    assert {i: c for i, c in gone.items() if i < 50} == {i: want[i] for i in range(7, 40)} and gone[60] == want[60]
    kept = {w for i, t in docs for k, w in enumerate(t.split()) if k not in gone.get(i, ())}
    assert kept == {w for _, t in docs for w in t.split()}
    frame = spark.createDataFrame([*docs, (90, None), (None, docs[0][1])], "doc_id long, text string")
    clean = {r.doc_id: r.text for r in paragraphs.remove_passages(frame, paragraphs.find_passages(frame)).collect()}
    for i, t in docs:
        assert clean[i].split() == [w for k, w in enumerate(t.split()) if k not in gone.get(i, ())]
    assert clean[90] is None and clean[None] == docs[0][1]


def test_passages_in_another_order_and_in_periods(spark, tmp_path):
    """The same documents share neighbouring passages, but not as neighbours; lines repeat within texts."""
    rng = random.Random(19)
    some = lambda n: " ".join("w%d" % rng.randrange(10**6) for _ in range(n))
    docs = []
    for i in range(0, 120, 3):
        pool = [some(rng.randrange(5, 70)) for _ in range(3)]
        docs += [(i + k, " ".join(rng.choice([*pool, *pool, some(3)]) for _ in range(rng.randrange(2, 9)))) for k in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    runs = {}
    for i, t in docs:
        w = t.split()
        for j in range(len(w) - 49):
            runs.setdefault(" ".join(w[j : j + 50]), []).append(i)
    shared = [i for own in runs.values() if len(set(own)) > 1 for i in own]
    got = {r.doc_id: r.n_shared for r in queries.passage_repeats(spark, str(tmp_path)).collect()}
    assert got == {i: shared.count(i) for i in set(shared)} and len(got) > 60


def test_no_word_is_lost_where_first_documents_change(spark):
    """5 = "B C", 10 = "A B C", 20 = "A B": what is cut from one stands in another."""
    rng = random.Random(17)
    a, b, c = (" ".join("w%d" % rng.randrange(10**6) for _ in range(60)) for _ in range(3))
    docs = {5: f"{b} {c}", 10: f"{a} {b} {c}", 20: f"{a} {b}"}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in paragraphs.remove_passages(frame, paragraphs.find_passages(frame)).collect()}
    assert clean[5] == docs[5] and clean[10].split() == a.split() and clean[20].split() == []


def test_words_are_compared_as_words(spark):
    """Words whose polynomial hashes agree are still different words: no link and no passage."""
    one, other = alike_under_powers()
    docs = [(i, " ".join([*(f"{x}{j}" for j in range(3)), *([w] * 30), f"{x}end"])) for i, (x, w) in enumerate([("p", one), ("q", other)])]
    docs += [(2, one), (3, other), (4, one)]
    got = {r.doc_id: r.component_id for r in neardup.find_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}
    assert paragraphs.find_passages(spark.createDataFrame(docs[:2], "doc_id long, text string")).count() == 0


def test_confirmation_is_on_words():
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(40))
    test = neardup.Verifier(pa.array([text, text.upper().replace(" ", "\n\t"), text + " more", "x y", None]), Settings())
    test.sets = [test.sets[0]] * 5  # were the hashes to collide
    assert [test.linked(0, i) for i in range(5)] == [True, True, True, False, False]


def test_pipeline_form_judges_rows(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (None, text, "c"), (None, other, "d"), (None, other, "e"), (7, None, "f"), (7, "", "g"), (3, other + " x", "h")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __hot string")
    got = sorted(((r.doc_id, r.text) for r in neardup.drop_near_copies(frame).collect()), key=str)
    assert got == sorted([(3, text), (7, None), (7, ""), (3, other + " x")], key=str)
    assert neardup.drop_near_copies(frame.limit(0)).columns == ["doc_id", "text", "__hot"]


def test_winnowing_keeps_its_promise():
    rng = np.random.default_rng(1)
    for _ in range(50):
        shared = rng.integers(0, 1 << 60, 27).astype(np.uint64)
        x, y = (np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 60)).astype(np.uint64), shared, rng.integers(0, 1 << 60, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(2))
        assert {*x[winnow(x, 27)].tolist()} & {*y[winnow(y, 27)].tolist()} & {*shared.tolist()}
        low = [min(x[i : i + 27].tolist()) for i in range(len(x) - 26)]
        assert {*x[winnow(x, 27)].tolist()} == set(low)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_hot_keys_are_repeated(spark):
    """Rows of other keys are joined as they are: no row of theirs is made again, whatever other keys are hot."""
    rng = random.Random(17)
    sizes = {"cold %d" % i: rng.randrange(1, 5) for i in range(300)} | {"edge": 256, "hot a": 257, "hot b": 600, "hot c": 3000, None: 400}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)] + [("alone", 1)] * 300
    left = spark.createDataFrame(rows, "k string, i long")
    right = lambda keys: spark.createDataFrame([(k, len(str(k)), sizes[k]) for k in keys], "k string, v long, w long")
    for keys in (sizes, [k for k in sizes if k and k.startswith("cold")]):
        for how in ("inner", "left"):
            want = [(k, i, len(k) if k and k in keys else None) for k, i in rows if how == "left" or k and k in keys]
            got = split_join(left, right(keys), "k", "w", how)
            assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "Generate" not in plan_of(got)
    hot = split_join(left, right(sizes), "k", "w")
    made = hot._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Generate") == 1 and "Union" in made  # the rows of hot keys alone are repeated


def test_blank_lines_are_told_without_counting_words(spark):
    texts = ["", " ", "\t\x0b\x0c\r ", "a", " \u00a0", "\u2003", "a " * 50, "\x1f", " . "]
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    found = paragraphs.paragraphs(docs)
    assert [texts[r.i] for r in found.orderBy("i").collect()] == [x for x in texts if WORD.search(x)]
    assert "regexp_count" not in plan_of(found)
    assert [r.i for r in paragraphs.paragraphs(docs, min_words=2).collect()] == [6]


def test_prints_of_many_texts_at_once():
    rng = np.random.default_rng(8)
    for width in (1, 2, 27):
        sizes = rng.integers(0, 4 * width, 60)
        gaps = rng.integers(0, 5, 60)
        lo = np.cumsum(sizes + gaps) - sizes
        x = rng.integers(1, 40, int(lo[-1] + sizes[-1]) + 3).astype(np.uint64)
        want = []
        for a, b in zip(lo.tolist(), (lo + sizes).tolist(), strict=True):
            part = x[a:b]
            runs = [part] if 0 < len(part) <= width else [part[i : i + width] for i in range(len(part) - width + 1)]
            least = {a + (i if len(runs) > 1 else 0) + int(j) for i, r in enumerate(runs) for j in np.flatnonzero(r == r.min())}
            want += sorted(least)
        assert winnow_parts(x, lo, lo + sizes, width).tolist() == want


def test_partners_of_blocks_are_those_of_pairs():
    """Blocks are compared as matrices, batch by batch of hashes, with the partners and the order of a loop over pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    for settings in (Settings(), paragraphs.SETTINGS):
        base = rng.integers(0, 1 << 16, (6, settings.hashes)).astype(np.uint16)
        n, steps = 700, settings.least_matches()
        signature = base[rng.integers(0, 6, n)]
        change = rng.random(signature.shape) < rng.choice([0.02, 0.2, 0.5], (n, 1))
        signature[change] = rng.integers(0, 1 << 16, change.sum())
        sizes, component, rep = rng.integers(8, 13, n), rng.integers(0, 9, n), rng.permutation(n)
        for place in (np.zeros(n, dtype=np.int32), (np.arange(n) >= 100).astype(np.int32)):
            right = int(place.max())
            table = pa.table({"left": np.zeros(n, dtype=np.int32), "right": np.full(n, right, dtype=np.int32), "rep": rep, "component": component, "place": place, "n_shingles": sizes, "signature": [x.tobytes() for x in signature]})
            got = {x: y.tolist() for x, y in neardup._partners(table, settings)}
            want = {}
            for x in np.flatnonzero(place == right).tolist():
                y = np.array([y for y in np.flatnonzero(place == 0).tolist() if (right or rep[y] > rep[x]) and component[y] != component[x] and 5 * min(sizes[x], sizes[y]) >= 4 * max(sizes[x], sizes[y])], dtype=np.int64)
                equal = signature[y] == signature[x]
                fit = np.all([equal[:, :m].sum(axis=1) >= least for m, least in steps], axis=0)
                if fit.any():
                    want[x] = y[fit][np.argsort(-equal[fit].sum(axis=1), kind="stable")].tolist()
            assert got == want and want


def test_likely_partners_are_those_of_the_set_test():
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join(near_copies(rng, " ".join("w%d" % rng.randrange(30) for _ in range(20)), 1, 3)) for _ in range(40)] + ["", None, "one", "one", "two words"]
    test = neardup.Verifier(pa.array(texts), Settings(words=1, threshold=Fraction(1, 2)))
    for i in range(len(texts)):
        others = np.array([j for j in range(len(texts)) if j != i])
        rng.shuffle(others)
        likely = test.likely(i, others)
        assert [j for j in others.tolist() if test.linked(i, j)] == [j for j in likely.tolist() if test.linked(i, j)]
        share = lambda j: len({*test.sets[i].tolist()} & {*test.sets[j].tolist()}) * 2 >= len({*test.sets[i].tolist()} | {*test.sets[j].tolist()}) and len(test.sets[j]) > 0
        assert likely.tolist() == [j for j in others.tolist() if share(j)]
