"""Edit-aware counts against full re-encoding."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F
from tessera.llm import queries
from tessera.llm.packing import encode, load_encoder
from tessera.llm.tokencount import CountTree, apply_edits, build_trees, count_edits

ENCODER = load_encoder()
PARTS = ["a", "é", " ", "\n", "1", "²", ".", "'s", "  ", "Z", "\t", "'", "の", "!!", "<|endoftext|>", "s ", "'ll", "word", " word", "e\u0301"]


def count(parts):
    return [len(encode(ENCODER, p)) for p in parts]


def test_random_edits():
    rng = random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 200)))
        tree = CountTree(text, count, least=rng.choice([1, 3, 8, 64]))
        assert tree.total == count([text])[0]
        for _ in range(4):
            a = rng.randrange(0, len(text) + 2)
            b = a + rng.randrange(0, 20)
            new = "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 6)))
            text = text[:a] + new + text[max(a, b) :]
            tree.replace(a, b, new)
            assert tree.text == text and tree.total == count([text])[0] and tree.chars[1] == len(text)
            for sums in (tree.tokens, tree.chars):
                assert (sums[1 : tree.size] == sums[2:].reshape(-1, 2).sum(axis=1)).all()
            if rng.random() < 0.3:  # kept and read again
                tree = CountTree(text, count, (tree.tokens.tolist(), tree.chars.tolist()), least=tree.least)


def test_edits_touch_little_of_a_long_text():
    text = " ".join(["lorem", "ipsum", "dolor"] * 20_000)
    tree = CountTree(text, count)
    built = tree.encoded
    tree.replace(len(text) // 2, len(text) // 2 + 5, "changed")
    assert tree.encoded - built < 1000 and tree.total == count([tree.text])[0]
    size, sums = tree.size, tree.tokens
    tree.replace(1000, 1010, " " + "more words " * 30)  # some more segments find room in the same leaves
    assert tree.size == size and tree.tokens is sums and tree.total == count([tree.text])[0]


def test_many_edits_of_a_long_text_take_little_time():
    text = " ".join(["lorem", "ipsum", "dolor"] * 40_000)
    tree = CountTree(text, count)
    start, rng = time.perf_counter(), random.Random(3)
    for _ in range(2000):
        at = rng.randrange(int(tree.chars[1]))
        tree.replace(at, at + rng.randrange(9), rng.choice([" x", "", "yz", " new words here "]))
    assert time.perf_counter() - start < 10 and tree.total == count([tree.text])[0]


def test_kept_trees(spark):
    docs = spark.createDataFrame([(1, "some words " * 40), (2, None), (2, None), (3, "")], "doc_id long, text string")
    kept = build_trees(docs)
    edit = lambda a, b, new: F.array(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(new).alias("new")))
    once = apply_edits(kept.withColumn("edits", edit(3, 5, " two")))
    again = apply_edits(once.select("doc_id", F.col("text_after").alias("text"), F.col("tree_after").alias("tree"), edit(0, 0, "first ").alias("edits")))
    for r in again.collect():
        text = "first " + {1: "som two" + ("some words " * 40)[5:], 2: " two", 3: " two"}[r.doc_id]
        assert r.text_after == text and r.n_tokens_after == count([text])[0] and r.tree_after.tokens[1] == r.n_tokens_after
        assert r.chars_encoded < 250
    assert apply_edits(docs.withColumn("tree", F.lit(None).cast(kept.schema["tree"].dataType)).withColumn("edits", edit(0, 0, "a"))).where("doc_id = 1").first().n_tokens == count(["some words " * 40])[0]
    assert build_trees(docs.limit(0)).count() == 0 and apply_edits(kept.limit(0).withColumn("edits", edit(0, 0, "a"))).count() == 0


def test_frames(spark, tmp_path):
    rows = [(1, "one two three", [(4, 7, "2"), (100, 200, "!")], "x"), (2, None, [(0, 5, "new")], "x"), (3, "", None, "x"), (4, "same", [None], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:long,end:long,new:string>>, n_tokens string")
    got = {r.doc_id: r for r in count_edits(docs).collect()}
    assert got[1].text_after == "one 2 three!" and got[1].n_tokens_after == count(["one 2 three!"])[0]
    assert (got[2].n_tokens, got[2].text_after) == (0, "new") and (got[3].n_tokens, got[3].n_tokens_after) == (0, 0)
    assert got[4].n_tokens == got[4].n_tokens_after == count(["same"])[0]
    spark.createDataFrame([(1, "Some words here, and more. " * 30), (2, None), (3, "a")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op5_token_counts(spark, str(tmp_path)).collect():
        text = {1: "Some words here, and more. " * 30, 2: "", 3: "a"}[r.doc_id]
        n = len(text)
        edited = text[: n // 3] + " revised" + text[n // 3 + 6 : n * 2 // 3] + text[n * 2 // 3 + 3 :] + "\nSeen 2024."
        if n > 30:
            assert r.n_tokens == count([text])[0] and r.n_tokens_after == count([edited])[0]
