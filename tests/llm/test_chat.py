"""Role recovery against exhaustive search, and in chunks against whole conversations."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
from tessera.llm import chat, queries


def test_viterbi_is_the_best_of_all_paths():
    model, rng = chat.Model(), random.Random(3)
    move = model.transitions()
    for _ in range(12):
        n = rng.randrange(1, 5)
        lines = np.array([[rng.randrange(4), rng.randrange(2), rng.randrange(3), rng.randrange(2), rng.randrange(2)] for _ in range(n)])
        emit = model.emissions(lines)

        def score(path):
            total, at = 0.0, chat.OPENING
            for s, e in zip(path, emit, strict=True):
                total += move[at, s] + e[s]
                at = s
            return total

        best = max(score(p) for p in itertools.product(range(chat.STATES), repeat=n))
        assert abs(score(chat.viterbi(model, lines)) - best) < 1e-9


def test_markers():
    assert [f[0] for _, f in chat.split_lines("User: hi\n\n**Assistant:** yes\n[System] x\nbare?")] == [1, 2, 0, chat.NONE]
    assert chat.strip_marker("### Human: hello") == "hello"
    assert [chat.strip_marker(x) for x in ("[user] a", "<|assistant|> b", "**Q** - c", "(bot): d", "agent smith", "a b", "AI> e", "  Answer:f")] == ["a", "b", "c", "d", "agent smith", "a b", "e", "f"]
    assert chat.render("user", ["Q: what?", "more"]) == "<|user|>\nwhat?\nmore\n<|end|>\n"


def test_long_lines_take_linear_time():
    n = 1_000_000
    for text in (" " * n + "x", "#" * n + "user", "user" + " " * n, "user" + "] " * n + "x", " \t" * n + "\n" + "a " * n, "* " * n + "\n" * n):
        start = time.perf_counter()
        chat.split_lines(text)
        assert time.perf_counter() - start < 5


def conversation(n):
    who = ["User", "Assistant"]
    return [(1, i, f"{who[i % 2]}: line {i}{'?' if i % 2 == 0 else ''}\nmore {i}") for i in range(n)]


def test_chunks_agree_with_whole_conversations(spark):
    rows = [*conversation(40), (2, -3, "hi there?"), (2, 5, "sure\n\nBot: yes"), (2, 5, "other"), (2, 5, "other"), (3, 0, None), (3, 1, ""), (None, 1, "x"), (4, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    key = lambda r: str((r.conv, r.turn, r.copies, r.line, r.text))
    whole = sorted(chat.format_chats(turns).collect(), key=key)
    assert whole == sorted(chat.format_chats(turns, chunk_turns=2, fan=2).collect(), key=key)
    first = sorted((r for r in whole if r.conv == 1), key=lambda r: r.turn)
    assert [r.role for r in first] == ["user", "assistant"] * 20 and all(r.begins for r in first)
    assert first[0].text == "<|user|>\nline 0?\nmore 0\n<|end|>\n"
    assert sum(r.copies for r in whole if r.conv == 2 and "other" in r.text) == 2
    assert {r.conv for r in whole} == {1, 2, 4, None}
    assert [(r.turn, r.copies, r.line) for r in whole if r.conv == 4] == [(None, 1, 0)]
    assert [(r.turn, r.copies, r.text) for r in whole if r.conv is None] == [(1, 1, chat.render("system", ["x"]))]


def test_large_blocks_agree_with_whole_ones(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda: rng.choice(["", "User: ", "Assistant: ", "System: "]) + "x" * rng.randrange(1, 200) + rng.choice(["", "?", "\nmore", "\n\nBot: yes"]) + str(rng.random())
    rows = [(1, i, text()) for i in range(-20, 30) for _ in range(rng.randrange(1, 5))] + [(1, 3, text()) for _ in range(60)] + [(2, 0, text()) for _ in range(5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    key = lambda r: (r.conv, r.turn, r.line, r.text)
    whole = sorted(chat.format_chats(turns).collect(), key=key)
    monkeypatch.setattr(chat, "MOST_ROWS", 8)
    assert sorted(chat.format_chats(turns, fan=4).collect(), key=key) == whole
    subs = chat._chunks(turns.withColumnRenamed("conv_id", "conv"), chat.CHUNK_TURNS).collect()
    order = [(r.turn, r.h) for c in sorted((c for c in subs if c.conv == 1), key=lambda c: (c.block, c.sub)) for r in c.rows]
    assert order == sorted(order) and max(len(c.rows) for c in subs) <= 16


def test_query_and_empty_table(spark, tmp_path):
    rows = [(*r, "assistant" if r[1] % 2 else "user") for r in conversation(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string, role string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op2_chat_format(spark, str(tmp_path)).count() == 4
    empty = spark.createDataFrame([], "conv_id long, turn long, text string")
    assert chat.format_chats(empty).count() == 0


def test_held_out_accuracy(spark):
    """Roles of conversations that were not learned, from text alone, and without any marker."""
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    model = chat.learn(turns.where(~chat.held_out()))
    own = turns.where(chat.held_out())
    role = {(r.conv_id, r.turn): r.role for r in own.collect()}
    rows = [r for r in chat.format_chats(own, model).collect() if r.line == 0]
    right = np.mean([role[r.conv, r.turn] == r.role for r in rows])
    assert len(rows) == len(role) and right > 0.95, right
    assert chat.learn(turns.limit(0)) == chat.Model()


def test_counts():
    """Chances are counts, each begun with a half of the guess."""
    rows = [(1, "user", "User: a?"), (1, "assistant", "Bot: b\n\nmore"), (1, "user", "c"), (2, "system", "x" * 200), (2, "user", "Assistant: odd"), (2, "user", "")]
    guess, model = chat.Model(), chat.counted(rows)
    assert np.allclose(model.first, (np.array([1, 1, 0]) + 0.5 * np.array(guess.first)) / 2.5)
    assert np.allclose(model.follow[1], (np.array([0, 0, 1]) + 0.5 * np.array(guess.follow[1])) / 1.5)
    assert np.allclose(model.marked, (np.array([2, 1, 2]) + 0.5 * np.array(guess.marked)) / 5.5)
    assert np.isclose(model.go_on[2], (1 + 0.5 * guess.go_on[2]) / 2.5) and np.isclose(model.asks[1], (1 + 0.5 * guess.asks[1]) / 3.5)
    assert np.isfinite(model.emissions(np.array([[3, 0, 0, 0, 0]]))[:, :6]).all()
