"""Chat formatting: a hidden Markov model over lines recovers who speaks, then turns are rendered.

States are the roles, each once as the first line of a turn and once as a further line, and one state
for "nothing yet". What a line shows is a small vector of features: the speaker marker it begins with,
whether it asks, its length, a blank line or a new source row before it. The Viterbi path over a
conversation's lines gives the turns, which are rendered in one canonical form.

A conversation is cut into chunks. Each is summed up by a max-plus matrix: the best score from any state
before it to any state at its end. Matrices are multiplied level by level, FAN at a time, and the best
states at the borders are handed down again, so that no task holds more than a chunk or FAN matrices,
however long a conversation is.

Null texts count as empty and have no lines; a row without lines gives no turn. A row without a
conversation id is a conversation of its own; a row without a turn is ordered as turn -1. Very long texts are
split into lines in time proportional to their length. An empty table gives no rows. Repeated rows (same id, turn and text) are one row with ``copies``;
different texts of one turn follow in the order of their hash. A chunk of more than MOST_ROWS rows,
which takes that many texts for a few turn numbers, is split by ranges of turn and hash, so that the order
is the same at every size. Extra columns are not read.
"""


from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.text import append_columns
from tessera.session import ship, stage

ROLES = ("system", "user", "assistant")
#: Speaker names at the start of a line, and the role each one tells.
MARKERS = {
    "system": 0,
    "instructions": 0,
    "user": 1,
    "human": 1,
    "customer": 1,
    "question": 1,
    "q": 1,
    "assistant": 2,
    "ai": 2,
    "bot": 2,
    "agent": 2,
    "answer": 2,
    "a": 2,
}
#: A marker: signs, a name, closing signs, and a colon or dash. Nothing in it is tried twice.
_MARKER = re.compile(r"[#>*\-\[<|(\s]*+(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")(?P<close>[\]>|)*\s]*+)(?P<end>[:\-]\s*+\**+\s*+)?", re.IGNORECASE)
#: Turn numbers of a chunk, rows a chunk may have, and matrices multiplied at a time.
CHUNK_TURNS = 64
MOST_ROWS = 4096
FAN = 64
#: The block of turn 0: large, so that no block is negative and all meet at one root, and in the middle of its
#: group at the first levels, so that turns around 0 meet early.
FIRST_BLOCK = (1 << 40) + 33 + 32 * 64 + 32 * 64**2
#: Characters from which a line is of some or of many characters.
SIZES = (60, 160)
NONE = len(ROLES)  # marker value of a line without one
#: States: role r begins a turn (r), goes on with it (r + 3), or nothing was said yet (6).
STATES = 2 * len(ROLES) + 1
OPENING = STATES - 1


@dataclass(frozen=True)
class Model:
    """Chances, here those of a guess; ``learn`` counts them. States 0-2 begin a turn of a role, states 3-5 go on with it."""

    #: How turns follow each other: from role, to role.
    follow: tuple = ((0.02, 0.93, 0.05), (0.02, 0.08, 0.90), (0.02, 0.93, 0.05))
    first: tuple = (0.35, 0.55, 0.10)
    #: Chance that a turn has a further line.
    go_on: tuple = (0.3, 0.4, 0.75)
    #: Chance that a turn's first line bears its role's marker, another's, or none.
    marked: tuple = (0.70, 0.01, 0.29)
    #: Chance that a further line bears any marker.
    marked_on: float = 0.01
    #: Chance of a question mark, by role.
    asks: tuple = (0.05, 0.45, 0.10)
    #: Chances of a line of few, some and many characters, by role.
    sizes: tuple = ((0.40, 0.35, 0.25), (0.30, 0.40, 0.30), (0.10, 0.30, 0.60))
    #: Chance that a line follows a blank line, for first and further lines.
    after_blank: tuple = (0.3, 0.1)
    #: Chance that a line begins a new row of the source table, for first and further lines.
    new_row: tuple = (0.9, 0.002)

    def transitions(self) -> np.ndarray:
        n = len(ROLES)
        out = np.full((STATES, STATES), -np.inf)
        out[OPENING, :n] = np.log(self.first)
        for a in range(n):
            for s in (a, a + n):
                out[s, a + n] = np.log(self.go_on[a])
                for b in range(n):
                    out[s, b] = np.log((1 - self.go_on[a]) * self.follow[a][b])
        return out

    def emissions(self, lines: np.ndarray) -> np.ndarray:
        """Log chances of lines (marker, asks, size, after blank, new row) in each state."""
        n, marker = len(ROLES), lines[:, 0]
        out = np.zeros((len(lines), STATES))
        out[:, OPENING] = -np.inf
        for s in range(2 * n):
            role, further = s % n, s >= n
            if further:
                out[:, s] += np.where(marker == NONE, np.log(1 - self.marked_on), np.log(self.marked_on / n))
            else:
                own, other, none = self.marked
                out[:, s] += np.where(marker == NONE, np.log(none), np.where(marker == role, np.log(own), np.log(other / (n - 1))))
            out[:, s] += np.log(self.sizes[role])[lines[:, 2]]
            for k, p in ((1, self.asks[role]), (3, self.after_blank[further]), (4, self.new_row[further])):
                out[:, s] += np.where(lines[:, k] == 1, np.log(p), np.log(1 - p))
        return out


def marker(line: str) -> tuple[int, int] | None:
    """The role that a line's marker tells, and where the marker ends; None without one."""
    m = _MARKER.match(line)
    if m is None or not (m["end"] or any(c in "]>|" for c in m["close"])):
        return None
    return MARKERS[m[1].lower()], m.end()


#: Bounds of the labelled sample: hash buckets, of each of which one conversation is taken, its turns, and their characters.
SAMPLE_CONVERSATIONS = 512
SAMPLE_TURNS = 64
SAMPLE_CHARACTERS = 4000


def learn(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> Model:
    """A model counted from a bounded sample of labelled turns, each count begun with a half of the guess's chances.

    ``turns`` has a role per row. Without labelled turns the guess stays.
    """
    source = turns.select(F.col(conversation).cast("string").alias("c"), F.col(turn).cast("long").alias("t"), F.col(role).alias("r"), F.substring(F.col(text), 1, SAMPLE_CHARACTERS).alias("x"))
    source = source.where(F.col("c").isNotNull() & F.col("t").between(0, SAMPLE_TURNS - 1) & F.col("r").isin(list(ROLES)) & F.col("x").isNotNull()).withColumn("m", F.xxhash64("c", F.lit(13)))
    least = source.groupBy(F.pmod("m", F.lit(SAMPLE_CONVERSATIONS)).alias("b")).agg(F.min("m").alias("m")).collect()
    if not least:
        return Model()
    rows = source.where(F.col("m").isin([r.m for r in least])).groupBy("m", "t").agg(F.min(F.struct("x", "r")).alias("v")).orderBy("m", "t").collect()
    return counted([(r.m, r.v.r, r.v.x) for r in rows])


def counted(rows: list[tuple[object, str, str]]) -> Model:
    """A model counted from turns (conversation, role, text) in order."""
    guess = Model()
    half = lambda x: 0.5 * np.array(x, dtype=float)
    follow, first, marked, sizes = half(guess.follow), half(guess.first), half(guess.marked), half(guess.sizes)
    pair = lambda p: np.stack([half(1 - np.array(p)), half(p)], axis=-1)
    go_on, asks, blank, fresh = pair(guess.go_on), pair(guess.asks), pair(guess.after_blank), pair(guess.new_row)
    marked_on = half([1 - guess.marked_on, guess.marked_on])
    before, last = object(), 0
    for own, name, text in rows:
        lines, role = split_lines(text), ROLES.index(name)
        if not lines:
            continue
        if own == before:
            follow[last, role] += 1
        else:
            first[role] += 1
        before, last = own, role
        go_on[role] += (1, len(lines) - 1)
        for k, (_, (marker, ask, size, after)) in enumerate(lines):
            further = int(k > 0)
            if further:
                marked_on[int(marker != NONE)] += 1
            else:
                marked[2 if marker == NONE else 0 if marker == role else 1] += 1
            asks[role, ask] += 1
            sizes[role, size] += 1
            blank[further, after] += 1
            fresh[further, int(k == 0)] += 1
    share = lambda x: tuple(map(tuple, x / x.sum(axis=-1, keepdims=True))) if x.ndim > 1 else tuple(x / x.sum())
    least = lambda x: tuple(np.clip(x[:, 1] / x.sum(axis=1), 1e-3, 1 - 1e-3))
    return Model(share(follow), share(first), least(go_on), share(marked), float(np.clip(marked_on[1] / marked_on.sum(), 1e-3, 0.5)), least(asks), share(sizes), least(blank), least(fresh))


def held_out(key: str = "conv_id", folds: int = 5) -> Column:
    """Conversations kept from learning: the crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def split_lines(text: str) -> list[tuple[str, tuple[int, int, int, int]]]:
    """Non-blank lines with (marker, asks, size, after blank)."""
    out, blank = [], 0
    for line in text.split("\n"):
        if not line.strip():
            blank = 1
            continue
        m = marker(line)
        out.append((line, (m[0] if m else NONE, int("?" in line), bisect_right(SIZES, len(line)), blank)))
        blank = 0
    return out


def strip_marker(line: str) -> str:
    m = marker(line)
    return line[m[1] :] if m else line


def transfer(model: Model, lines: np.ndarray) -> np.ndarray:
    """Best scores from each state before the lines to each state at their end."""
    move, emit = model.transitions(), model.emissions(lines)
    out = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for e in emit:
        out = (out[:, :, None] + move[None]).max(axis=1) + e
    return out


def _walk(steps: list[np.ndarray], entry: int, last: int | None) -> list[int]:
    """The best states after each step (a matrix of scores), from one state to another or to the best."""
    score, back = np.full(STATES, -np.inf), []
    score[entry] = 0.0
    for step in steps:
        total = score[:, None] + step
        back.append(total.argmax(axis=0))
        score = total.max(axis=0)
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi(model: Model, lines: np.ndarray, entry: int = OPENING, last: int | None = None) -> list[int]:
    """The best state of each line, given the state before them and, if known, the last one's."""
    move = model.transitions()
    return _walk([move + e for e in model.emissions(lines)], entry, last) if len(lines) else []


def render(role: str, lines: list[str]) -> str:
    """A turn in canonical form."""
    return f"<|{role}|>\n" + "\n".join([strip_marker(lines[0]), *lines[1:]]).strip() + "\n<|end|>\n"


_TURN = pa.list_(pa.struct([("turn", pa.int64()), ("copies", pa.int64()), ("line", pa.int32()), ("begins", pa.bool_()), ("role", pa.string()), ("text", pa.string())]))
TURN = T.ArrayType(T.StructType([T.StructField("turn", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("begins", T.BooleanType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _lines(rows: list[dict]) -> tuple[list[tuple[int, int, int, str]], np.ndarray]:
    """A chunk's lines as (turn, copies, line number, line), and their features."""
    out, features = [], []
    for row in rows:
        for n, (line, f) in enumerate(split_lines(row["text"] or "")):
            out.append((row["turn"], row["copies"], n, line))
            features.append((*f, int(n == 0)))
    return out, np.array(features, dtype=np.int64).reshape(-1, 5)


def _pieces(model: Model, rows: list[dict], entry: int, last: int | None) -> list[dict]:
    """Runs of lines of one source row and one recovered turn, rendered where a turn begins."""
    lines, features = _lines(rows)
    states = viterbi(model, features, entry, last)
    out: list[dict] = []
    for (turn, copies, n, line), s in zip(lines, states, strict=True):
        begins, role = s < len(ROLES), ROLES[s % len(ROLES)]
        if begins or n == 0:
            out.append({"turn": turn, "copies": copies, "line": n, "begins": begins, "role": role, "own": []})
        out[-1]["own"].append(line)
    for piece in out:
        own = piece.pop("own")
        piece["text"] = render(piece["role"], own) if piece["begins"] else "\n".join(own)
    return out


def _chunks(source: DataFrame, size: int) -> DataFrame:
    """Rows (conv, block, sub, rows): the source rows of a chunk, in order."""
    rows = source.groupBy("conv", "turn", "text").agg(F.count("*").alias("copies")).withColumn("t", F.coalesce("turn", F.lit(-1).cast("long")))
    rows = rows.withColumn("block", F.floor(F.col("t") / size) + FIRST_BLOCK)
    rows = rows.withColumn("h", F.xxhash64("text"))
    each = rows.groupBy("conv", "block", "t").agg(F.count("*").alias("c"))
    large = each.groupBy("conv", "block").agg(F.sum("c").alias("all")).where(F.col("all") > MOST_ROWS).select("conv", "block")
    parts = each.join(large, ["conv", "block"], "left_semi").select("conv", "block", "t", F.ceil(F.col("c") * 2 / MOST_ROWS).alias("parts"))
    prefix = F.floor((F.col("h") / float(1 << 64) + 0.5) * F.col("parts"))  # grows with the hash
    sub = F.shiftleft(F.pmod("t", F.lit(size)).cast("long"), 40) + prefix
    rows = rows.join(parts, ["conv", "block", "t"], "left").withColumn("sub", F.coalesce(sub, F.lit(0).cast("long")))
    return rows.groupBy("conv", "block", "sub").agg(F.sort_array(F.collect_list(F.struct("t", "h", "text", "copies", "turn"))).alias("rows"))


def format_chats(turns: DataFrame, model: Model = Model(), *, conversation: str = "conv_id", turn: str = "turn", text: str = "text", chunk_turns: int = CHUNK_TURNS, fan: int = FAN) -> DataFrame:
    """Rows (conv, turn, copies, line, begins, role, text): recovered turns, in canonical form.

    A row is a run of lines of one source row (numbered ``turn``, from non-blank line ``line``) that
    belongs to one recovered turn. ``begins`` tells that the turn begins here; ``text`` is then rendered,
    else it has the further lines as they are.
    """
    ship(turns.sparkSession)
    source = turns.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{text}`").alias("text"))
    chunks = stage(_chunks(source.where("conv is not null"), chunk_turns), "chunks")
    counts = chunks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")

    def decode(batch: pa.RecordBatch) -> list[pa.Array]:
        names = ("rows", "entry", "last")
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
        return [pa.array([_pieces(model, rows, entry, last) for rows, entry, last in zip(*columns, strict=True)], _TURN)]

    alone = chunks.join(counts, "conv", "left_anti").select("conv", "rows", F.lit(OPENING).alias("entry"), F.lit(None).cast("int").alias("last"))
    if not counts.isEmpty():
        long = chunks.join(counts, "conv", "left_semi")
        borders = _borders(long, model, fan)
        alone = alone.unionByName(long.join(borders, ["conv", "block", "sub"]).select("conv", "rows", "entry", "last"))
    own = F.array(F.struct(F.coalesce("turn", F.lit(-1).cast("long")).alias("t"), F.xxhash64("text").alias("h"), "text", F.lit(1).cast("long").alias("copies"), "turn"))
    nameless = source.where("conv is null").select("conv", own.alias("rows"), F.lit(OPENING).alias("entry"), F.lit(None).cast("int").alias("last"))
    out = append_columns(alone.unionByName(nameless), [T.StructField("pieces", TURN)], decode, needs=["rows", "entry", "last"])
    return out.select("conv", F.explode("pieces").alias("p")).select("conv", "p.*")


def _borders(chunks: DataFrame, model: Model, fan: int) -> DataFrame:
    """Rows (conv, block, sub, entry, last): the best states before and at the end of each chunk."""

    def sums(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = batch.column(batch.schema.get_field_index("rows")).to_pylist()
        return [pa.array([transfer(model, _lines(r)[1]).ravel().tolist() for r in rows], pa.list_(pa.float64()))]

    matrix = T.StructField("matrix", T.ArrayType(T.DoubleType()))
    level = append_columns(chunks, [matrix], sums, needs=["rows"]).select("conv", F.col("block").alias("i"), "sub", "matrix")
    levels = [stage(level, "level")]
    while True:
        # the keys of a level: (i, sub), then i alone
        top = levels[-1].groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if top == 1:
            break
        up = levels[-1].groupBy("conv", F.floor(F.col("i") / fan).alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "sub", "matrix"))).alias("m"))

        def product(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for row in batch.column(batch.schema.get_field_index("m")).to_pylist():
                total = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
                for x in row:
                    total = (total[:, :, None] + np.array(x["matrix"]).reshape(1, STATES, STATES)).max(axis=1)
                out.append(total.ravel().tolist())
            return [pa.array(out, pa.list_(pa.float64()))]

        levels.append(stage(append_columns(up, [matrix], product, needs=["m"]).select("conv", F.col("p").alias("i"), F.lit(0).cast("long").alias("sub"), "matrix"), "level"))
    known = levels[-1].select("conv", "i", "sub", F.lit(OPENING).alias("entry"), F.lit(None).cast("int").alias("last"))
    for level in reversed(levels[:-1]):
        grouped = level.groupBy("conv", F.floor(F.col("i") / fan).alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "sub", "matrix"))).alias("m"))
        joined = grouped.join(known.select("conv", F.col("i").alias("p"), "entry", "last"), ["conv", "p"])

        def hand_down(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("m", "entry", "last"))
            for row, entry, last in zip(*columns, strict=True):
                path = _walk([np.array(x["matrix"]).reshape(STATES, STATES) for x in row], entry, last)
                out.append([{"i": x["i"], "sub": x["sub"], "entry": a, "last": b} for x, a, b in zip(row, [entry, *path[:-1]], path, strict=True)])
            return [pa.array(out, pa.list_(pa.struct([("i", pa.int64()), ("sub", pa.int64()), ("entry", pa.int32()), ("last", pa.int32())])))]

        kind = T.ArrayType(T.StructType([T.StructField("i", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("entry", T.IntegerType()), T.StructField("last", T.IntegerType())]))
        known = stage(append_columns(joined, [T.StructField("b", kind)], hand_down, needs=["m", "entry", "last"]).select("conv", F.explode("b").alias("x")).select("conv", "x.*"), "known")
    return known.select("conv", F.col("i").alias("block"), "sub", "entry", "last")
