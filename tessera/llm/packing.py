"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

The driver sees the histogram alone: at most one count per length up to the capacity, however many
documents there are. The program's columns (configurations: how many pieces of each length share a
sequence) cover every length as often as it occurs, with as few sequences as possible. It is solved by
multiplicative weights: lengths have prices, a knapsack dynamic program gives the configurations of the
highest price, small steps are taken along them, prices of covered lengths fall, and the steps' mean is the
fractional solution. Prices divided by the best configuration's are a feasible dual, so that each round also
gives a lower bound on the sequences. The mean is rounded, what rounding leaves is placed by best fit in
decreasing length, and rounds end once the plan is within GAP of the bound. Plain best fit is taken where it
is better. Documents then take the places of their length by rank: pieces are dealt by ranges of length and
a hash, numbered within their range, and the ranges' counts per length (a few numbers a range) make those
numbers ranks of the whole.

Ids are the tokenizer's: strings of special tokens in a text, like ``<|endoftext|>``, give their special id.
Null texts count as empty; an empty text is one end token. Repeated documents are packed each on its
own. A column of the input that bears the name of an output column is replaced. An empty table gives
no sequence. Very long texts are encoded whole, some at a time by Arrow batch.
"""

from __future__ import annotations

import base64
import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.text import append_columns
from tessera.session import stage

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json, whose ids it gives
SPECIAL = {"<|endoftext|>": 50256}  # that tokenizer's only special token
#: Rounds end when the plan has at most this share more sequences than the bound, or after so many rounds.
GAP = 0.001
ROUNDS = 160
CHECK_EVERY = 20
#: Configurations whose price is this near to the best are taken as well; how fast prices fall.
NEAR_BEST = 0.01
RATE = 0.3


def load_encoder(vocabulary: str | None = None, special: dict[str, int] | None = None):
    """A byte-level BPE encoder from a rank file (default: the public 50k one, with its special token)."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path(VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL if special is None else special)


def encode(encoder, text: str) -> list[int]:
    """The ids of a text, as the tokenizer gives them without added tokens."""
    return encoder.encode(text, allowed_special="all")


# --- the plan over the histogram -----------------------------------------------------------------


@dataclass
class Prices:
    """The knapsack table under some prices: the best price within each capacity, and the last piece chosen."""

    lengths: np.ndarray
    best: np.ndarray
    choice: np.ndarray  # number of a length, at capacities where the best price rises
    at: np.ndarray  # the nearest such capacity below

    @staticmethod
    def of(lengths: np.ndarray, values: np.ndarray, capacity: int) -> Prices:
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
        usable = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for c in range(int(lengths[0]), capacity + 1):
            k = usable[c]
            total = best[c - lengths[:k]] + values[:k]
            j = int(total.argmax())
            if total[j] > best[c - 1]:
                best[c], choice[c] = total[j], j
            else:
                best[c] = best[c - 1]
        at = np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))
        return Prices(lengths, best, choice, at)

    def configurations(self, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best configuration with a piece of each of some lengths: (its number, length, pieces) in order."""
        m, capacity = len(self.lengths), len(self.best) - 1
        live, left = np.arange(len(firsts)), capacity - self.lengths[firsts]
        owner, item = [live], [firsts]
        while len(live):
            c = self.at[left[live]]
            j = self.choice[c]
            live, c, j = live[j >= 0], c[j >= 0], j[j >= 0]
            owner.append(live)
            item.append(j)
            left[live] = c - self.lengths[j]
        key, pieces = np.unique(np.concatenate(owner) * m + np.concatenate(item), return_counts=True)
        return key // m, key % m, pieces


def knapsack(lengths: np.ndarray, values: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable multiset of lengths within the capacity."""
    prices = Prices.of(lengths, values, capacity)
    out: dict[int, int] = {}
    c = int(prices.at[capacity])
    while prices.choice[c] >= 0:
        size = int(lengths[prices.choice[c]])
        out[size] = out.get(size, 0) + 1
        c = int(prices.at[c - size])
    return out


def first_prices(lengths: np.ndarray, count: np.ndarray, capacity: int, most: int = 8) -> np.ndarray:
    """Dual feasible prices to begin with: shares of the capacity, or these in steps of 1/k, whichever bounds more."""
    found = [lengths / capacity]
    for k in range(1, most + 1):
        scaled = lengths * (k + 1)
        found.append(np.where(scaled % capacity == 0, lengths / capacity, scaled // capacity / k))
    best = max(found, key=lambda x: float((x * count).sum()))
    return np.maximum(best, 1e-6 * lengths / capacity)


@dataclass
class Solution:
    """Fractional configurations that cover each length ``covered`` times as often as it occurs, and the dual bound."""

    lengths: np.ndarray
    used: dict[tuple[tuple[int, int], ...], float]
    covered: np.ndarray
    bound: float


def solve(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, enough: Callable[[Solution], bool] = lambda _: False) -> Solution:
    """The covering program by multiplicative weights, until ``enough`` says so or the rounds are over.

    A round prices configurations by the knapsack table and takes those within NEAR_BEST of the best, one for
    each length that has such, with steps so small that no length is covered more than once a round. A price
    falls by exp(-RATE) for each time its length is covered.
    """
    lengths = np.array(sorted(x for x in histogram if x < capacity), dtype=np.int64)
    out = Solution(lengths, {}, np.zeros(len(lengths)), 0.0)
    if not len(lengths):
        return out
    count = np.array([histogram[x] for x in lengths.tolist()], dtype=np.float64)
    price = first_prices(lengths, count, capacity)
    for k in range(rounds):
        table = Prices.of(lengths, price, capacity)
        most = table.best[-1]
        out.bound = max(out.bound, float((count * price).sum() / most))
        taken = np.flatnonzero(price + table.best[capacity - lengths] >= (1 - NEAR_BEST) * most)
        owner, item, pieces = table.configurations(taken)
        mine = np.zeros(len(taken))
        own = item == taken[owner]
        mine[owner[own]] = pieces[own]
        times = count[taken] / mine
        for _ in range(3):  # no length is to be covered more than once
            cover = np.bincount(item, times[owner] * pieces, minlength=len(lengths)) / count
            worst = np.ones(len(taken))
            np.maximum.at(worst, owner, cover[item])
            times = times / worst
        cover = np.bincount(item, times[owner] * pieces, minlength=len(lengths)) / count
        out.covered += cover
        price = price * np.exp(-RATE * cover)
        price /= price.max()
        first = np.searchsorted(owner, np.arange(len(taken) + 1))
        for i in range(len(taken)):
            part = slice(first[i], first[i + 1])
            config = tuple(zip(lengths[item[part]].tolist(), pieces[part].tolist(), strict=True))
            out.used[config] = out.used.get(config, 0.0) + float(times[i])
        if (k + 1) % CHECK_EVERY == 0 and enough(out):
            break
    return out


def round_off(solution: Solution, histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations near to the fractional ones, and best fit for the rest; of some scales, the best."""
    best: list[tuple[dict[int, int], int]] | None = None
    ranked = sorted(solution.used.items(), key=lambda x: (-x[1], x[0]))
    scales = np.unique(np.quantile(solution.covered, (0.0, 0.25, 0.5, 0.75, 1.0))) if len(solution.covered) else []
    for scale in scales:
        if scale <= 0:
            continue
        left, used = dict(histogram), []
        for config, times in ranked:
            whole = min([int(times / scale + 0.5), *(left[x] // n for x, n in config)])
            if whole:
                used.append((dict(config), whole))
                for x, n in config:
                    left[x] -= n * whole
        used += best_fit_decreasing({x: n for x, n in left.items() if n}, capacity)
        if best is None or sum(n for _, n in used) < sum(n for _, n in best):
            best = used
    return best if best is not None else best_fit_decreasing(histogram, capacity)


@dataclass
class Plan:
    """Configurations and how often each is used, in the order of sequence numbers."""

    capacity: int
    used: list[tuple[dict[int, int], int]]
    #: A lower bound on the sequences of any plan, from the prices.
    bound: float = 0.0

    @property
    def gap(self) -> float:
        """By what share the plan may exceed the best one."""
        least = math.ceil(self.bound - 1e-6)
        return self.sequences / least - 1 if least else 0.0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.used)

    def table(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, pieces per sequence, offset), by length and rank."""
        rows, rank, sequence = [], {}, 0
        for config, times in self.used:
            offset = 0
            for length, each in sorted(config.items(), reverse=True):
                rows.append((length, rank.get(length, 0), sequence, each, offset))
                rank[length] = rank.get(length, 0) + each * times
                offset += length * each
            sequence += times
        rows.sort()
        return np.array(rows, dtype=np.int64).reshape(-1, 5)


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit in decreasing length over counts: bins that look alike are handled as one group."""
    spaces: list[int] = []
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}
    closed: list[tuple[dict[int, int], int]] = []

    def put(config: dict[int, int], n: int, space: int) -> None:
        if not space:
            closed.append((config, n))
            return
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        groups[space].append((config, n))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                config, n = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(at)
            else:
                config, n, space = {}, 1 << 62, capacity
            each = space // length
            full = min(n, left // each)
            if full:
                put(config | {length: each}, full, space - each * length)
                left -= full * each
                n -= full
            if n and left and left < each:
                put(config | {length: left}, 1, space - left * length)
                left, n = 0, n - 1
            if n and config:
                put(config, n, space)
    return closed + [x for s in spaces for x in groups[s]]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, gap: float = GAP) -> Plan:
    """A plan for all pieces of the histogram (length to count), never of more sequences than best fit gives."""
    left = {x: n for x, n in histogram.items() if n}
    if any(x < 1 or x > capacity for x in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    full = [({capacity: 1}, left.pop(capacity))] if left.get(capacity) else []
    plain = best_fit_decreasing(left, capacity)
    found: list[Plan] = []

    def enough(solution: Solution) -> bool:
        found.append(Plan(capacity, round_off(solution, left, capacity), solution.bound))
        return min(found, key=lambda p: p.sequences).sequences <= math.ceil(solution.bound - 1e-6) * (1 + gap)

    solution = solve(left, capacity, rounds, enough)
    if rounds % CHECK_EVERY:
        enough(solution)
    best = min([*found, Plan(capacity, plain)], key=lambda p: p.sequences)
    return Plan(capacity, full + best.used, solution.bound + sum(n for _, n in full))


# --- documents -------------------------------------------------------------------------------------


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
_PIECES = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def tokenize(docs: DataFrame, *, text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """``docs`` with ``pieces``: where each piece starts, its length and the crc32 of its ids.

    With ``keep_ids`` the ids themselves are added as the column ``ids``, end token included.
    """
    encoder: list = []

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        if not encoder:
            encoder.append(load_encoder(vocabulary))
        rows, all_ids = [], []
        for v in batch.column(batch.schema.get_field_index(text)):
            ids = np.array([*encode(encoder[0], v.as_py() or ""), END_ID], dtype="<u4")
            start, pieces = 0, []
            for k, n in enumerate(cut(len(ids), capacity)):
                pieces.append({"piece": k, "start": start, "length": n, "ids_crc32": zlib.crc32(ids[start : start + n].tobytes())})
                start += n
            rows.append(pieces)
            if keep_ids:
                all_ids.append(ids.astype(np.int64))
        return [pa.array(rows, _PIECES)] + ([pa.array(all_ids, pa.list_(pa.int64()))] if keep_ids else [])

    fields = [T.StructField("pieces", T.ArrayType(PIECE))] + [T.StructField("ids", T.ArrayType(T.LongType()))] * keep_ids
    return append_columns(docs, fields, compute, needs=[text])


def number(pieces: DataFrame) -> DataFrame:
    """``pieces`` (with length) in a staged table, with ``__range`` and ``__place``.

    They are dealt by ranges of length and a hash, so that a frequent length fills many ranges, and sorted by
    length; places count up within a range.
    """
    marked = pieces.withColumn("__hash", F.xxhash64(*pieces.columns, F.monotonically_increasing_id()))
    ranged = marked.repartitionByRange("length", "__hash").sortWithinPartitions("length", "__hash").drop("__hash")
    place = F.monotonically_increasing_id()  # the partition's number in the upper bits
    return stage(ranged.withColumn("__place", place).withColumn("__range", F.shiftright("__place", 33)), "numbered")


def assign(numbered: DataFrame, plan: Plan) -> DataFrame:
    """Numbered pieces with sequence_id and offset.

    A piece's rank within its length is its place, less its range's first place of that length, plus what
    earlier ranges have of it. Collected are a range's first place and count per length, which are one row
    a range and one a length; broadcast are these and the plan, whose size the capacity bounds.
    """
    counts = numbered.groupBy("length", "__range").agg(F.min("__place").alias("lo"), F.count("*").alias("n")).collect()
    first, total = [], {}
    for length, part, lo, n in sorted(tuple(r) for r in counts):
        first.append((length, part, lo - total.get(length, 0)))
        total[length] = total.get(length, 0) + n
    starts = np.array(first, dtype=np.int64).reshape(-1, 3)
    shared = numbered.sparkSession.sparkContext.broadcast((plan.table(), starts))
    columns = [c for c in numbered.columns if not c.startswith("__")]

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows, starts = shared.value
        length, part, place = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__range", "__place"))
        at = np.searchsorted((starts[:, 0] << 40) | starts[:, 1], (length << 40) | part)
        rank = place - starts[at, 2]
        row = rows[np.searchsorted((rows[:, 0] << 48) | rows[:, 1], (length << 48) | rank, "right") - 1]
        nth, each = rank - row[:, 1], row[:, 3]
        return [pa.array(row[:, 2] + nth // each), pa.array(row[:, 4] + nth % each * length)]

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return append_columns(numbered, fields, compute, needs=["length", "__range", "__place"]).select(*columns, "sequence_id", "offset")


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised once; the pieces are written to the shared folder and read from there.
    """
    tokens = tokenize(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), capacity=capacity, vocabulary=vocabulary).drop("text")
    pieces = stage(tokens.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*"), "pieces")
    numbered = number(pieces)
    histogram = {int(r["length"]): int(r["count"]) for r in numbered.groupBy("length").count().collect()}
    return assign(numbered, make_plan(histogram, capacity, rounds))
