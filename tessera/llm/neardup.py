"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes a set of hashed word shingles, a fingerprint of the set, and a MinHash signature.
2. Texts of equal sets collapse to one representative (the smallest row number).
3. Signatures are cut into bands; representatives that share a band value form a bucket. Exact settings take
   the sets' least hashes in place of bands.
4. Of small buckets all pairs are candidates. Of a large one, the member that shares most bands with
   others (the hub) is paired with every other member; links found join components, and buckets whose
   other members still lie in several components go another round with another hub. What is left after
   some rounds is compared in blocks, hub by hub: a task holds two blocks of signatures, and passes on the
   rows that have a partner in another component. Only their texts are fetched, for a second task that
   gives one link for each two components it joins.
5. A candidate's signatures are compared batch by batch; it is dropped once the posterior probability
   that its similarity reaches the threshold falls under ``miss``. Survivors are verified on full sets, and
   what passes is confirmed on the shingles' words themselves.
6. Verified links make components; pairs within one component need no further check.

Skipped pairs are only those whose ends are already linked through others, so components are those of
all links, up to the chosen miss probabilities of banding and pruning (about 1e-6 a link at the
threshold itself, and far less above it).

Null, empty and wordless texts have an empty set and link with nothing. A row with a null id links with
nothing and is kept, with a null component. Rows that share an id are one document: it has the links of
each of its texts. Very long texts are hashed whole, one at a time. An empty table gives no rows. Extra
columns do not matter, whatever their names, since only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.components import components, split_join
from tessera.llm.text import NON_SPACE, append_columns, mix, shingles, slices, utf8, words
from tessera.session import ship, stage, unstage

HASHES = 128
#: Buckets of at most so many members give all their pairs.
SMALL_BUCKET = 6
#: Rounds of hubs before the rest is compared in blocks of so many members.
HUB_ROUNDS = 2
BLOCK = 512

_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLIERS, _MASKS = _SEEDS[:HASHES] | np.uint64(1), _SEEDS[HASHES:]


@dataclass(frozen=True)
class Settings:
    """Shingle size, threshold, miss probabilities of banding and of pruning, and signature length.

    With ``exact``, buckets are not of bands but of the least hashes of a set (its bottom sketch), as many of n as can be
    without a partner in a set that reaches the threshold, and one more: no link is missed before pruning.
    """

    words: int = 5
    threshold: Fraction = Fraction(4, 5)
    band_miss: float = 1e-6
    miss: float = 1e-7
    hashes: int = HASHES
    exact: bool = False

    @property
    def rows(self) -> int:
        """The most rows a band can have with banding missing a link at the threshold rarely enough."""
        t = float(self.threshold)
        return max([r for r in range(1, 17) if (1 - t**r) ** (self.hashes // r) <= self.band_miss], default=1)

    def least_matches(self, batch: int = 32) -> list[tuple[int, int]]:
        """(hashes compared, fewest equal ones to go on), from the posterior under a uniform prior.

        With m of n equal, similarity has a Beta(m + 1, n - m + 1) posterior, and the probability that
        it is at least t is that of at most m successes in n + 1 trials of probability t.
        """
        t, out = float(self.threshold), []
        for n in sorted({*range(batch, self.hashes, batch), self.hashes}):
            total, m = 0.0, 0
            while m <= n:
                total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if total >= self.miss:
                    break
                m += 1
            out.append((n, m))
        return out


FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("f1", T.LongType()),
    T.StructField("f2", T.LongType()),
    T.StructField("signature", T.BinaryType()),
]
SET = ["f1", "f2", "n_shingles"]
LEAST = T.StructField("least", T.ArrayType(T.LongType()))


def _least(sets: np.ndarray, first: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each set's ascending hashes so many that two sets that reach the threshold share one; and how many."""
    n, t = np.diff(first), settings.threshold
    count = np.where(n > 0, n + 1 + -n * t.numerator // t.denominator, 0)
    at = np.arange(count.sum()) + np.repeat(first[:-1] - np.cumsum(count) + count, count)
    return sets[at].view(np.int64), count


def _signatures(sets: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """Low 16 bits of the minima, one row for each non-empty set."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.empty((len(full), hashes), dtype=np.uint16)
    at = 0
    while at < len(full):  # some sets at a time, to stay in the cache
        end = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + (1 << 14))))
        lo, hi = first[full[at]], first[full[min(end, len(full)) - 1] + 1]
        part, starts = sets[lo:hi], first[full[at:end]] - lo
        for k in range(hashes):
            hashed = ((part ^ _MASKS[k]) * _MULTIPLIERS[k]) >> np.uint64(32)
            out[at:end, k] = np.minimum.reduceat(hashed, starts) & np.uint64(0xFFFF)
        at = end
    return out


def sketch(docs: DataFrame, settings: Settings, *, text: str = "text") -> DataFrame:
    """``docs`` with n_shingles, a 128-bit fingerprint of the shingle set, and its signature.

    The fingerprint's halves come from two hashes of the words, mixed apart.
    """

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        counts, f1, f2, signatures, least, sizes = [], [], [], [], [], [0]
        for a, b in slices(offsets):
            w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NON_SPACE)
            sets, others, first = shingles(w, settings.words)
            n = np.diff(first)
            full = np.flatnonzero(n > 0)
            s1, s2 = np.zeros(b - a, dtype=np.uint64), np.zeros(b - a, dtype=np.uint64)
            if len(full):
                s1[full] = np.add.reduceat(mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[full])
                s2[full] = np.add.reduceat(mix(others + np.uint64(0x5851F42D4C957F2D)), first[full])
            signed = iter(_signatures(sets, first, settings.hashes))
            counts.append(n.astype(np.int64)), f1.append(s1.view(np.int64)), f2.append(s2.view(np.int64))
            signatures += [next(signed).tobytes() if x else None for x in n.tolist()]
            if settings.exact:
                values, many = _least(sets, first, settings)
                least.append(values), sizes.extend(many.tolist())
        none = np.zeros(0, dtype=np.int64)
        made = [pa.array(np.concatenate([none, *x])) for x in (counts, f1, f2)] + [pa.array(signatures, pa.binary())]
        return made + ([pa.ListArray.from_arrays(np.cumsum(sizes).astype(np.int32), np.concatenate([none, *least]))] if settings.exact else [])

    return append_columns(docs, [*FIELDS, LEAST] if settings.exact else FIELDS, compute, needs=[text])


def _bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit value per band; equal values mean equal rows of the same band."""
    n = signature.shape[1] // rows
    out = np.zeros((len(signature), n), dtype=np.uint64)
    out += np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        out = mix(out ^ signature[:, r : n * rows : rows].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1), dtype=np.uint16)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), -1)


def _buckets(reps: DataFrame, settings: Settings) -> DataFrame:
    """A staged table (bucket, rep, n_shingles, size) of buckets of two members or more."""
    rows = settings.rows

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        values = _bands(_matrix(batch.column(batch.schema.get_field_index("signature"))), rows)
        return [pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())]

    banded = reps.withColumnRenamed("least", "bands") if settings.exact else append_columns(reps, [T.StructField("bands", T.ArrayType(T.LongType()))], compute, needs=["signature"])
    each = banded.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumn("w", F.col("size"))
    sizes = stage(sizes, "sizes")
    out = stage(split_join(each, sizes, "bucket", "w"), "buckets")
    unstage(sizes)
    return out


def _near(a: str, b: str, settings: Settings) -> Column:
    """Sets so different in size cannot reach the threshold."""
    t = settings.threshold
    return F.least(a, b) * t.denominator >= F.greatest(a, b) * t.numerator


def _survives(one: np.ndarray, other: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which rows pass every batch of the sequential test."""
    alive, equal, done = np.arange(len(one)), np.zeros(len(one), dtype=np.int64), 0
    for n, least in steps:
        equal[alive] += (one[alive, done:n] == other[alive, done:n]).sum(axis=1)
        alive, done = alive[equal[alive] >= least], n
    out = np.zeros(len(one), dtype=bool)
    out[alive] = True
    return out


def _prune(pairs: DataFrame, signed: DataFrame, settings: Settings) -> DataFrame:
    """Pairs (a, b) that pass the Bayesian test."""
    steps = settings.least_matches()
    one = signed.select(F.col("rep").alias("a"), F.col("signature").alias("s"))
    other = signed.select(F.col("rep").alias("b"), F.col("signature").alias("t"))

    def run(batches):
        for batch in batches:
            keep = _survives(_matrix(batch.column(2)), _matrix(batch.column(3)), steps)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.select("a", "b").join(other, "b").join(one, "a").select("a", "b", "s", "t")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    data, offsets = utf8(texts)
    out: list[np.ndarray] = []
    for a, b in slices(offsets):
        values, _, first = shingles(words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NON_SPACE), k)
        out += [values[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    return out


_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_LOWERED = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def _tokens(text: str) -> list[bytes]:
    """A text's words as bytes, A-Z lower-cased."""
    plain = text.encode().translate(_LOWERED)
    return plain.translate(bytes.maketrans(_SPACES, b" " * len(_SPACES))).split(b" ")


class Verifier:
    """The exact test of pairs: on hashed full sets first, then on the words of what passes."""

    def __init__(self, texts: pa.Array, settings: Settings):
        self.texts, self.sets = texts, _sets(texts, settings.words)
        self.k, self.num, self.den = settings.words, settings.threshold.numerator, settings.threshold.denominator
        self._known: dict[int, frozenset] = {}

    def _words(self, i: int) -> frozenset:
        if i not in self._known:
            if len(self._known) >= 256:
                self._known.clear()
            w = [x for x in _tokens(self.texts[i].as_py() or "") if x]
            self._known[i] = frozenset(tuple(w[j : j + self.k]) for j in range(max(1, len(w) - self.k + 1))) if w else frozenset()
        return self._known[i]

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        """Of ``others``, in their order, those that pass the test on hashed sets with ``i``."""
        x, sizes = self.sets[i], np.array([len(self.sets[j]) for j in others.tolist()], dtype=np.int64)
        others, sizes = others[sizes > 0], sizes[sizes > 0]
        if not len(x) or not len(others):
            return others[:0]
        y = np.concatenate([self.sets[j] for j in others.tolist()])
        common = np.add.reduceat(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y, np.cumsum(sizes) - sizes, dtype=np.int64)
        return others[common * self.den >= self.num * (len(x) + sizes - common)]

    def linked(self, i: int, j: int) -> bool:
        x, y = self.sets[i], self.sets[j]
        if len(x) > len(y):
            x, y = y, x
        if not len(x):
            return False
        common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        if common * self.den < self.num * (len(x) + len(y) - common):
            return False
        own, other = self._words(i), self._words(j)
        common = len(own & other)
        return common * self.den >= self.num * (len(own) + len(other) - common)


def _verify(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    other = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                both = pa.concat_arrays([pc.fill_null(part.column(i), "") for i in (2, 3)]).dictionary_encode()
                test, place = Verifier(both.dictionary, settings), both.indices.to_pylist()
                keep = [test.linked(p, q) for p, q in zip(place[: part.num_rows], place[part.num_rows :], strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(other, "b").join(one, "a").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a bigint, b bigint")


def _block_pairs(groups: DataFrame) -> DataFrame:
    """Rows (hub, left, right, place, rep, component): what each pair of blocks holds.

    ``groups`` has (hub, rep, n_shingles, component, hub_c). A group's rows are dealt to blocks: those of the
    component that holds the hub (main) apart from the rest. Each task compares a block of rest rows
    with another block of rest or main rows; main rows are linked with each other already.
    """
    groups = groups.withColumn("main", F.col("component") == F.col("hub_c"))
    blocks = lambda flag: F.ceil(F.sum(F.when(flag, 1).otherwise(0)) / BLOCK).cast("int")
    sizes = groups.groupBy("hub").agg(blocks(F.col("main")).alias("mains"), blocks(~F.col("main")).alias("rests"), F.count("*").alias("w")).where("rests > 0")
    rows = split_join(groups, sizes, "hub", "w").withColumn("k", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    rows = rows.withColumn("place", F.when(F.col("main"), F.col("k")).otherwise(F.col("mains") + F.col("k")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("rests")).otherwise(F.col("mains") + F.col("rests")) - 1)))
    partner = F.when(F.col("main"), F.col("mains") + F.col("o")).otherwise(F.col("o"))
    return rows.select("hub", F.least("place", partner).alias("left"), F.greatest("place", partner).alias("right"), "place", "rep", "n_shingles", "component")


def _partners(table: pa.Table, settings: Settings):
    """For the rows of the right block: the row, and rows of the left one that may link with it, the likeliest first."""
    left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
    rep, component, place, sizes = (table.column(c).to_numpy() for c in ("rep", "component", "place", "n_shingles"))
    signature, steps = _matrix(table.column("signature").combine_chunks()), settings.least_matches()
    num, den = settings.threshold.numerator, settings.threshold.denominator
    rows, others = np.flatnonzero(place == right), np.flatnonzero(place == left)
    columns = np.ascontiguousarray(signature[others].T)
    for part in (rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)):
        x, y = part[:, None], others[None, :]
        alive = (component[y] != component[x]) & (np.minimum(sizes[y], sizes[x]) * den >= np.maximum(sizes[y], sizes[x]) * num)
        if left == right:
            alive &= rep[y] > rep[x]
        equal, done = np.zeros(alive.shape, dtype=np.int16), 0
        for n, least in steps:
            if not alive.any():
                break
            for k in range(done, n):
                equal += columns[k] == signature[part, k][:, None]
            alive &= equal >= least
            done = n
        for i in np.flatnonzero(alive.any(axis=1)).tolist():
            found = np.flatnonzero(alive[i])
            yield int(part[i]), others[found[np.argsort(-equal[i, found], kind="stable")]]


_PAIR = "hub bigint, left int, right int, place int, rep bigint, n_shingles bigint, component bigint"


def _block_links(groups: DataFrame, signed: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Verified links between components within groups, found block by block without a row per pair."""
    names = [x.split()[0] for x in _PAIR.split(",")]

    def with_partners(table: pa.Table) -> pa.Table:
        keep = np.zeros(table.num_rows, dtype=bool)
        for x, y in _partners(table, settings):
            keep[x], keep[y] = True, True
        return table.select(names).filter(pa.array(keep))

    def compare(table: pa.Table) -> pa.Table:
        rep, component = (table.column(c).to_numpy() for c in ("rep", "component"))
        test = Verifier(table.column("text").combine_chunks(), settings)
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        found: list[tuple[int, int]] = []
        for x, y in _partners(table, settings):
            for z in test.likely(x, y).tolist():  # one link with a component is enough
                a, b = find(component[x]), find(component[z])
                if a != b and test.linked(x, z):
                    root[max(a, b)] = min(a, b)
                    found.append((rep[x], rep[z]))
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    signatures = signed.select("rep", "signature")
    rows = stage(_block_pairs(groups).join(signatures, "rep").groupBy("hub", "left", "right").applyInArrow(with_partners, _PAIR), "partners")
    return rows.join(signatures, "rep").join(texts, "rep").groupBy("hub", "left", "right").applyInArrow(compare, "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def number_rows(docs: DataFrame) -> DataFrame:
    """``docs`` in a staged table, with a number of each row (``__row``), which no later plan can change."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _links(rows: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """Components (node, component) of the representatives' links."""
    buckets = _buckets(reps, settings)
    members = buckets.groupBy("rep").agg(F.sum("size").alias("weight"))
    signed = stage(reps.join(members, "rep").select("rep", "signature", "weight"), "signed")
    # by merge whatever the sizes: few of the texts are asked for, but which ones only grows with the input
    texts = stage(rows.join(signed.select(F.col("rep").alias("__row")).hint("merge"), "__row").select(F.col("__row").alias("rep"), "text"), "texts")

    # all pairs of small buckets, hubs of large ones
    small = buckets.where(F.col("size") <= SMALL_BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("rep", "n_shingles"))).alias("m"))
    small = small.select("m", F.posexplode("m").alias("p", "x")).select("x", F.explode(F.expr("slice(m, p + 2, size(m))")).alias("y"))
    small = small.where(_near("x.n_shingles", "y.n_shingles", settings)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    open_rows = buckets.where(F.col("size") > SMALL_BUCKET).join(signed.select("rep", "weight"), "rep").select("bucket", "rep", "n_shingles", "weight", F.col("rep").alias("component"))
    open_rows = stage(open_rows, "open")
    passing = [buckets, signed, texts]
    links, extra, first_hubs = None, small, None
    for _ in range(HUB_ROUNDS):
        hubs = open_rows.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"), "n_shingles", "component")).alias("h"), F.count("*").alias("w"))
        hubs = hubs.select("bucket", "w", (-F.col("h.r")).alias("hub"), F.col("h.n_shingles").alias("hub_n"), F.col("h.component").alias("hub_c"))
        starred = split_join(open_rows, hubs, "bucket", "w")
        if first_hubs is None:
            first_hubs = stage(starred.select("hub", "rep", "n_shingles").distinct(), "stars")
        pairs = starred.where("component <> hub_c").where(_near("n_shingles", "hub_n", settings)).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
        pairs = pairs if extra is None else pairs.unionByName(extra)
        extra = None
        found = stage(_verify(_prune(_ordered(pairs), signed, settings), texts, settings), "links")
        links = _joined(found, links)
        passing.append(open_rows)
        open_rows = _still_open(starred.where("rep <> hub").drop("hub", "hub_n", "hub_c"), links)
        if open_rows is None:
            break
    else:
        at = lambda c: F.coalesce(f"{c}_to", c)
        to = lambda c: links.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
        groups = first_hubs.join(to("rep"), "rep", "left").join(to("hub"), "hub", "left").select("hub", "rep", "n_shingles", at("rep").alias("component"), at("hub").alias("hub_c"))
        still = first_hubs.join(open_rows.select("rep").distinct(), "rep", "left_semi").select("hub").distinct()
        groups = stage(groups.join(still, "hub", "left_semi"), "groups")
        passing.append(groups)
        links = _joined(stage(_block_links(groups, signed, texts, settings), "links"), links)
    unstage(*passing, first_hubs, open_rows)  # what follows reads links
    return links


def cluster_rows(rows: DataFrame, settings: Settings, *, order: Column, same: str | None = None, passing: list[DataFrame] | None = None) -> DataFrame:
    """Rows (__row, n_shingles, order, first): for each numbered row, its ``order`` and the least one of its component.

    ``rows`` comes from number_rows and has ``text``, and ``same``, if given: rows of one such value are one
    document. Rows without words are components of their own, unless ``same`` joins them to others. To ``passing``
    come the staged tables that the result reads, which the caller may delete after it.
    """
    ship(rows.sparkSession)
    plain = rows.select("__row", "text", order.alias("order"), *([F.col(same).alias("same")] if same else []))
    sketches = stage(sketch(plain, settings).drop("text"), "sketches")
    sets = sketches.where("n_shingles > 0").groupBy(*SET).agg(F.min("__row").alias("rep"), F.first("signature").alias("signature"), F.count("*").alias("w"), *([F.first("least").alias("least")] if settings.exact else []))
    reps = stage(sets, "reps")
    told = split_join(sketches.drop("signature", "least"), reps.select(*SET, "rep", "w"), SET, "w", "left").withColumn("rep", F.coalesce("rep", "__row"))
    told = stage(told, "told")
    unstage(sketches)
    links = _links(rows, reps, settings)
    unstage(reps)
    if same:  # the texts of one document are linked
        pairs = told.select("same", "rep").distinct()
        least = pairs.groupBy("same").agg(F.min("rep").alias("least"), F.count("*").alias("w")).where("w > 1")
        more = stage(split_join(pairs, least, "same", "w").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")), "shared")
        if not more.isEmpty():
            links = _joined(more, links)
    sizes = told.groupBy("rep").agg(F.min("order").alias("order"), F.count("*").alias("w"))
    least = sizes.join(links.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = stage(least, "least")
    unstage(links)
    firsts = least.groupBy("component").agg(F.min("order").alias("first"), F.count("*").alias("w"))
    by_rep = split_join(least.select("rep", "component", F.col("w").alias("rows")), firsts, "component", "w").select("rep", "first", F.col("rows").alias("w"))
    by_rep = stage(by_rep, "firsts")
    unstage(least)
    if passing is not None:
        passing += [told, by_rep]
    return split_join(told.select("__row", "n_shingles", "order", "rep"), by_rep, "rep", "w").select("__row", "n_shingles", "order", "first")


def find_components(docs: DataFrame, settings: Settings = Settings(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one per row of ``docs``."""
    rows = number_rows(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    judged = cluster_rows(rows.where("doc_id is not null"), settings, order=F.col("doc_id"), same="doc_id")
    nameless = rows.where("doc_id is null").select("doc_id", "__row", "text")
    nameless = sketch(nameless, settings).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = judged.select(F.col("order").alias("doc_id"), "n_shingles", F.col("first").alias("component_id"))
    return out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, settings: Settings = Settings(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the least id's, and of its rows one.

    Rows are judged one by one: repeated rows go, and so do copies without an id, which come last in order.
    """
    rows = number_rows(docs)
    source = rows.select("__row", F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("key"))
    judged = cluster_rows(source, settings, order=F.struct(F.col("key").isNull(), "key", "__row"))
    gone = judged.where("first.`__row` <> __row").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def _joined(found: DataFrame, links: DataFrame | None) -> DataFrame:
    """Components of new links and those known before."""
    out = components(found if links is None else found.unionByName(links.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    unstage(found, links)
    return out


def _still_open(rows: DataFrame, links: DataFrame) -> DataFrame | None:
    """Rows of buckets whose members lie in more than one component, with their components; None if none."""
    rows = rows.drop("component").join(links.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rows = stage(rows, "judged")
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("w")).where("lo <> hi").select("bucket", "w")
    mixed = stage(mixed, "mixed")
    left = stage(split_join(rows, mixed, "bucket", "w"), "open")
    unstage(rows, mixed)
    return None if left.isEmpty() else left
