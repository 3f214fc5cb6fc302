"""Connected components of a distributed edge table, by alternating large and small stars.

Only sums are collected: neither links nor components ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tessera.session import stage, unstage

#: Of the keys of more than HOT_ROWS rows, the MOST_HOT largest are dealt to several tasks, at most HOT_ROWS rows each
#: (more rows each where that took over MOST_PARTS). Any other key has at most a share of 1 / MOST_HOT of all rows.
HOT_ROWS = 256
MOST_HOT = 1000
MOST_PARTS = 4096


def split_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], weight: str, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key and in ``weight`` how many rows it meets.

    The largest keys are salted: their rows in ``left`` are dealt to parts by a hash, and their row in ``right``
    is repeated for each part. So no task gets a hot key's rows, whatever share of all rows they are. Only
    those keys' hashes and weights reach the driver, MOST_HOT at most. No row of another key is repeated or
    salted, and without hot keys this is a plain join. ``weight`` is not passed on.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = [c for c in right.columns if c not in (*keys, weight)]
    dealt = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *columns, F.col(weight).alias("__weight"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    mark, own = F.xxhash64(*[f"__{k}" for k in keys]), F.xxhash64(*keys)
    largest = dealt.where(F.col("__weight") > HOT_ROWS).select(mark.alias("mark"), "__weight").orderBy(F.desc("__weight")).limit(MOST_HOT)
    by_parts: dict[int, list[int]] = {}
    for r in largest.collect():
        # powers of two, so that a row is looked up among a dozen numbers of parts, not among all hot keys
        by_parts.setdefault(min(1 << (-(-r["__weight"] // HOT_ROWS) - 1).bit_length(), MOST_PARTS), []).append(r["mark"])
    if by_parts:
        hot = [x for marks in by_parts.values() for x in marks]
        salt = F.xxhash64(*[c for c, kind in left.dtypes if not kind.startswith("map")], F.lit(7))
        none = F.lit(0).cast("long")
        repeated = dealt.where(mark.isin(hot)).withColumn("__part", F.explode(F.sequence(none + 1, _parts(mark, by_parts) - 1)))
        dealt = dealt.withColumn("__part", none).unionByName(repeated)
        same.append(F.when(own.isin(hot), F.pmod(salt, _parts(own, by_parts))).otherwise(none) == F.col("__part"))
    return left.join(dealt, same, how).select(*left.columns, *columns)


def _parts(mark: Column, by_parts: dict[int, list[int]]) -> Column:
    """The number of parts of a hot key's hash."""
    out = F.lit(max(by_parts)).cast("long")
    for n in sorted(by_parts)[-2::-1]:
        out = F.when(mark.isin(by_parts[n]), F.lit(n).cast("long")).otherwise(out)
    return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("w"))
    out = split_join(both.where("v > u"), least, "u", "w").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
    joined = split_join(edges, least, "u", "w")
    out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two smaller ends, or both a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.count("*").alias("c")).where("ups > 1 or (ups > 0 and c > ups)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` (pairs of bigint ids) as rows (node, component), the component's smallest id.

    Nodes that are their component's smallest id, and nodes without links, have no row. Repeated links and
    links of a node with itself do not matter; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stage(edges, "edges")
    while not _settled(edges):
        before, edges = edges, stage(_small_star(_large_star(edges)), "edges")
        unstage(before)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out._staged_path = edges._staged_path
    return out
