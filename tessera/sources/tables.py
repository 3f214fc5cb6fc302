"""Record tables: wide DataFrames of one schema, the default layout of every query.

A record table has a string column ``id`` and one column per attribute (dotted names for nested ones).
SQL NULL means that the attribute is missing; the optional column ``_nulls`` lists attributes that hold
an explicit null. An attribute whose values have several types is text, and the optional column ``_keys``
maps it to the equality key of its value.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.values import BYTES, FLAG, LIST, NULL, NUMBER, OBJECT, TEXT

NULLS = "_nulls"
#: A map from attributes whose values have several types to the equality keys of their values.
KEYS_OF_MIXED = "_keys"


@dataclass(frozen=True)
class RecordTable:
    """The records of one schema. ``key`` makes the id, computed only when a query reads it."""

    path: str
    df: DataFrame
    key: Column | None = None
    #: The id is synthetic: it holds within one run only.
    keyless: bool = False
    #: The attributes that the id is made of, where it is.
    key_names: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (NULLS, KEYS_OF_MIXED) and not (c == "id" and self.key is None)]

    @property
    def has_nulls(self) -> bool:
        return NULLS in self.df.columns

    def id(self) -> Column:
        return F.col("id") if self.key is None else self.key

    @property
    def has_keys(self) -> bool:
        return KEYS_OF_MIXED in self.df.columns

    def kind(self, name: str) -> T.DataType | None:
        """The type of an attribute; None if no record has it."""
        if name in ("id", "_id"):
            return T.StringType()
        return self.df.schema[name].dataType if name in self.df.columns else None

    def value(self, name: str) -> Column:
        return self.id() if name in ("id", "_id") else F.col(f"`{name}`")

    def null(self, name: str) -> Column | None:
        """Whether an attribute holds an explicit null."""
        if not self.has_nulls or name in ("id", "_id"):
            return None
        return F.coalesce(F.array_contains(NULLS, name), F.lit(False))

    def mixed(self, name: str, keys: Column | None = None) -> Column | None:
        """The equality key of an attribute whose values may have several types; null where it is plain."""
        if not self.has_keys or name in ("id", "_id") or not isinstance(self.kind(name), T.StringType):
            return None
        return F.element_at(F.col(KEYS_OF_MIXED) if keys is None else keys, name)

    def records(self) -> DataFrame:
        """The table with its id as an ordinary column."""
        own = [F.col(f"`{c}`") for c in self.columns if c != "id"]
        marks = [F.col(c) for c in (NULLS, KEYS_OF_MIXED) if c in self.df.columns]
        return self.df.select(self.id().alias("id"), *own, *marks)


def table(path: str, df: DataFrame, key: Iterable[str] | str | None = None, *, keyless: bool = False) -> RecordTable:
    """``df`` as records of ``path``. ``key`` names the column or columns that make the id.

    A keyless table gets a synthetic id, which is stable only while the input and its partitions are.
    """
    if keyless:
        return RecordTable(path, df, F.monotonically_increasing_id().cast("string"), keyless=True)
    if key is None:
        return RecordTable(path, df)
    names = [key] if isinstance(key, str) else list(key)
    return RecordTable(path, df, F.concat_ws("-", *[F.col(f"`{k}`").cast("string") for k in names]), key_names=tuple(names))


#: Key columns of the sample tables; lineitem has none.
KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "labels": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "conversations": ("conv_id", "turn"),
}


def load(spark: SparkSession, folder: str, name: str, ns: str = "data") -> RecordTable:
    """A Parquet table of a folder as records of ``ns/name``."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return table(f"{ns}/{name}", df, KEYS.get(name), keyless=name not in KEYS)


def key_text(col: Column, kind: T.DataType) -> Column:
    """The equality key of a typed column as text; equal values of any table have equal keys."""
    if isinstance(kind, T.StringType):
        return F.concat(F.lit(TEXT), col)
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit(FLAG), col.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.concat(F.lit(NUMBER), F.unix_millis(col.cast("timestamp")).cast("string"))
    if isinstance(kind, T.IntegralType):
        return F.concat(F.lit(NUMBER), col.cast("string"))
    if isinstance(kind, T.NumericType):
        x = col.cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
        return F.concat(F.lit(NUMBER), F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string")))
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit(BYTES), F.lower(F.hex(col)))
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit(LIST), F.to_json(F.transform(col, lambda x: key_text(x, kind.elementType))))
    return F.concat(F.lit(OBJECT), F.to_json(col))


def display_text(col: Column, kind: T.DataType) -> Column:
    """A typed column as text, for values whose type differs from row to row."""
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(col)
    if isinstance(kind, T.BinaryType):
        return F.base64(col)
    return col.cast("string")


def tuples(source: RecordTable, *, system: bool = True) -> DataFrame:
    """The table as tuples (path, ns, schema, id, attr, text, key), one per attribute that is present."""
    ns, schema = source.path.split("/")
    frame = source.records()
    each = []
    names = [c for c in source.columns if c != "id" and (system or not c.startswith("_"))]
    if system:
        each.append(F.struct(F.lit("_id").alias("attr"), F.col("id").alias("text"), F.concat(F.lit(TEXT), F.col("id")).alias("key")))
    for c in names:
        kind, col = frame.schema[c].dataType, F.col(f"`{c}`")
        null = F.array_contains(NULLS, c) if source.has_nulls else F.lit(False)
        typed = F.coalesce(F.element_at(KEYS_OF_MIXED, c), key_text(col, kind)) if source.has_keys else key_text(col, kind)
        key = F.when(null, F.lit(NULL)).otherwise(typed)
        each.append(F.struct(F.lit(c).alias("attr"), display_text(col, kind).alias("text"), key.alias("key")))
    out = frame.select("id", F.explode(F.array(*each)).alias("t")).where("t.key is not null")
    return out.select(F.concat_ws("/", F.lit(ns), F.lit(schema), "id").alias("path"), F.lit(ns).alias("ns"), F.lit(schema).alias("schema"), "id", "t.attr", "t.text", "t.key")
