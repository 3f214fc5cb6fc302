"""URL filters: host and path rules first, then logistic regression on hashed character n-grams.

The model is fit on a small table of labelled URLs, ``labelled_urls.tsv`` beside this module, or on a given one.

Null URLs, and URLs without ``://``, have an empty host and path; no rule fits them and the model judges
them by its bias. With an empty labelled table, or labels of one kind only, the model allows everything that
no rule decides. Repeated rows are judged alike, very long URLs are read whole, and an empty table gives no
rows. A column of the input that bears the name of an output column is replaced.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.text import append_columns, utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4, 5)
FEATURES = 1 << 16
#: Bound of a sample of a larger labelled table: hash buckets per label, one URL each.
SAMPLE_URLS = 1024


#: A URL is blocked above this score. Hosts of words that the table does not know score about one half.
BLOCK_ABOVE = 0.65
TABLE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "labelled_urls.tsv")


def labelled_urls(path: str = TABLE) -> list[tuple[str, bool]]:
    """The small labelled table: URLs, and whether they are to be blocked. It is read by the driver."""
    with open(path, encoding="utf-8") as f:
        rows = [line.rstrip("\n").split("\t") for line in f][1:]
    return [(url, verdict == "block") for verdict, url in rows]


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, at)
    tail = F.substring(url, rest + 3, F.length(url))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(tail, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


_LOWERED = str.maketrans(UPPER, LOWER)


def parts(url: str) -> tuple[str, str]:
    """Host and path of a URL of the labelled table, which the driver reads."""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2]).groups()
    return host.translate(_LOWERED), path


def match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. ``rules`` is a short list."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature numbers and values (1 / sqrt of the row's n-grams) of all n-grams."""
    rows, features = [], []
    for salt, column in ((0x1F3D5B79, hosts), (0x2E4C6A88, paths)):
        data, offsets = utf8(column)
        n = len(data)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        left = offsets[1:][row] - np.arange(n)
        h = np.full(n, salt, dtype=np.uint64)
        for k in range(max(GRAMS)):
            m = max(0, n - k)
            h[:m] = (h[:m] ^ data[k:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            if k + 1 in GRAMS:
                whole = left > k
                rows.append(row[whole])
                features.append((h[whole] >> np.uint64(48)).astype(np.int64) % FEATURES)
    row, feature = np.concatenate(rows), np.concatenate(features)
    total = np.bincount(row, minlength=len(hosts))
    return row, feature, 1.0 / np.sqrt(total[row])


@dataclass
class Model:
    """Weights of hashed n-grams and a bias; positive scores block."""

    weights: np.ndarray
    bias: float

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, feature, value = _features(hosts, paths)
        z = np.bincount(row, self.weights[feature] * value, minlength=len(hosts)) + self.bias
        return 1.0 / (1.0 + np.exp(-z))


def fit(hosts: list[str], paths: list[str], blocked: list[bool], *, rounds: int = 200, l2: float = 1e-4) -> Model:
    """Logistic regression by accelerated gradient steps over all rows of a small table."""
    y = np.array(blocked, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), -4.0)
    row, feature, value = _features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    n, w, bias = len(y), np.zeros(FEATURES), 0.0
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh the same
    ahead_w, ahead_b, step = w, bias, 4.0
    for k in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(np.bincount(row, ahead_w[feature] * value, minlength=n) + ahead_b)))
        error = (p - y) * share / n
        new_w = ahead_w - step * (np.bincount(feature, error[row] * value, minlength=FEATURES) + l2 * ahead_w)
        new_b = ahead_b - step * error.sum()
        pull = k / (k + 3)
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - bias)
        w, bias = new_w, new_b
    return Model(w, float(bias))


def sample(labelled: DataFrame, *, buckets: int = SAMPLE_URLS) -> list[tuple[str, str, bool]]:
    """At most ``buckets`` URLs of each label (columns host, path, verdict), chosen by hash."""
    mark = F.xxhash64("host", "path")
    least = labelled.groupBy("verdict", F.pmod(mark, F.lit(buckets)).alias("b")).agg(F.min(F.struct(mark.alias("m"), "host", "path")).alias("x"))
    return sorted((r.x.host, r.x.path, r.verdict == "block") for r in least.collect())


def filter_urls(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, *, url: str = "url", block_above: float = BLOCK_ABOVE) -> DataFrame:
    """``pages`` with host, path, rule, block_score and verdict.

    ``labelled`` has url and verdict (allow or block); the model is fit on a bounded sample of it. By
    default it is fit on the small table beside this module.
    """
    host, path = split(F.col(url))
    taken = {"host", "path", "rule", "verdict", "block_score"}
    split_up = pages.select(*[f"`{c}`" for c in pages.columns if c.lower() not in taken], host.alias("host"), path.alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    judged = split_up.withColumn("rule", rule).withColumn("verdict", verdict)
    if labelled is None:
        known = sorted({(*parts(u), b) for u, b in labelled_urls()})
    else:
        h, p = split(F.col("url"))
        known = sample(labelled.where("verdict in ('allow', 'block')").select(h.alias("host"), p.alias("path"), "verdict"))
    model = fit(*(list(x) for x in zip(*known, strict=True))) if known else fit([], [], [])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        host, path = (batch.column(batch.schema.get_field_index(c)) for c in ("host", "path"))
        return [pa.array(shared.value.scores(host, path), pa.float64())]

    scored = append_columns(judged, [T.StructField("block_score", T.DoubleType())], compute, needs=["host", "path"])
    return scored.withColumn("verdict", F.coalesce("verdict", F.when(F.col("block_score") > block_above, F.lit("block")).otherwise(F.lit("allow"))))
