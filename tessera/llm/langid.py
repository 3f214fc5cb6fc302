"""Language identification by compression with per-language zstandard raw-content dictionaries.

A text is encoded once per language, in one way whatever its length; the language whose dictionary gives the
smallest frame wins. The margin between the two smallest frames tells how sure that is. Texts of a narrow
margin are rejected: they may be of a language that was not learned. How narrow is found on learning rows
that are not in the dictionaries: their margins are clean ones, and their margins without their own
language's dictionary, those of a language that was not learned, tell how many such texts it catches.

Null texts and texts without a letter get ``und``, score 0 and are rejected. With nothing to learn from
every text gets ``und``. Texts whose first encoding ties are rejected. Ties that other encodings of the text
do not break go to the language first in order. Very long texts are encoded whole; repeated rows are judged
each on its own; an empty table gives no rows. A column of the input that bears the name of an output column
is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.llm.text import append_columns

#: Bounds of the training sample: buckets of labelled rows per language (one row each) for dictionaries and for
#: margins, bytes per dictionary, and bytes of a text whose margin is taken.
SAMPLE_ROWS = 96
MARGIN_ROWS = 64
DICTIONARY_BYTES = 192 << 10
#: The margin is half of the one that this share of the sampled clean texts exceeds, so that clean texts which the
#: sample does not show are kept as well.
COVERAGE = 0.99

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")  # also takes numbers that are no digits, such as superscripts
_OTHER = re.compile(r"[\W\d_]+")

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]


def normal(text: str) -> bytes:
    """What is encoded: lower-case letters, with each run of anything else as one space."""
    return _OTHER.sub(" ", text.lower()).encode()


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass(frozen=True)
class Model:
    """What was learned: dictionaries, the margin up to which texts are rejected, and what that did to the sample.

    ``coverage`` is the share of clean texts kept, ``precision`` the share of these with the right language, and
    ``caught`` the share of texts without their own dictionary that were rejected.
    """

    dictionaries: dict[str, bytes]
    min_margin: float = 0.0
    coverage: float = 1.0
    precision: float = 1.0
    caught: float = 0.0


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, checks: int = MARGIN_ROWS, size: int = DICTIONARY_BYTES) -> Model:
    """Dictionaries from at most ``rows`` texts and ``size`` bytes of each language, and a margin from ``checks`` others.

    Rows are dealt to buckets by a hash; the smallest hash of each bucket is taken. That is one aggregation with
    partial sums on the map side; the driver gets a bounded sample.
    """
    source = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    mark, buckets = F.xxhash64(F.col(key).cast("string"), F.lit(11)), rows + checks
    least = source.groupBy(F.col(lang).alias("l"), F.pmod(mark, F.lit(buckets)).alias("b")).agg(F.min(mark).alias("m")).collect()
    if not least:
        return Model({})
    chosen = source.where(mark.isin([r.m for r in least])).select(F.col(lang).alias("l"), mark.alias("m"), F.substring(F.col(text), 1, size).alias("t"))
    known: dict[str, list[bytes]] = {}
    held: list[tuple[str, bytes]] = []
    for r in sorted(chosen.dropDuplicates(["l", "m"]).collect(), key=lambda r: (r.l, r.m)):
        if r.m % buckets < rows:
            known.setdefault(r.l, []).append(normal(r.t))
        elif has_letter(r.t):
            held.append((r.l, normal(r.t)))
    dictionaries = {k: b"\n".join(_shares(v, size))[:size] for k, v in sorted(known.items())}
    return calibrate(dictionaries, held)


def _shares(texts: list[bytes], size: int) -> list[bytes]:
    """The texts, the longest cut until all fit, so that no text crowds out the others."""
    left, out = size, {}
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        out[i] = texts[i][: left // (len(texts) - k)]
        left -= len(out[i])
    return [out[i] for i in range(len(texts))]


def calibrate(dictionaries: dict[str, bytes], held: list[tuple[str, bytes]], *, coverage: float = COVERAGE) -> Model:
    """Half the margin that ``coverage`` of the clean texts exceed, and what it does to clean and foreign ones.

    Ties are narrow whatever the margin, so it only weighs texts that do not tie. Of fewer than three languages none
    can be left out, so that nothing tells a foreign margin: only ties are rejected.
    """
    names, coders = sorted(dictionaries), [_coder(dictionaries[x]) for x in sorted(dictionaries)]
    clean, foreign, right = [], [], []
    for own, data in held:
        sizes = [len(c.compress(data)) for c in coders]
        if len(names) < 2 or own not in names:
            continue
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        clean.append(sizes[order[1]] / sizes[order[0]] - 1)
        right.append(names[order[0]] == own)
        rest = [sizes[i] for i in order if names[i] != own]
        if len(rest) > 1:
            foreign.append(rest[1] / rest[0] - 1)
    apart = sorted(x for x in clean if x > 0)
    if not apart or not foreign:
        return Model(dictionaries)
    margin = apart[int((1 - coverage) * len(apart))] / 2
    kept = [r for x, r in zip(clean, right, strict=True) if x > margin]
    caught = sum(x <= margin for x in foreign) / len(foreign)
    return Model(dictionaries, margin, len(kept) / len(clean), sum(kept) / max(1, len(kept)), caught)


def _coder(dictionary: bytes):
    """A lazy matcher with short matches and a dictionary's content before the text."""
    import zstandard

    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=5, window_log=19, hash_log=17, chain_log=17, search_log=3, write_content_size=False)
    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    content.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=how)


def _encoded(data: bytes, coders: list) -> tuple[list[int], bool]:
    """Frame sizes by language, and whether the first ones tie.

    Short texts often tie: they are encoded again, turned by halves and quarters, and summed.
    """
    sizes, tied = [0] * len(coders), True
    for part in (0, 2, 1, 3):
        cut = len(data) * part // 4
        sizes = [s + len(c.compress(data[cut:] + data[:cut] if cut else data)) for s, c in zip(sizes, coders, strict=True)]
        if sizes.count(min(sizes)) == 1:
            tied = part != 0
            break
    return sizes, tied


def classify(docs: DataFrame, model: Model, *, text: str = "text", min_margin: float | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1, from the margin) and rejected.

    A text is rejected if the second smallest frame is not larger by more than the model's margin (or ``min_margin``).
    """
    names, shared = sorted(model.dictionaries), docs.sparkSession.sparkContext.broadcast(model.dictionaries)
    least = model.min_margin if min_margin is None else min_margin
    coders: list = []

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        if not coders:
            coders.extend(_coder(shared.value[name]) for name in names)
        langs, scores, rejects = [], [], []
        for value in batch.column(batch.schema.get_field_index(text)):
            x = value.as_py()
            if x is None or not names or not has_letter(x):
                langs.append(UNDETERMINED), scores.append(0.0), rejects.append(True)
                continue
            sizes, tied = _encoded(normal(x), coders)
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
            margin = second / sizes[best] - 1
            langs.append(names[best]), scores.append(min(1.0, margin / (margin + 0.05)) if margin else 0.0), rejects.append(tied or margin <= least)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejects, pa.bool_())]

    return append_columns(docs, FIELDS, compute, needs=[text])


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Rows kept from learning: the crc32 of the key as text is divisible by ``folds``."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
