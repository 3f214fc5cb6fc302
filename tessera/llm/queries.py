"""One query per operator of this package, applied to its whole table, and DuckDB SQL where it can tell the same."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tessera.llm import chat, decontam, isomedia, langid, neardup, packing, paragraphs, secrets, tokencount, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.is_contaminated().alias("contaminated"),
    )


OP1_SQL = r"""
WITH upper_lower AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents, upper_lower),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), u, l), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark, upper_lower),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
occ AS (SELECT dw.doc_id, dw.i, dw.n, win.item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered from text alone, by a model learned from the roles of other conversations (chat.held_out)."""
    turns = _table(spark, sf_dir, "conversations")
    model = chat.learn(turns.where(~chat.held_out()))
    return chat.format_chats(turns.select("conv_id", "turn", "text"), model).withColumnRenamed("conv", "conv_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs of any length, and passages that repeat inside paragraphs that differ (without a paragraph number)."""
    docs = _table(spark, sf_dir, "documents")
    passages = paragraphs.find_passages(docs).withColumn("kind", F.lit("passage"))
    return paragraphs.find_repeats(docs).withColumn("kind", F.lit("paragraph")).unionByName(passages, allowMissingColumns=True)


def paragraph_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of op3_substring_dedup alone, of any length, for the SQL."""
    return paragraphs.find_repeats(_table(spark, sf_dir, "documents")).drop("text_hash")


#: Words of a passage that op3_substring_dedup covers for certain.
PASSAGE = paragraphs.PASSAGE_WORDS + paragraphs.PASSAGE_WINDOW - 1


def passage_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what op3_substring_dedup's passages cover: places where 50 words begin that another document has as well, per document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = paragraphs.find_passages(docs).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    merged = F.expr("""aggregate(spans, cast(array() AS array<struct<start:bigint,end:bigint>>), (out, s) -> IF(size(out) > 0 AND s.start <= element_at(out, -1).end,
      concat(slice(out, 1, size(out) - 1), array(named_struct('start', element_at(out, -1).start, 'end', greatest(element_at(out, -1).end, s.end)))), concat(out, array(s))))""")
    parts = spans.select("doc_id", "text_hash", F.explode(merged).alias("s")).join(docs.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"])
    part = F.translate(F.substring("text", (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int")), urls.UPPER, urls.LOWER)
    cut = parts.select("doc_id", F.regexp_extract_all(part, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("w")).where(F.size("w") >= PASSAGE)
    runs = cut.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - PASSAGE + 1), lambda i: F.array_join(F.slice("w", i, F.lit(PASSAGE)), " "))).alias("run"))
    runs = runs.select("doc_id", F.sha2("run", 256).alias("run"))
    shared = runs.groupBy("run").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("run")
    return runs.join(shared, "run", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_shared"))


PASSAGE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
),
g AS (
  SELECT doc_id, sha256(array_to_string(w[i:i + 49], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
s AS (SELECT run FROM g GROUP BY run HAVING min(doc_id) < max(doc_id))
SELECT doc_id, count(*) AS n_shared FROM g WHERE run IN (SELECT run FROM s) GROUP BY doc_id
"""


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    media = isomedia.text_to_media(docs).drop("text")
    read = isomedia.index_media(isomedia.digest_payload(media))
    ranges = F.array_join(F.transform("keyframes", lambda k: F.concat(k["start"].cast("string"), F.lit("-"), k["end"].cast("string"))), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%s %dx%d %d ms %d samples keyframes %s", "codec", "width", "height", "duration_ms", "n_samples", ranges).alias("feature"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits: a word changed, some letters cut, a note added."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    place = lambda x: F.floor(n * x / 3).cast("long")
    edit = lambda a, b, new: F.struct(a.alias("start"), b.alias("end"), F.lit(new).alias("new"))
    edits = F.array(edit(place(1), place(1) + 6, " revised"), edit(place(2), place(2) + 3, ""), edit(n, n, "\nSeen 2024."))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", edits)
    counted = tokencount.apply_edits(tokencount.build_trees(docs))
    return counted.select("doc_id", "n_tokens", "n_tokens_after", "chars_encoded", F.length("text_after").cast("long").alias("chars_after"), F.sha2("text_after", 256).alias("after_sha256"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_components(_table(spark, sf_dir, "documents"), neardup.Settings(words=3, threshold=Fraction(85, 100)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.learn(docs.where("not held_out"))
    return langid.classify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


#: The rules of the URL query: verdict, host, path.
URL_RULES = [
    urls.Rule("allow", "com", "/"),
    urls.Rule("block", "example.com", "/en/"),
    urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
    urls.Rule("block", "net", "/fr/"),
]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8_url_filter decides by rules alone, for the SQL."""
    return op8_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
s AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rule, verdict, host, path) AS (VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'),
  ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
fits AS (
  SELECT s.page_id AS page_id, s.host AS host, s.path AS path, r.rule AS rule, r.verdict AS verdict
  FROM s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id, host, path
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).drop("text")
    base = F.filter("secrets", lambda x: x["kind"] != "literal")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed patterns' matches of op10_secret_scan, counted, for the SQL."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id,
    regexp_extract_all(t, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS assign,
    regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS access, regexp_extract_all(t, '[0-9a-f]+') AS hex
  FROM d
)
SELECT doc_id, CAST(len(list_filter(assign, lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
       CAST(len(list_filter(access, lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(hex, lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM m
"""

OP3_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT doc_id, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)
),
d AS (SELECT * FROM (SELECT doc_id * 16777216 + i - 1 AS u, regexp_extract_all(l[i], '[^\x20\x09-\x0D]+') AS w FROM lines) WHERE len(w) > 0),
k AS (SELECT u, w, array_to_string(w, ' ') AS t FROM d),
one AS (SELECT t, min(u) AS u, any_value(w) AS w FROM k GROUP BY t),
g AS (
  SELECT DISTINCT u, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT u, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM one)
),
n AS (SELECT u, count(*) AS n FROM g GROUP BY u),
p AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.u < b.u GROUP BY 1, 2),
e AS (SELECT p.a AS a, p.b AS b FROM p JOIN n x ON x.u = p.a JOIN n y ON y.u = p.b WHERE 5 * p.c >= 4 * (x.n + y.n - p.c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS node, a AS seen FROM sym UNION SELECT r.node, sym.b FROM r JOIN sym ON r.seen = sym.a),
c AS (SELECT node, min(seen) AS first FROM r GROUP BY node),
a AS (SELECT k.u AS u, coalesce(c.first, one.u) AS first FROM k JOIN one ON one.t = k.t LEFT JOIN c ON c.node = one.u),
f AS (SELECT first FROM a GROUP BY first HAVING count(*) > 1)
SELECT u // 16777216 AS doc_id, CAST(u % 16777216 AS INTEGER) AS paragraph, a.first // 16777216 AS cluster_doc_id,
       CAST(a.first % 16777216 AS INTEGER) AS cluster_paragraph, u <> a.first AS removed
FROM a JOIN f ON f.first = a.first
"""

OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT p.a AS a, p.b AS b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)
),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, sym.b FROM r JOIN sym ON r.seen = sym.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id AS doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id AS component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_secret_scan": op10_secret_scan,
    "paragraph_repeats": paragraph_repeats,
    "passage_repeats": passage_repeats,
    "url_rules": url_rules,
    "secret_patterns": secret_patterns,
}
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "paragraph_repeats": OP3_SQL,
    "passage_repeats": PASSAGE_SQL,
    "url_rules": URL_SQL,
    "secret_patterns": SECRET_SQL,
    "op6_minhash_near_dedup": OP6_SQL,
}
