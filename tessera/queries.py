"""Registered queries of the engine's operators, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tessera.functions import expr as e
from tessera.operators.query import Query, query
from tessera.plans.patterns import Engine
from tessera.sources.index import TupleIndex
from tessera.sources.tables import RecordTable, load, table, tuples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The sample tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> RecordTable:
        return load(self.spark, self.folder, name)


def register(sql: str | None = None, name: str | None = None):
    """Register a function of Tables that gives a Query or a DataFrame."""

    def wrap(make: Callable[[Tables], Query | DataFrame]):
        own = name or make.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made = make(Tables(spark, sf_dir))
            return made.run() if isinstance(made, Query) else made

        QUERIES[own] = run
        if sql:
            ORACLE_SQL[own] = sql
        return make

    return wrap


# --- the flagship: popular records with their owner, best first ----------------------------------


@register("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, c_name AS by_name
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_totalprice > 100000 AND c_mktsegment = 'BUILDING'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def popular(t: Tables) -> Query:
    return (
        query()
        .from_(o=t.orders)
        .inner_join(lambda r: e.eq(r.o.o_custkey, r.c.c_custkey), c=t.customer)
        .where(lambda r: e.and_(e.gt(r.o.o_totalprice, 100000), e.eq(r.c.c_mktsegment, "BUILDING")))
        .select(lambda r: {"id": r.o.id, "price": r.o.o_totalprice, "by_name": r.c.c_name})
        .order_by(lambda r: r.o.o_totalprice, "desc")
        .order_by(lambda r: r.o.o_orderkey)
        .limit(20)
    )


# --- projection ------------------------------------------------------------------------------------


@register("SELECT n_name AS name, n_regionkey AS region FROM nation")
def scan_project(t: Tables) -> Query:
    return query().from_(n=t.nation).select(lambda r: {"name": r.n.n_name, "region": r.n.n_regionkey})


def _flat(df: DataFrame, **cols: str) -> DataFrame:
    return df.select(*[F.col(v).alias(k) for k, v in cols.items()])


@register("SELECT n_name AS name, n_nationkey AS key, CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def select_struct(t: Tables) -> DataFrame:
    made = query().from_(n=t.nation).select(lambda r: {"name": r.n.n_name, "keys": {"key": r.n.n_nationkey, "id": r.n.id}})
    return _flat(made.run(), name="name", key="keys.key", id="keys.id")


@register("SELECT n_name AS value FROM nation")
def select_scalar(t: Tables) -> Query:
    return query().from_(n=t.nation).select(lambda r: r.n.n_name)


@register("SELECT n_nationkey AS a, n_regionkey AS b FROM nation")
def select_array(t: Tables) -> DataFrame:
    made = query().from_(n=t.nation).select(lambda r: {"pair": [r.n.n_nationkey, r.n.n_regionkey]}).run()
    return made.select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"))


@register("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_regionkey AS key, r_name AS name FROM region")
def no_select(t: Tables) -> DataFrame:
    return _flat(query().from_(r=t.region).run(), id="r.id", key="r.r_regionkey", name="r.r_name")


# --- filters ---------------------------------------------------------------------------------------


def _orders(t: Tables, test: Callable) -> Query:
    return query().from_(o=t.orders).where(test).select(lambda r: {"k": r.o.o_orderkey})


def _filter(name: str, test: Callable, where: str) -> None:
    register(f"SELECT o_orderkey AS k FROM orders WHERE {where}", name)(lambda t: _orders(t, test))


_filter("filter_eq", lambda r: e.eq(r.o.o_orderstatus, "F"), "o_orderstatus = 'F'")
_filter("filter_ne", lambda r: e.ne(r.o.o_orderstatus, "F"), "o_orderstatus <> 'F'")
_filter("filter_gt", lambda r: e.gt(r.o.o_totalprice, 200000), "o_totalprice > 200000")
_filter("filter_gte", lambda r: e.gte(r.o.o_orderkey, 100), "o_orderkey >= 100")
_filter("filter_lt", lambda r: e.lt(r.o.o_totalprice, 50000.5), "o_totalprice < 50000.5")
_filter("filter_lte", lambda r: e.lte(r.o.o_orderkey, 100), "o_orderkey <= 100")
_filter("filter_and", lambda r: e.and_(e.eq(r.o.o_orderstatus, "O"), e.gt(r.o.o_totalprice, 100000)), "o_orderstatus = 'O' AND o_totalprice > 100000")
_filter("filter_or", lambda r: e.or_(e.eq(r.o.o_orderstatus, "P"), e.lt(r.o.o_totalprice, 20000)), "o_orderstatus = 'P' OR o_totalprice < 20000")
_filter("filter_not", lambda r: e.not_(e.or_(e.eq(r.o.o_orderstatus, "P"), e.lt(r.o.o_totalprice, 20000))), "NOT (o_orderstatus = 'P' OR o_totalprice < 20000)")
_filter("filter_in_list", lambda r: e.in_array(r.o.o_orderpriority, ["1-URGENT", "5-LOW"]), "o_orderpriority IN ('1-URGENT', '5-LOW')")
_filter("filter_time", lambda r: e.gte(r.o.o_orderdate, datetime(1995, 6, 1)), "o_orderdate >= TIMESTAMP '1995-06-01'")
_filter("filter_time_millis", lambda r: e.lt(r.o.o_orderdate, 801964800000), "o_orderdate < TIMESTAMP '1995-06-01'")
_filter("filter_id", lambda r: e.eq(r.o.id, "7"), "o_orderkey = 7")
_filter("filter_type_mismatch", lambda r: e.eq(r.o.o_orderkey, "7"), "false")
_filter("starts_with", lambda r: e.starts_with(r.o.o_orderpriority, "1-"), "starts_with(o_orderpriority, '1-')")
_filter("ends_with", lambda r: e.ends_with(r.o.o_orderpriority, "W"), "o_orderpriority LIKE '%W'")
_filter("not_starts_with", lambda r: e.not_(e.starts_with(r.o.o_orderpriority, "1-")), "NOT starts_with(o_orderpriority, '1-')")


@register("SELECT p_partkey AS k FROM part WHERE p_type LIKE '%BRASS%' OR p_type LIKE '_MALL%'")
def like(t: Tables) -> Query:
    return query().from_(p=t.part).where(lambda r: e.or_(e.like(r.p.p_type, "%BRASS%"), e.like(r.p.p_type, "_MALL%"))).select(lambda r: {"k": r.p.p_partkey})


@register("SELECT p_partkey AS k FROM part WHERE p_name ILIKE '%A%'")
def ilike(t: Tables) -> Query:
    return query().from_(p=t.part).where(lambda r: e.ilike(r.p.p_name, "%A%")).select(lambda r: {"k": r.p.p_partkey})


@register("SELECT vec_id AS k FROM embeddings WHERE list_contains(embedding, embedding[1]) AND len(embedding) = 64")
def in_array_field(t: Tables) -> Query:
    vectors = t.embeddings
    firsts = table(vectors.path, vectors.df.withColumn("head", F.col("embedding")[0]), "vec_id")
    return query().from_(v=firsts).where(lambda r: e.and_(e.in_array(r.v.head, r.v.embedding), e.eq(e.length(r.v.embedding), 64))).select(lambda r: {"k": r.v.vec_id})


# --- scalars ---------------------------------------------------------------------------------------


@register("SELECT c_custkey AS k, CAST(length(c_name) AS BIGINT) AS n, upper(c_mktsegment) AS u, lower(c_mktsegment) AS l, concat(c_name, '/', CAST(c_nationkey AS VARCHAR)) AS s FROM customer")
def string_functions(t: Tables) -> Query:
    return query().from_(c=t.customer).select(lambda r: {"k": r.c.c_custkey, "n": e.length(r.c.c_name), "u": e.upper(r.c.c_mktsegment), "l": e.lower(r.c.c_mktsegment), "s": e.concat(r.c.c_name, "/", r.c.c_nationkey)})


@register("SELECT vec_id AS k, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def length_array(t: Tables) -> Query:
    return query().from_(v=t.embeddings).select(lambda r: {"k": r.v.vec_id, "n": e.length(r.v.embedding)})


@register("""
SELECT o_orderkey AS k, o_orderkey + 1 AS a, o_orderkey - o_custkey AS s, o_orderkey * 3 AS m,
       round(o_totalprice / 7, 4) AS d, round(o_totalprice * 2, 4) AS f FROM orders""")
def arithmetic(t: Tables) -> DataFrame:
    made = query().from_(o=t.orders).select(
        lambda r: {
            "k": r.o.o_orderkey,
            "a": e.add(r.o.o_orderkey, 1),
            "s": e.subtract(r.o.o_orderkey, r.o.o_custkey),
            "m": e.multiply(r.o.o_orderkey, 3),
            "d": e.divide(r.o.o_totalprice, 7),
            "f": e.multiply(r.o.o_totalprice, 2),
        }
    )
    return made.run().withColumn("d", F.round("d", 4)).withColumn("f", F.round("f", 4))


@register("SELECT n_nationkey AS k, round(100.0 / nullif(n_regionkey, 0), 6) AS q FROM nation")
def divide_by_zero(t: Tables) -> DataFrame:
    return query().from_(n=t.nation).select(lambda r: {"k": r.n.n_nationkey, "q": e.divide(100, r.n.n_regionkey)}).run().withColumn("q", F.round("q", 6))


@register("""
SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size,
       CASE WHEN p_size > 40 THEN p_brand END AS brand FROM part""")
def case_when(t: Tables) -> Query:
    return query().from_(p=t.part).select(lambda r: {"k": r.p.p_partkey, "size": e.case_when(e.gt(r.p.p_size, 25), "large", "small"), "brand": e.case_when(e.gt(r.p.p_size, 40), r.p.p_brand)})


def _labelled(t: Tables) -> Query:
    return query().from_(d=t.documents).left_join(lambda r: e.eq(r.d.doc_id, r.l.doc_id), l=t.labels)


@register("SELECT d.doc_id AS k, coalesce(l.quality, -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_default(t: Tables) -> Query:
    return _labelled(t).select(lambda r: {"k": r.d.doc_id, "q": e.coalesce(r.l.quality, -1)})


@register("SELECT d.doc_id AS k, l.quality IS NULL AS missing, false AS is_null FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def is_undefined(t: Tables) -> Query:
    return _labelled(t).select(lambda r: {"k": r.d.doc_id, "missing": e.is_undefined(r.l.quality), "is_null": e.is_null(r.l.quality)})


@register("SELECT doc_id AS k FROM documents WHERE doc_id % 3 = 0")
def explicit_null(t: Tables) -> Query:
    marked = t.documents.df.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("lang"))).otherwise(F.array().cast("array<string>")).alias("_nulls"))
    return query().from_(d=table("data/marked", marked, "doc_id")).where(lambda r: e.is_null(r.d.lang)).select(lambda r: {"k": r.d.doc_id})


# --- joins -----------------------------------------------------------------------------------------

_ON = "SELECT d.doc_id AS d, l.quality AS q FROM documents d {} JOIN labels l ON d.doc_id = l.doc_id{}"


def _docs_labels(t: Tables, kind: str, *tests: Callable) -> Query:
    q = query().from_(d=t.documents).join(lambda r: e.eq(r.d.doc_id, r.l.doc_id), kind, l=t.labels)
    for test in tests:
        q = q.where(test)
    return q.select(lambda r: {"d": r.d.doc_id, "q": r.l.quality})


register(_ON.format("", ""), "join_inner")(lambda t: _docs_labels(t, "inner"))
register(_ON.format("LEFT", ""), "join_left")(lambda t: _docs_labels(t, "left"))
register("SELECT coalesce(d.doc_id, l.doc_id) AS d, l.quality AS q FROM documents d RIGHT JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en'", "join_right")(lambda t: _docs_labels(t, "right", lambda r: e.eq(r.d.lang, "en")))
register(
    "SELECT coalesce(d.doc_id, l.doc_id) AS d, l.quality AS q FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id AND d.lang = 'en' AND l.quality > 0",
    "join_full",
)(lambda t: _docs_labels(t, "full", lambda r: e.eq(r.d.lang, "en"), lambda r: e.gt(r.l.quality, 0)))
register(_ON.format("LEFT", " AND l.quality = 1"), "join_left_where_const")(lambda t: _docs_labels(t, "left", lambda r: e.eq(r.l.quality, 1)))
register(_ON.format("LEFT", " WHERE l.quality > 0"), "join_left_theta")(lambda t: _docs_labels(t, "left", lambda r: e.gt(r.l.quality, 0)))


@register("SELECT o_orderkey AS k, c_name AS c FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_default_left(t: Tables) -> Query:
    return query().from_(o=t.orders).join(lambda r: e.eq(r.o.o_custkey, r.c.c_custkey), c=t.customer).select(lambda r: {"k": r.o.o_orderkey, "c": r.c.c_name})


@register("SELECT s_name AS s, n_name AS n, r_name AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_three_way(t: Tables) -> Query:
    return (
        query()
        .from_(s=t.supplier)
        .inner_join(lambda r: e.eq(r.s.s_nationkey, r.n.n_nationkey), n=t.nation)
        .inner_join(lambda r: e.eq(r.n.n_regionkey, r.g.r_regionkey), g=t.region)
        .select(lambda r: {"s": r.s.s_name, "n": r.n.n_name, "r": r.g.r_name})
    )


@register("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t: Tables) -> Query:
    return query().from_(a=t.nation).inner_join(lambda r: e.eq(r.a.n_regionkey, r.b.n_regionkey), b=t.nation).select(lambda r: {"a": r.a.n_name, "b": r.b.n_name})


@register("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def join_theta(t: Tables) -> Query:
    return query().from_(a=t.nation, b=t.nation).where(lambda r: e.lt(r.a.n_nationkey, r.b.n_nationkey)).select(lambda r: {"a": r.a.n_name, "b": r.b.n_name})


@register("SELECT n_name AS n, r_name AS r FROM nation, region")
def cross_join(t: Tables) -> Query:
    return query().from_(n=t.nation, r=t.region).select(lambda r: {"n": r.n.n_name, "r": r.r.r_name})


@register("SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey")
def join_multi_key(t: Tables) -> Query:
    return query().from_(c=t.customer).inner_join(lambda r: e.and_(e.eq(r.c.c_nationkey, r.s.s_nationkey), e.eq(r.c.c_custkey, r.s.s_suppkey)), s=t.supplier).select(lambda r: {"c": r.c.c_custkey, "s": r.s.s_suppkey})


@register("SELECT c_custkey AS c, event_type AS kind FROM customer LEFT JOIN events ON c_custkey = user_id")
def join_left_nonid(t: Tables) -> Query:
    return query().from_(c=t.customer).left_join(lambda r: e.eq(r.c.c_custkey, r.v.user_id), v=t.events).select(lambda r: {"c": r.c.c_custkey, "kind": r.v.event_type})


@register("SELECT doc_id AS d FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_anti_idiom(t: Tables) -> Query:
    return _labelled(t).where(lambda r: e.is_undefined(r.l.quality)).select(lambda r: {"d": r.d.doc_id})


@register("SELECT doc_id AS d FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_semi_distinct(t: Tables) -> Query:
    return query().from_(d=t.documents).inner_join(lambda r: e.eq(r.d.doc_id, r.l.doc_id), l=t.labels).select(lambda r: {"d": r.d.doc_id}).distinct()


@register("SELECT coalesce(d.doc_id, l.doc_id) AS k FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def unified_column(t: Tables) -> Query:
    return query().from_(d=t.documents).full_join(lambda r: e.eq(r.d.doc_id, r.l.doc_id), l=t.labels).select(lambda r: {"k": r.l.doc_id})


@register("""
WITH core AS (SELECT r_regionkey AS g, n_nationkey AS n, s_suppkey AS s FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000)
SELECT g, n, s FROM core
UNION ALL SELECT r_regionkey, NULL, NULL FROM region WHERE r_regionkey NOT IN (SELECT g FROM core)
UNION ALL SELECT n_regionkey, n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT n FROM core)
UNION ALL SELECT NULL, s_nationkey, s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s FROM core)""")
def join_full_three_way(t: Tables) -> Query:
    return (
        query()
        .from_(g=t.region)
        .inner_join(lambda r: e.eq(r.g.r_regionkey, r.n.n_regionkey), n=t.nation)
        .full_join(lambda r: e.and_(e.eq(r.n.n_nationkey, r.s.s_nationkey), e.gt(r.s.s_acctbal, 5000)), s=t.supplier)
        .select(lambda r: {"g": r.g.r_regionkey, "n": r.n.n_nationkey, "s": r.s.s_suppkey})
    )


# --- grouping --------------------------------------------------------------------------------------


@register("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def group_one(t: Tables) -> Query:
    return query().from_(o=t.orders).group_by(lambda r: r.o.o_orderstatus).select(lambda r: {"status": r.o.o_orderstatus, "n": e.count()})


@register("SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY 1, 2")
def group_multi(t: Tables) -> DataFrame:
    made = query().from_(l=t.lineitem).group_by(lambda r: [r.l.l_returnflag, r.l.l_linestatus]).select(lambda r: {"f": r.l.l_returnflag, "s": r.l.l_linestatus, "n": e.count(), "q": e.sum_(r.l.l_quantity), "p": e.avg(r.l.l_extendedprice)})
    return made.run().withColumn("q", F.round("q", 2)).withColumn("p", F.round("p", 4))


@register("SELECT count(*) AS n, max(event_id) AS last FROM events GROUP BY upper(event_type)")
def group_expr_key(t: Tables) -> Query:
    return query().from_(v=t.events).group_by(lambda r: e.upper(r.v.event_type)).select(lambda r: {"n": e.count(), "last": e.max_(r.v.event_id)})


@register("""
SELECT d.lang AS lang, count(*) AS n, count(l.quality) AS labelled, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS s,
       round(avg(l.quality), 6) AS a, min(l.toxic) AS lo, max(l.toxic) AS hi
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def agg_all(t: Tables) -> DataFrame:
    made = _labelled(t).group_by(lambda r: r.d.lang).select(
        lambda r: {"lang": r.d.lang, "n": e.count(), "labelled": e.count(r.l.quality), "s": e.sum_(r.l.quality), "a": e.avg(r.l.quality), "lo": e.min_(r.l.toxic), "hi": e.max_(r.l.toxic)}
    )
    return made.run().withColumn("a", F.round("a", 6))


@register("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, min(o_orderdate) AS first, max(o_orderpriority) AS p FROM orders")
def agg_global(t: Tables) -> DataFrame:
    return query().from_(o=t.orders).select(lambda r: {"n": e.count(), "s": e.sum_(r.o.o_totalprice), "first": e.min_(r.o.o_orderdate), "p": e.max_(r.o.o_orderpriority)}).run().withColumn("s", F.round("s", 2))


@register("SELECT count(*) AS n FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0")
def agg_global_empty(t: Tables) -> Query:
    return query().from_(o=t.orders).where(lambda r: e.lt(r.o.o_totalprice, 0)).select(lambda r: {"n": e.count()})


@register("SELECT d.lang AS lang, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS s FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 5 GROUP BY 1")
def sum_all_missing(t: Tables) -> Query:
    return _labelled(t).where(lambda r: e.eq(r.l.quality, 5)).group_by(lambda r: r.d.lang).select(lambda r: {"lang": r.d.lang, "s": e.sum_(r.l.quality)})


@register("SELECT r_name AS r, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def group_first_field(t: Tables) -> Query:
    return query().from_(n=t.nation).inner_join(lambda r: e.eq(r.n.n_regionkey, r.g.r_regionkey), g=t.region).group_by(lambda r: r.g.r_regionkey).select(lambda r: {"r": r.g.r_name, "n": e.count()})


@register("SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_agg(t: Tables) -> Query:
    return query().from_(o=t.orders).group_by(lambda r: r.o.o_custkey).select(lambda r: {"c": r.o.o_custkey, "n": e.count()}).having(lambda r: e.gt(e.count(), 12))


@register("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 250000")
def having_plain(t: Tables) -> Query:
    return query().from_(o=t.orders).select(lambda r: {"k": r.o.o_orderkey}).having(lambda r: e.gt(r.o.o_totalprice, 250000))


@register("SELECT o_custkey AS c FROM orders GROUP BY 1 HAVING max(o_orderkey) - min(o_orderkey) > 2 * count(*)")
def having_expr_agg(t: Tables) -> Query:
    spread = lambda r: e.subtract(e.max_(r.o.o_orderkey), e.min_(r.o.o_orderkey))
    return query().from_(o=t.orders).group_by(lambda r: r.o.o_custkey).select(lambda r: {"c": r.o.o_custkey}).having(lambda r: e.gt(spread(r), e.multiply(e.count(), 2)))


@register("SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
def distinct_rows(t: Tables) -> Query:
    return query().from_(o=t.orders).select(lambda r: {"s": r.o.o_orderstatus, "p": r.o.o_orderpriority}).distinct()


@register("SELECT DISTINCT n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5)")
def distinct_after_having(t: Tables) -> Query:
    return query().from_(o=t.orders).group_by(lambda r: r.o.o_custkey).select(lambda r: {"n": e.count()}).having(lambda r: e.gt(e.count(), 5)).distinct()


# --- order and paging ------------------------------------------------------------------------------


@register("SELECT o_orderkey AS k FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def order_multi(t: Tables) -> Query:
    return query().from_(o=t.orders).select(lambda r: {"k": r.o.o_orderkey}).order_by(lambda r: r.o.o_orderpriority).order_by(lambda r: r.o.o_totalprice, "desc").order_by(lambda r: r.o.o_orderkey).limit(50)


@register("SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10")
def order_by_agg(t: Tables) -> DataFrame:
    made = query().from_(o=t.orders).group_by(lambda r: r.o.o_custkey).select(lambda r: {"c": r.o.o_custkey, "s": e.sum_(r.o.o_totalprice)}).order_by(lambda r: e.sum_(r.o.o_totalprice), "desc").order_by(lambda r: r.o.o_custkey).limit(10)
    return made.run().withColumn("s", F.round("s", 2))


@register("SELECT p_name AS name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def order_unselected(t: Tables) -> Query:
    return query().from_(p=t.part).select(lambda r: {"name": r.p.p_name}).order_by(lambda r: r.p.p_retailprice, "desc").order_by(lambda r: r.p.p_partkey).limit(25)


@register("SELECT l_orderkey AS o, l_extendedprice AS p FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 100")
def topk(t: Tables) -> Query:
    return query().from_(l=t.lineitem).select(lambda r: {"o": r.l.l_orderkey, "p": r.l.l_extendedprice}).order_by(lambda r: r.l.l_extendedprice, "desc").order_by(lambda r: r.l.l_orderkey).order_by(lambda r: r.l.l_partkey).limit(100)


@register("SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def offset_limit(t: Tables) -> Query:
    return query().from_(o=t.orders).select(lambda r: {"k": r.o.o_orderkey}).order_by(lambda r: r.o.o_orderkey).offset(40).limit(20)


# --- callbacks -------------------------------------------------------------------------------------


@register("SELECT p_partkey AS k FROM part WHERE p_size % 7 = 3")
def fn_where(t: Tables) -> Query:
    return query().from_(p=t.part).fn_where(lambda row: row.p["p_size"] % 7 == 3).select(lambda r: {"k": r.p.p_partkey})


@register("SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1 HAVING count(*) % 2 = 0")
def fn_having(t: Tables) -> Query:
    return query().from_(p=t.part).group_by(lambda r: r.p.p_brand).select(lambda r: {"b": r.p.p_brand, "n": e.count()}).fn_having(lambda row: row.n % 2 == 0)


@register("SELECT p_partkey * 10 AS ten, concat('<', p_brand, '>') AS tag FROM part")
def fn_select(t: Tables) -> Query:
    return query().from_(p=t.part).select(lambda r: {"k": r.p.p_partkey, "b": r.p.p_brand}).fn_select(lambda row: {"ten": row.k * 10, "tag": F.concat(F.lit("<"), row.b, F.lit(">"))})


# --- patterns --------------------------------------------------------------------------------------


@register("SELECT o_totalprice AS price, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def pattern_join(t: Tables) -> DataFrame:
    return Engine([t.orders, t.customer]).query(["?price", "?name"], [("data/orders/?o", "o_custkey", "?c"), ("data/orders/?o", "o_totalprice", "?price"), ("data/customer/?p", "c_custkey", "?c"), ("data/customer/?p", "c_name", "?name"), "?price > 200000"])


@register("SELECT CAST(d.doc_id AS VARCHAR) AS d, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pattern_opt(t: Tables) -> DataFrame:
    return Engine([t.documents, t.labels]).query(["?d", "?q"], [("data/documents/?d", "lang", "?lang"), {"opt": ("data/labels/?d", "quality", "?q")}])


@register("SELECT CAST(d.doc_id AS VARCHAR) AS d, l.quality AS q, l.toxic AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0")
def pattern_optall(t: Tables) -> DataFrame:
    return Engine([t.documents, t.labels]).query(["?d", "?q", "?t"], [("data/documents/?d", "lang", "?lang"), {"opt_all": [("data/labels/?d", "quality", "?q"), ("data/labels/?d", "toxic", "?t"), "?t == 0"]}])


@register("SELECT CAST(n_nationkey AS VARCHAR) AS n FROM nation WHERE n_regionkey >= 2 AND n_name <> 'CHINA'")
def pattern_predicate(t: Tables) -> DataFrame:
    return Engine([t.nation]).query(["?n"], [("data/nation/?n", "n_regionkey", "?r"), ("data/nation/?n", "n_name", "?name"), "?r >= 2", '?name != "CHINA"'])


@register("SELECT CAST(a.n_nationkey AS VARCHAR) AS a, CAST(b.n_nationkey AS VARCHAR) AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def pattern_var_pred(t: Tables) -> DataFrame:
    nation = t.nation
    return Engine([nation]).query(["?a", "?b"], [("data/nation/?a", "n_regionkey", "?r"), ("data/nation/?b", "n_regionkey", "?r"), ("data/nation/?a", "n_nationkey", "?x"), ("data/nation/?b", "n_nationkey", "?y"), "?x < ?y"])


@register("""
SELECT id, attr, v FROM (
  SELECT CAST(r_regionkey AS VARCHAR) AS id, '_id' AS attr, CAST(r_regionkey AS VARCHAR) AS v FROM region
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'r_regionkey', CAST(r_regionkey AS VARCHAR) FROM region
  UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 'r_name', r_name FROM region)""")
def pattern_attr_var(t: Tables) -> DataFrame:
    return Engine([t.region]).query(["?id", "?attr", "?v"], [("data/region/?id", "?attr", "?v")])


@register("SELECT CAST(c_custkey AS VARCHAR) AS c FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR) FROM customer")
def pattern_prefix(t: Tables) -> DataFrame:
    c = t.customer.df.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("info.name"), F.col("c_mktsegment").alias("info.segment"), F.col("c_acctbal").alias("information"))
    return Engine([table("data/customer", c)]).query(["?c"], [("data/customer/?c", "info.*", "?v")])


@register("SELECT concat('data/nation/', CAST(n_nationkey AS VARCHAR)) AS p FROM nation WHERE n_regionkey = 1 UNION ALL SELECT concat('data/region/', CAST(r_regionkey AS VARCHAR)) FROM region WHERE r_regionkey = 1 UNION ALL SELECT concat('data/nation/', CAST(n_nationkey AS VARCHAR)) FROM nation WHERE n_nationkey = 1")
def pattern_bare_path(t: Tables) -> DataFrame:
    return Engine([t.nation, t.region]).query(["?p"], [("?p", "?a", 1)])


@register("SELECT r_name AS name FROM region WHERE r_regionkey = 2")
def pattern_const_path(t: Tables) -> DataFrame:
    return Engine([t.region]).query(["?name"], [("data/region/2", "r_name", "?name")])


# --- records and tuples ----------------------------------------------------------------------------


@register("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0 ORDER BY CAST(s_suppkey AS VARCHAR) LIMIT 20 OFFSET 10")
def records_list(t: Tables) -> DataFrame:
    from tessera.operators.records import list_records

    page = list_records(t.supplier, test=lambda row: row.s_acctbal > 0, limit=20, offset=10)
    return page.frame.select("id", "s_name", "s_acctbal")


@register("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name FROM supplier WHERE s_suppkey = 3")
def records_get(t: Tables) -> DataFrame:
    from tessera.operators.records import get_record

    return get_record(t.supplier, "3").select("id", "s_name")


@register("""
SELECT concat('data/nation/', CAST(n_nationkey AS VARCHAR)) AS path, 'n_name' AS attr, n_name AS text FROM nation
UNION ALL SELECT concat('data/nation/', CAST(n_nationkey AS VARCHAR)), 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation
UNION ALL SELECT concat('data/nation/', CAST(n_nationkey AS VARCHAR)), 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation""")
def tuples_scan(t: Tables) -> DataFrame:
    return tuples(t.nation, system=False).select("path", "attr", "text")


@register("SELECT concat('data/nation/', CAST(n_nationkey AS VARCHAR)) AS path, attr FROM (SELECT n_nationkey, unnest(['_id', 'n_name', 'n_nationkey', 'n_regionkey']) AS attr FROM nation WHERE n_nationkey = 4)")
def index_attrs(t: Tables) -> DataFrame:
    return TupleIndex([t.nation]).attrs("data/nation/4").select("path", "attr")


@register("SELECT concat('data/orders/', CAST(o_orderkey AS VARCHAR)) AS path, o_orderstatus AS text FROM orders")
def index_by_schema_attr(t: Tables) -> DataFrame:
    return TupleIndex([t.orders]).by_schema_attr("data/orders", "o_orderstatus").select("path", "text")


@register("SELECT concat('data/customer/', CAST(c_custkey AS VARCHAR)) AS path, 'c_nationkey' AS attr FROM customer WHERE c_nationkey = 3 UNION ALL SELECT concat('data/customer/', CAST(c_custkey AS VARCHAR)), 'c_custkey' FROM customer WHERE c_custkey = 3")
def index_by_value(t: Tables) -> DataFrame:
    return TupleIndex([t.customer]).by_value(3).select("path", "attr")


@register("SELECT concat('data/region/', CAST(r_regionkey AS VARCHAR)) AS path FROM region UNION ALL SELECT concat('data/nation/', CAST(n_nationkey AS VARCHAR)) FROM nation")
def index_paths(t: Tables) -> DataFrame:
    return TupleIndex([t.region, t.nation]).paths("data")


@register("""
SELECT s, max(n) AS most FROM (SELECT o_custkey AS c, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def subquery_two_level(t: Tables) -> Query:
    inner = query().from_(o=t.orders).group_by(lambda r: [r.o.o_custkey, r.o.o_orderstatus]).select(lambda r: {"c": r.o.o_custkey, "s": r.o.o_orderstatus, "n": e.count()})
    return query().from_(x=table("live/counts", inner.run(), ["c", "s"])).group_by(lambda r: r.x.s).select(lambda r: {"s": r.x.s, "most": e.max_(r.x.n)})


# --- writes and streams ----------------------------------------------------------------------------


def _event_mutations(t: Tables) -> DataFrame:
    """Events as mutations of their users: purchases put, views patch, every 97th event deletes."""
    v = t.events.df
    path = F.concat(F.lit("app/users/"), F.col("user_id").cast("string"))
    op = F.when(F.col("event_id") % 97 == 0, "delete").when(F.col("event_id") % 5 == 0, "put").otherwise("patch")
    attr = F.when(F.col("event_id") % 97 != 0, F.col("event_type"))
    return v.select(path.alias("path"), F.col("event_id").alias("seq"), op.alias("op"), attr.alias("attr"), F.when(attr.isNotNull(), F.col("event_id").cast("string")).alias("text"))


_STEPS = """
WITH m AS (
  SELECT concat('app/users/', CAST(user_id AS VARCHAR)) AS path, event_id AS seq, event_type AS attr,
         CASE WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 5 = 0 THEN 'put' ELSE 'patch' END AS op FROM events
)"""


@register(
    _STEPS
    + """, b AS (SELECT path, max(seq) AS barrier FROM m WHERE op IN ('put', 'delete') GROUP BY path),
k AS (SELECT m.path, m.attr, max(m.seq) AS seq FROM m LEFT JOIN b ON m.path = b.path WHERE m.op <> 'delete' AND (b.barrier IS NULL OR m.seq >= b.barrier) GROUP BY m.path, m.attr)
SELECT path, attr, CAST(seq AS VARCHAR) AS text FROM k"""
)
def store_fold(t: Tables) -> DataFrame:
    from tessera.operators.mutations import fold_mutations

    empty = t.spark.createDataFrame([], "path string, attr string, text string")
    return fold_mutations(empty, _event_mutations(t))


@register(
    _STEPS
    + """, c AS (SELECT path, max(seq) AS cut FROM m WHERE op = 'delete' GROUP BY path)
SELECT m.path AS path, count(*) AS version FROM m LEFT JOIN c ON m.path = c.path WHERE c.cut IS NULL OR m.seq > c.cut GROUP BY m.path"""
)
def version_stamp(t: Tables) -> DataFrame:
    from tessera.operators.mutations import fold_versions

    empty = t.spark.createDataFrame([], "path string, version long")
    return fold_versions(empty, _event_mutations(t))


@register("SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1 HAVING count(*) > 1")
def live_materialized(t: Tables) -> DataFrame:
    from tessera.streaming.live import LiveQuery

    orders = t.orders
    live = LiveQuery(lambda: query().from_(o=orders).where(lambda r: e.gt(r.o.o_totalprice, 200000)).select(lambda r: {"id": r.o.id, "c": r.o.o_custkey}))
    return query().from_(x=live).group_by(lambda r: r.x.c).select(lambda r: {"c": r.x.c, "n": e.count()}).having(lambda r: e.gt(e.count(), 1)).run()


@register("SELECT concat('app/users/', CAST(user_id AS VARCHAR)) AS path, arg_max(event_type, event_id) AS type, max(event_id) AS version, count(*) AS changes FROM events GROUP BY 1")
def change_feed_replay(t: Tables) -> DataFrame:
    """The events as a change feed, read as a stream and folded until it is exhausted."""
    import uuid

    from tessera.session import shared_dir
    from tessera.streaming.feed import EVENTS, latest

    folder = f"{shared_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    path = F.concat(F.lit("app/users/"), F.col("user_id").cast("string"))
    log = t.events.df.select(F.col("event_id").alias("seq"), F.col("event_type").alias("type"), path.alias("path"), F.lit("app/users").alias("schema"), F.array("event_type").alias("attrs"), F.col("event_id").alias("version"))
    log.write.parquet(f"{folder}/log")
    stream = latest(t.spark.readStream.schema(EVENTS).parquet(f"{folder}/log"))

    def keep(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state")

    run = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.parquet(f"{folder}/state")
