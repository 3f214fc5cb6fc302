"""The query builder over posts and users that do not line up, and against a nested-loop model."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from evaluator import run as model
from pyspark.sql import functions as F
from tessera.errors import TesseraError
from tessera.functions import expr as e
from tessera.operators.query import query
from tessera.sources.tables import table


@pytest.fixture(scope="module")
def users(spark):
    return table("app/users", spark.createDataFrame([("u-1", "Ada", "core"), ("u-2", "Grace", "core"), ("u-3", "Alan", "research")], "id string, name string, team string"))


@pytest.fixture(scope="module")
def posts(spark):
    rows = [("p-1", "One", "u-1", 100, "news"), ("p-2", "Two", "u-1", 300, "news"), ("p-3", "Three", "u-2", 50, "blog"), ("p-4", "Orphan", "u-missing", 7, "blog")]
    return table("app/posts", spark.createDataFrame(rows, "id string, title string, author string, views long, tag string"))


def on(r):
    return e.eq(r.post.author, r.user.id)


def rows(q):
    return sorted((tuple(r) for r in q.run().collect()), key=str)


def pair(r):
    return {"title": r.post.title, "name": r.user.name}


@pytest.mark.parametrize(("kind", "n"), [("inner", 3), ("left", 4), ("right", 4), ("full", 5)])
def test_join_kinds(posts, users, kind, n):
    assert len(rows(query().from_(post=posts).join(on, kind, user=users).select(pair))) == n


def test_join_is_left_by_default(posts, users):
    assert rows(query().from_(post=posts).join(on, user=users).select(pair)) == rows(query().from_(post=posts).left_join(on, user=users).select(pair))


def test_equated_fields_read_as_one_on_either_side(posts, users):
    got = rows(query().from_(post=posts).full_join(on, user=users).select(lambda r: {"a": r.post.author, "u": r.user.id}))
    assert all(a == u for a, u in got) and {a for a, _ in got} == {"u-1", "u-2", "u-3", "u-missing"}


def test_condition_on_a_left_alias_decides_its_presence(posts, users):
    q = query().from_(post=posts).left_join(on, user=users).where(lambda r: e.eq(r.user.team, "research")).select(pair)
    assert [n for _, n in rows(q)] == [None] * 4


def test_inequality_on_a_left_alias_drops_rows(posts, users):
    q = query().from_(post=posts).left_join(on, user=users).where(lambda r: e.gt(r.user.name, "B")).select(pair)
    assert rows(q) == [("Three", "Grace")]


def test_anti_join_idiom(posts, users):
    q = query().from_(post=posts).left_join(on, user=users).where(lambda r: e.is_undefined(r.user.name)).select(lambda r: r.post.title)
    assert rows(q) == [("Orphan",)]


def test_self_join_and_three_aliases(posts, users):
    same_team = lambda r: e.eq(r.user.team, r.mate.team)
    q = query().from_(post=posts).inner_join(on, user=users).left_join(same_team, mate=users).select(lambda r: {"t": r.post.title, "m": r.mate.name})
    assert len(rows(q)) == 6


def test_full_join_of_three_binds_one_alias_per_extra_row(posts, users):
    q = query().from_(post=posts).inner_join(on, user=users).full_join(lambda r: e.eq(r.user.id, r.other.id), other=users).select(lambda r: {"t": r.post.title, "u": r.user.name, "o": r.other.name})
    got = rows(q)
    assert len(got) == 6 and ("Orphan", None, None) in got and (None, "Alan", None) in got and (None, None, "Alan") in got


def test_grouping_and_aggregates(posts):
    q = query().from_(p=posts).group_by(lambda r: r.p.author).select(lambda r: {"a": r.p.author, "n": e.count(), "v": e.sum_(r.p.views)})
    assert rows(q) == [("u-1", 2, 400), ("u-2", 1, 50), ("u-missing", 1, 7)]
    q = query().from_(p=posts).select(lambda r: {"n": e.count(), "s": e.sum_(r.p.views), "a": e.avg(r.p.views), "lo": e.min_(r.p.views), "hi": e.max_(r.p.views), "none": e.count(r.p.nothing), "zero": e.sum_(r.p.nothing)})
    assert rows(q) == [(4, 457, 114.25, 7, 300, 0, 0)]
    assert len(rows(query().from_(p=posts).group_by(lambda r: [r.p.author, r.p.tag]).select(lambda r: {"n": e.count()}))) == 3


def test_no_rows_make_no_group(posts):
    assert rows(query().from_(p=posts).where(lambda r: e.gt(r.p.views, 1000)).select(lambda r: {"n": e.count()})) == []


def test_having_order_and_paging(posts):
    grouped = query().from_(p=posts).group_by(lambda r: r.p.author).select(lambda r: {"a": r.p.author, "v": e.sum_(r.p.views)})
    assert rows(grouped.having(lambda r: e.gt(e.count(), 1))) == [("u-1", 400)]
    ordered = grouped.order_by(lambda r: e.sum_(r.p.views), "desc")
    assert [tuple(r) for r in ordered.limit(2).run().collect()] == [("u-1", 400), ("u-2", 50)]
    assert [tuple(r) for r in ordered.offset(1).limit(1).run().collect()] == [("u-2", 50)]


def test_distinct_sorts_by_unselected_fields(posts):
    q = query().from_(p=posts).select(lambda r: {"t": r.p.tag}).distinct().order_by(lambda r: r.p.views, "desc")
    assert Counter(r.t for r in q.run().collect()) == {"news": 1, "blog": 1}


def test_missing_sort_keys_come_last_both_ways(posts, users):
    q = query().from_(post=posts).left_join(on, user=users).select(lambda r: {"n": r.user.name})
    for way in ("asc", "desc"):
        assert q.order_by(lambda r: r.user.name, way).run().collect()[-1].n is None


def test_callbacks(posts):
    q = query().from_(p=posts).fn_where(lambda row: row.p["views"] % 2 == 0).select(lambda r: {"v": r.p.views}).fn_having(lambda row: row.v > 50).fn_select(lambda row: {"half": row.v / 2})
    assert rows(q) == [(150.0,), (50.0,)]


def test_whole_records(posts, users):
    got = query().from_(post=posts).left_join(on, user=users).where(lambda r: e.eq(r.post.id, "p-4")).run().collect()
    assert got[0].post.title == "Orphan" and got[0].user is None


def test_refusals(posts, users):
    with pytest.raises(TesseraError, match="twice"):
        query().from_(a=posts).from_(a=posts)
    with pytest.raises(TesseraError, match="group"):
        query().from_(a=posts).select(lambda r: r.a.id).order_by(lambda r: e.count()).run()
    with pytest.raises(TesseraError, match="aggregate"):
        query().from_(a=posts).select(lambda r: {"x": e.sum_(e.count())}).run()
    with pytest.raises(TesseraError, match="no condition"):
        query().from_(a=posts).where(lambda r: "x")
    with pytest.raises(TesseraError, match="source"):
        query().run()


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").alias("v"), F.lit("x").alias("w")).write.parquet(str(tmp_path / "t"))
    t = table("a/b", spark.read.parquet(str(tmp_path / "t")))
    df = query().from_(x=t).where(lambda r: e.gt(r.x.v, 97)).select(lambda r: {"v": r.x.v}).run()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,97)" in text and "ReadSchema: struct<v:bigint>" in text
    assert df.count() == 2
    joined = query().from_(x=t).inner_join(lambda r: e.eq(r.x.v, r.y.v), y=t).select(lambda r: {"v": r.x.v}).run()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def _random_tables(seed):
    rng = random.Random(seed)
    record = lambda i: {"id": str(i)} | {k: rng.randrange(3) for k in ("x", "y") if rng.random() < 0.7}
    return [record(i) for i in range(6)], [record(i) for i in range(6)]


@pytest.mark.parametrize("kind", ["inner", "left", "right", "full"])
def test_against_the_nested_loop_model(spark, kind):
    for seed in range(3):
        left, right = _random_tables(seed)
        schema = "id string, x long, y long"
        tables = [table(f"t/{n}", spark.createDataFrame([(r["id"], r.get("x"), r.get("y")) for r in data], schema)) for n, data in (("a", left), ("b", right))]
        for key in ("x", "id"):
            for extra in (None, "const", "gt_a", "gt_b"):
                q = query().from_(a=tables[0]).join(lambda r: e.eq(r.a[key], r.b[key]), kind, b=tables[1])
                if extra == "const":
                    q = q.where(lambda r: e.eq(r.b.y, 1))
                if extra == "gt_a":
                    q = q.where(lambda r: e.gt(r.a.y, 0))
                if extra == "gt_b":
                    q = q.where(lambda r: e.gt(r.b.y, 0))
                want = model([("a", left, "from"), ("b", right, kind)], list(q.conditions))
                shape = lambda r: tuple(tuple(sorted(r[s].items())) if r[s] else None for s in ("a", "b"))
                got = [{s: {k: v for k, v in row[s].asDict().items() if v is not None} if row[s] else None for s in ("a", "b")} for row in q.run().collect()]
                assert Counter(map(shape, got)) == Counter(map(shape, want)), (seed, key, extra)


@pytest.mark.parametrize("kinds", [("left", "left"), ("inner", "left"), ("left", "inner")])
def test_chains_against_the_nested_loop_model(spark, kinds):
    for seed in (5, 6):
        data = [*_random_tables(seed), _random_tables(seed + 100)[0]]
        tables = [table(f"t/{n}", spark.createDataFrame([(r["id"], r.get("x"), r.get("y")) for r in rows], "id string, x long, y long")) for n, rows in zip("abc", data, strict=True)]
        q = query().from_(a=tables[0]).join(lambda r: e.eq(r.a.x, r.b.x), kinds[0], b=tables[1]).join(lambda r: e.eq(r.b.y, r.c.y), kinds[1], c=tables[2])
        want = model([("a", data[0], "from"), ("b", data[1], kinds[0]), ("c", data[2], kinds[1])], list(q.conditions))
        shape = lambda r: tuple(r[s]["id"] if r[s] else None for s in "abc")
        got = q.run().collect()
        assert Counter(map(shape, got)) == Counter(map(shape, want)), seed
