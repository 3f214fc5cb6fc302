"""The pattern engine over posts and users."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from tessera.errors import TesseraError
from tessera.plans.patterns import Engine
from tessera.sources.index import TupleIndex
from tessera.sources.tables import table


@pytest.fixture(scope="module")
def engine(spark):
    users = table("app/users", spark.createDataFrame([("1", "Ada"), ("2", "Grace")], "id string, name string"))
    posts = table("app/posts", spark.createDataFrame([("1", "1", "First", 150), ("2", "2", "Second", 10), ("3", None, "Lone", None)], "id string, author string, title string, views long"))
    things = table("app/things", spark.createDataFrame([("5", "5", 1, 3), ("6", "7", 2, 4)], "id string, selfref string, c0 long, castaway long").withColumnRenamed("c0", "cast.0"))
    return Engine([users, posts, things])


def found(engine, find, where):
    return sorted((tuple(r) for r in engine.query(find, where).collect()), key=str)


TITLE = ("app/posts/?p", "title", "?t")


def test_shared_variables_join(engine):
    where = [("app/posts/?p", "author", "?u"), ("app/users/?u", "name", "?n"), TITLE, ("app/posts/?p", "views", "?v"), "?v > 100"]
    assert found(engine, ["?t", "?n"], where) == [("First", "Ada")]


def test_optional_parts(engine):
    assert found(engine, ["?t", "?a"], [TITLE, {"opt": ("app/posts/?p", "author", "?a")}]) == [("First", "1"), ("Lone", None), ("Second", "2")]
    group = {"opt_all": [("app/posts/?p", "author", "?a"), ("app/users/?a", "name", "?n"), '?n != "Ada"']}
    assert found(engine, ["?t", "?n"], [TITLE, group]) == [("First", None), ("Lone", None), ("Second", "Grace")]


def test_an_unbound_variable_matches_anything_later(engine):
    where = [TITLE, {"opt": ("app/posts/?p", "author", "?u")}, ("app/users/?u", "name", "?n")]
    assert found(engine, ["?t", "?n"], where) == [("First", "Ada"), ("Lone", "Ada"), ("Lone", "Grace"), ("Second", "Grace")]


def test_repeated_variables_agree(engine):
    assert found(engine, ["?x"], [("app/things/?x", "selfref", "?x")]) == [("5",)]


def test_variable_attributes_paths_and_prefixes(engine):
    assert found(engine, ["?a", "?v"], [("app/posts/1", "?a", "?v")]) == [("_id", "1"), ("author", "1"), ("title", "First"), ("views", "150")]
    assert found(engine, ["?p"], [("?p", "?a", "Ada")]) == [("app/users/1",)]
    assert found(engine, ["?x"], [("app/things/?x", "cast.*", "?v")]) == [("5",), ("6",)]
    assert found(engine, ["?x"], [("app/things/?x", "?k", "?v"), "?v >= 4"]) == [("6",)]


def test_constants(engine):
    assert found(engine, ["?t"], [("app/posts/?p", "views", 150), TITLE]) == [("First",)]
    assert found(engine, ["?t"], [("app/posts/?p", "views", "150"), TITLE]) == []
    assert found(engine, ["?t"], [("app/posts/2", "title", "?t")]) == [("Second",)]
    assert found(engine, ["?t"], [("app/posts/?p", "nothing", "?z"), TITLE]) == []


def test_callable_predicates(engine):
    assert found(engine, ["?t"], [TITLE, lambda v: F.length(v["?t"]) == 4]) == [("Lone",)]


def test_one_scan_for_a_star(engine):
    df = engine.query(["?t", "?v"], [TITLE, ("app/posts/?p", "views", "?v")])
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def test_errors(engine):
    for where in ([TITLE, "?nope > 1"], [TITLE, "?t ~ 1"], [TITLE, "?t == one"], [("app/none/?x", "a", "?v")], [TITLE, 3]):
        with pytest.raises(TesseraError):
            engine.query(["?t"], where)
    with pytest.raises(Exception, match="not bound"):
        engine.query(["?t"], [TITLE, {"opt": ("app/posts/?p", "views", "?w")}, "?w > 3"]).collect()


def test_index_reads(engine):
    index = TupleIndex(engine.tables.values())
    pairs = lambda df: sorted((r.path, r.attr, r.text) for r in df.collect())
    assert pairs(index.get("app/users/1", "name")) == [("app/users/1", "name", "Ada")]
    assert len(pairs(index.attrs("app/posts/3"))) == 2 and index.has("app/posts/3") and not index.has("app/posts/9")
    assert [p for p, _, _ in pairs(index.by_schema_attr("app/posts", "views"))] == ["app/posts/1", "app/posts/2"]
    assert pairs(index.by_schema_attr("app/posts", "nothing")) == []
    assert pairs(index.by_value(150)) == [("app/posts/1", "views", "150")]
    assert index.by_schema("app/users").count() == 4 and index.scan("app/users/1").count() == 2
    assert index.scan("app").count() == index.all().count() == 4 + 10 + 8
    assert [r.path for r in index.paths("app/users").orderBy("path").collect()] == ["app/users/1", "app/users/2"]
    assert index.paths("app").count() == 7 and index.paths("app/users/2").count() == 1
    with pytest.raises(TesseraError):
        index.scan("none")
