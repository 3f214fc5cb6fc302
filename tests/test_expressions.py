"""Scalars and aggregates over missing, null and mixed values."""

from __future__ import annotations

from datetime import datetime

import pytest
from tessera.functions import expr as e
from tessera.operators.query import query
from tessera.sources.tables import table


@pytest.fixture(scope="module")
def bag(spark):
    rows = [
        ("1", 3, 2.5, "Hello World", ["a", "b"], datetime(2025, 1, 1), None, []),
        ("2", 0, 3.0, "", [], None, None, ["none"]),
        ("3", None, float("nan"), "a%b_c\\d", None, None, "x", []),
        ("4", 9, 1e21, "😀", ["z"], None, None, ["s2"]),
    ]
    return table("t/bag", spark.createDataFrame(rows, "id string, n long, f double, s string, arr array<string>, at timestamp, none string, _nulls array<string>"))


def one(bag, node, own="1"):
    got = query().from_(b=bag).select(lambda r: {"id": r.b.id, "v": node(r.b)}).run().where(f"id = '{own}'").collect()
    return got[0].v


CASES = [
    (lambda b: e.eq(b.n, 3.0), "1", True),
    (lambda b: e.eq(b.n, "3"), "1", False),
    (lambda b: e.eq(b.at, 1735689600000), "1", True),
    (lambda b: e.ne(b.n, 3), "1", False),
    (lambda b: e.eq(b.n, b.gone), "3", True),
    (lambda b: e.eq(b.none, None), "2", True),
    (lambda b: e.eq(b.none, None), "1", False),
    (lambda b: e.is_null(b.none), "2", True),
    (lambda b: e.is_undefined(b.none), "2", False),
    (lambda b: e.is_undefined(b.none), "1", True),
    (lambda b: e.gte(b.n, 3), "3", False),
    (lambda b: e.lte(b.f, 1), "3", False),
    (lambda b: e.gt(b.f, 1), "3", False),
    (lambda b: e.and_(b.n, b.s), "1", True),
    (lambda b: e.and_(b.n, b.s), "2", False),
    (lambda b: e.or_(b.n, b.arr), "2", True),
    (lambda b: e.not_(b.f), "3", True),
    (lambda b: e.not_(e.starts_with(b.none, "a")), "1", True),
    (lambda b: e.in_array("a", b.arr), "1", True),
    (lambda b: e.in_array(b.n, [1, 3]), "1", True),
    (lambda b: e.in_array(b.n, ["3"]), "1", False),
    (lambda b: e.in_array("a", b.s), "1", False),
    (lambda b: e.like(b.s, "Hello%"), "1", True),
    (lambda b: e.like(b.s, "hello%"), "1", False),
    (lambda b: e.ilike(b.s, "hello_world"), "1", True),
    (lambda b: e.like(b.s, "%\\d"), "3", True),
    (lambda b: e.ends_with(b.s, "World"), "1", True),
    (lambda b: e.length(b.s), "1", 11),
    (lambda b: e.length(b.s), "4", 2),
    (lambda b: e.length(b.arr), "1", 2),
    (lambda b: e.length(b.arr), "3", None),
    (lambda b: e.length(b.n), "1", None),
    (lambda b: e.upper(b.s), "1", "HELLO WORLD"),
    (lambda b: e.upper(b.n), "1", 3),
    (lambda b: e.concat(b.s, "-", b.n), "1", "Hello World-3"),
    (lambda b: e.concat(b.f, ""), "2", "3"),
    (lambda b: e.concat(b.f, ""), "1", "2.5"),
    (lambda b: e.concat(b.f, ""), "4", "1e+21"),
    (lambda b: e.concat(b.s, b.none), "1", None),
    (lambda b: e.add(b.n, 1), "1", 4),
    (lambda b: e.add(b.n, "x"), "1", "3x"),
    (lambda b: e.subtract(b.n, b.f), "1", 0.5),
    (lambda b: e.multiply(b.n, b.none), "1", None),
    (lambda b: e.divide(b.n, 2), "1", 1.5),
    (lambda b: e.divide(b.n, 0), "1", None),
    (lambda b: e.coalesce(b.none, b.s), "1", "Hello World"),
    (lambda b: e.case_when(e.gt(b.n, 1), "many", "few"), "2", "few"),
    (lambda b: e.case_when(e.gt(b.n, 1), "many"), "2", None),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scalar(bag, i):
    node, own, want = CASES[i]
    assert one(bag, node, own) == want


def test_conditions_require_their_fields(bag):
    ids = lambda c: sorted(r.value for r in query().from_(b=bag).where(c).select(lambda r: r.b.id).run().collect())
    assert ids(lambda r: e.or_(e.eq(r.b.id, "3"), e.gt(r.b.n, 100))) == []
    assert ids(lambda r: e.not_(e.gt(r.b.n, 100))) == ["1", "2", "4"]
    assert ids(lambda r: e.is_undefined(r.b.n)) == ["3"]
    assert ids(lambda r: e.is_null(r.b.none)) == ["2"]


def test_long_overflow_is_missing(bag):
    assert one(bag, lambda b: e.add(b.n, 9223372036854775807)) is None


def test_explicit_nulls_group_and_count_as_nothing(bag):
    got = query().from_(b=bag).group_by(lambda r: r.b.none).select(lambda r: {"k": r.b.none, "n": e.count(), "c": e.count(r.b.none)}).run().collect()
    assert sorted((r.k or "", r.n, r.c) for r in got) == [("", 1, 0), ("x", 1, 1)]
