"""Values, records, URIs, definitions."""

from __future__ import annotations

import math
from datetime import UTC, datetime

import pytest
from pyspark.sql import types as T
from tessera.catalog import Def, FieldDef, def_of, enforce
from tessera.errors import TesseraError
from tessera.record import attributes, get_in, item
from tessera.uri import in_scope, parse
from tessera.values import MISSING, coerce, from_text, infer, key, same, to_text

AT = datetime(2025, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize(("value", "kind"), [("a", "string"), (1, "integer"), (3.0, "integer"), (1.5, "float"), (math.nan, "float"), (True, "boolean"), (AT, "time"), (b"x", "bytes"), ([1], "array"), ({"a": 1}, "json")])
def test_inference(value, kind):
    assert infer(value) == kind


def test_null_has_no_type():
    with pytest.raises(TesseraError):
        infer(None)


def test_equality():
    assert same(3, 3.0) and same(-0.0, 0) and same(math.nan, math.nan) and same(AT, 1735689600000) and same(None, None)
    assert same({"a": 1, "b": 2}, {"b": 2.0, "a": 1.0}) is False or key({"a": 1, "b": 2}) == key({"b": 2, "a": 1})
    assert not same("1", 1) and not same(None, MISSING) and not same(["x,s:y", "z"], ["x", "y,s:z"])


@pytest.mark.parametrize(("value", "kind", "want"), [("7", "integer", 7), (" +7 ", "integer", 7), (2.0, "integer", 2), ("1.5", "float", 1.5), (0, "time", datetime(1970, 1, 1, tzinfo=UTC)), ("2025-01-01", "time", AT), (["1"], "array", ["1"]), (None, "string", None)])
def test_coercion(value, kind, want):
    assert coerce(value, kind) == want


@pytest.mark.parametrize(("value", "kind"), [(1, "string"), ("x", "integer"), (1.5, "integer"), (-1, "unsigned"), (1, "boolean"), ("x", "float"), ("x", "time"), ("x", "bytes"), (AT, "json"), ("x", "array")])
def test_refused_coercion(value, kind):
    with pytest.raises(TesseraError) as e:
        coerce(value, kind)
    assert e.value.code == "SCHEMA_VIOLATION"


@pytest.mark.parametrize("value", ["a", 1, 1.5, True, AT, b"\x00\xff", [1, "a", None], {"a": [1]}, None])
def test_storage_round_trip(value):
    assert from_text(*to_text(value)) == value


def test_records_fold_and_unfold():
    own = {"id": "1", "title": "x", "meta": {"deep": {"x": 1}}, "tags": [1, 2]}
    assert attributes(own) == {"title": "x", "meta.deep.x": 1, "tags": [1, 2]}
    assert item({"_id": "1", "_version": 2, **attributes(own)}) == own
    assert get_in(own, "meta.deep.x") == 1 and get_in(own, "meta.none") is MISSING


def test_uris():
    u = parse("tessera://app/posts/p-1#title")
    assert (u.ns, u.schema, u.id, u.attr, u.path) == ("app", "posts", "p-1", "title", "app/posts/p-1")
    assert parse("app/posts").path == "app/posts"
    assert in_scope("app/posts/1", "app/posts") and not in_scope("app/postscript/1", "app/posts")
    for bad in ("", "a/b/c/d", "a b", "app/posts#x", "app//x", "app/posts/1#"):
        with pytest.raises(TesseraError):
            parse(bad)


def test_definitions():
    struct = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType(), False), T.StructField("meta", T.StructType([T.StructField("n", T.LongType(), False)]))])
    made = def_of("app/posts", struct)
    assert made.mode == "strict" and made.fields == {"title": FieldDef("string", None, True), "meta.n": FieldDef("integer", None, False)}
    assert Def.from_json(made.to_json()) == made and [f.name for f in made.struct()] == ["id", "title", "meta.n"]
    with pytest.raises(TesseraError):
        enforce(made, {"title": "x", "extra": 1}, whole=True, path="app/posts/1")
    with pytest.raises(TesseraError):
        enforce(made, {}, whole=True, path="app/posts/1")
    flexible = Def("app", "posts", "flexible", made.fields)
    assert enforce(flexible, {"title": "x", "extra": 1}, whole=True, path="p")[0]["extra"] == 1
    grown = enforce(Def("app", "events"), {"kind": "x", "n": None}, whole=True, path="p")[1]
    assert grown.fields == {"kind": FieldDef("string")}
