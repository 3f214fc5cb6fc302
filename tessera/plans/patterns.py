"""The pattern language: conjunctive queries over tuples with shared variables and optional parts.

A pattern is ``(path, attr, value)``; a string that begins with ``?`` is a variable. A path is
``ns/schema/id``, ``ns/schema/?v`` (binds the id) or ``?v`` (binds the whole path). ``{"opt": pattern}``
keeps rows without a match, ``{"opt_all": [patterns]}`` a group that matches as a whole or not at all.
Strings are predicates like ``'?views > 100'``; callables get the variables' columns and give a column, and
``in_python`` wraps one that gets values. Optional groups may hold optional patterns.

Patterns on one path and constant attributes are read as one scan of the wide record table. Variable or
prefix attributes and bare path variables read the tuple view. A variable that an optional part may have
left unbound matches anything later: rows with and without it are joined apart, each by hash.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.errors import TesseraError
from tessera.functions.callback import Callback
from tessera.functions.expr import Expr, Field
from tessera.plans.columns import Val, comparable, condition, equal, literal
from tessera.sources.tables import RecordTable, key_text, tuples
from tessera.values import NULL, NUMBER, TEXT

_OPS = {"==": "eq", "!=": "ne", "<=": "lte", ">=": "gte", "<": "lt", ">": "gt"}  # the longer ones first


def split_predicate(text: str) -> tuple[str, str, str]:
    """A predicate's variable, operator and right side: ``?name op literal`` or ``?name op ?name``."""
    rest = text.strip()
    name = "?" + "".join(itertools.takewhile(lambda c: c.isalnum() or c in "_.", rest[1:]))
    tail = rest[len(name) :].lstrip()
    op = next((o for o in _OPS if tail.startswith(o)), "")
    other = tail[len(op) :].strip()
    if not rest.startswith("?") or len(name) < 2 or not op or not other:
        raise TesseraError("INVALID_QUERY", f"no predicate: {text}")
    return name, op, other


def is_variable(x: Any) -> bool:
    return isinstance(x, str) and x.startswith("?") and len(x) > 1


@dataclass(frozen=True)
class Var:
    """How a variable is held: its type, and whether every row has it."""

    kind: T.DataType
    always: bool
    mixed: bool = False  # text of values whose types differ, with a key column beside it


@dataclass
class Bindings:
    """Rows of variable bindings."""

    df: DataFrame | None
    vars: dict[str, Var]


def _c(v: str) -> str:
    return "v" + v


def _k(v: str) -> str:
    return "k" + v


def _key(v: str, var: Var) -> Column:
    return F.col(f"`{_k(v)}`") if var.mixed else key_text(F.col(f"`{_c(v)}`"), var.kind)


class Engine:
    """Runs pattern queries over record tables."""

    def __init__(self, tables: Iterable[RecordTable]):
        self.tables = {t.path: t for t in tables}

    # --- scans ---------------------------------------------------------------------------------

    def _path(self, path: str) -> tuple[RecordTable | None, str | None, str | None]:
        """Table, constant id and id variable of a path slot; no table for a bare variable."""
        if is_variable(path):
            return None, None, path
        parts = path.split("/", 2)
        if len(parts) != 3 or is_variable(parts[0]) or is_variable(parts[1]):
            raise TesseraError("INVALID_QUERY", f"no record path: {path}")
        table = self.tables.get("/".join(parts[:2]))
        if table is None:
            raise TesseraError("INVALID_QUERY", f"no table for {path}")
        return (table, None, parts[2]) if is_variable(parts[2]) else (table, parts[2], None)

    def _star(self, patterns: list[tuple], optional: list[tuple]) -> Bindings:
        """Patterns on one path with constant attributes, as one scan."""
        table, own_id, id_var = self._path(patterns[0][0])
        out: dict[str, Val] = {}
        tests: list[Column] = []
        if own_id is not None:
            tests.append(table.id() == own_id)
        if id_var:
            out[id_var] = Val(table.id(), T.StringType())
        for _, attr, value in patterns:
            kind = table.kind(attr)
            if kind is None:
                tests.append(F.lit(False))
                if is_variable(value) and value not in out:
                    out[value] = Val(F.lit(None).cast("string"), T.StringType())
                continue
            v = Val(table.value(attr), kind, table.null(attr), table.mixed(attr))
            tests.append(~v.is_missing())
            if not is_variable(value):
                tests.append(equal(v, literal(value)) if value is None or table.has_nulls else _equal_filter(v, literal(value)))
            elif value in out:
                tests.append(equal(out[value], v))
            else:
                out[value] = v
        names = dict.fromkeys(out, True)
        for _, attr, value in optional:
            kind = table.kind(attr) or T.StringType()
            known = table.kind(attr) is not None
            out[value] = Val(table.value(attr) if known else F.lit(None).cast("string"), kind, key=table.mixed(attr) if known else None)
            names[value] = False
        df = table.df
        if tests:
            df = df.where(reduce(lambda a, b: a & b, tests))
        keys = {n: v for n, v in out.items() if v.key is not None}
        df = df.select(*[v.col.alias(_c(n)) for n, v in out.items()], *[v.as_key().alias(_k(n)) for n, v in keys.items()])
        return Bindings(df, {n: Var(v.kind, names[n], n in keys) for n, v in out.items()})

    def _scan(self, pattern: tuple) -> Bindings:
        """One pattern over the tuple view."""
        path, attr, value = pattern
        table, own_id, id_var = self._path(path)
        view = tuples(table) if table is not None else reduce(DataFrame.unionByName, [tuples(t) for t in self.tables.values()])
        bound: list[tuple[str, Column, Column | None]] = []
        if own_id is not None:
            view = view.where(F.col("id") == own_id)
        elif id_var:
            bound.append((id_var, F.col("id") if table is not None else F.col("path"), None))
        if is_variable(attr):
            bound.append((attr, F.col("attr"), None))
        elif attr.endswith(".*"):
            view = view.where(F.startswith("attr", F.lit(attr[:-1])))
        else:
            view = view.where(F.col("attr") == attr)
        if is_variable(value):
            bound.append((value, F.col("text"), F.col("key")))
        else:
            lit = literal(value)
            view = view.where(F.col("key") == (F.lit(NULL) if value is None else key_text(lit.col, lit.kind)))
        out: dict[str, tuple[Column, Column | None]] = {}
        for name, col, key in bound:
            if name in out:  # a repeated variable must agree
                as_key = lambda c, k: F.concat(F.lit(TEXT), c) if k is None else k
                view = view.where(as_key(*out[name]) == as_key(col, key))
            else:
                out[name] = (col, key)
        cols = [c.alias(_c(n)) for n, (c, _) in out.items()] + [k.alias(_k(n)) for n, (_, k) in out.items() if k is not None]
        if not cols:
            cols = [F.lit(1).alias("one")]
        return Bindings(view.select(*cols), {n: Var(T.StringType(), True, k is not None) for n, (_, k) in out.items()})

    # --- joins ---------------------------------------------------------------------------------

    def _join(self, left: Bindings, right: Bindings, how: str) -> Bindings:
        if left.df is None:
            if how == "inner":
                return right
            left = Bindings(right.df.sparkSession.range(1).select(F.lit(1).alias("one0")), {})
        shared = [v for v in right.vars if v in left.vars]
        unsure = [v for v in shared if not left.vars[v].always or not right.vars[v].always]
        vars_ = dict(left.vars)
        for v, var in right.vars.items():
            own = left.vars.get(v)
            if own is None:
                vars_[v] = Var(var.kind, var.always and how == "inner", var.mixed)
            else:
                # a variable that may be unbound on the left takes the right side's form: one form for both
                mixed = own.mixed or (not own.always and var.mixed) or (not own.always and own.kind != var.kind)
                vars_[v] = Var(T.StringType() if mixed else own.kind, own.always or (var.always and how == "inner"), mixed)
        if not unsure:
            return Bindings(self._hash_join(left.df, right.df, left.vars, right.vars, shared, vars_, how), vars_)
        # rows that have the variable join on it, rows that do not take it from the other side
        parts = []
        v = unsure[0]
        if not left.vars[v].always:
            have, lack = left.df.where(F.col(f"`{_c(v)}`").isNotNull()), left.df.where(F.col(f"`{_c(v)}`").isNull())
            sure = Bindings(have, left.vars | {v: Var(left.vars[v].kind, True, left.vars[v].mixed)})
            free = Bindings(lack.drop(_c(v), _k(v)), {k: x for k, x in left.vars.items() if k != v})
            parts = [self._join(sure, right, how), self._join(free, right, how)]
        else:
            have, lack = right.df.where(F.col(f"`{_c(v)}`").isNotNull()), right.df.where(F.col(f"`{_c(v)}`").isNull())
            sure = Bindings(have, right.vars | {v: Var(right.vars[v].kind, True, right.vars[v].mixed)})
            free = Bindings(lack.drop(_c(v), _k(v)), {k: x for k, x in right.vars.items() if k != v})
            parts = [self._join(left, sure, "inner"), self._join(left, free, "inner")]
            if how == "left":  # what neither form of the group matches stays as it is
                parts.append(Bindings(self._unmatched(left, right), left.vars))
        return Bindings(parts[0].df if len(parts) == 1 else _union(parts, vars_), vars_)

    def _unmatched(self, left: Bindings, right: Bindings) -> DataFrame:
        """Rows of the left side that no row of the right side is compatible with."""
        shared = [v for v in right.vars if v in left.vars]
        unsure = [v for v in shared if not left.vars[v].always or not right.vars[v].always]
        if not unsure:
            return self._hash_join(left.df, right.df, left.vars, right.vars, shared, {}, "left_anti")
        v = unsure[0]
        if not right.vars[v].always:
            known = F.col(f"`{_c(v)}`").isNotNull()
            sure = Bindings(right.df.where(known), right.vars | {v: Var(right.vars[v].kind, True, right.vars[v].mixed)})
            free = Bindings(right.df.where(~known).drop(_c(v), _k(v)), {k: x for k, x in right.vars.items() if k != v})
            return self._unmatched(Bindings(self._unmatched(left, sure), left.vars), free)
        known = F.col(f"`{_c(v)}`").isNotNull()
        bound = Bindings(left.df.where(known), left.vars | {v: Var(left.vars[v].kind, True, left.vars[v].mixed)})
        open_ = self._unmatched(Bindings(left.df.where(~known), {k: x for k, x in left.vars.items() if k != v}), right)
        return self._unmatched(bound, right).unionByName(open_)

    def _hash_join(self, left: DataFrame, right: DataFrame, lv: dict[str, Var], rv: dict[str, Var], shared: list[str], out: dict[str, Var], how: str) -> DataFrame:
        on = []
        renamed = right
        for v in shared:
            for name in (_c(v), _k(v)):
                if name in right.columns:
                    renamed = renamed.withColumnRenamed(name, "r" + name)
            a, b = lv[v], rv[v]
            if a.mixed or b.mixed:
                mine = _key(v, a)
                other = F.col(f"`r{_k(v)}`") if b.mixed else key_text(F.col(f"`r{_c(v)}`"), b.kind)
                on.append(mine == other)
            else:
                x, y = Val(F.col(f"`{_c(v)}`"), a.kind), Val(F.col(f"`r{_c(v)}`"), b.kind)
                on.append(_equal_filter(x, y))
        for extra in [c for c in renamed.columns if c in left.columns]:
            renamed = renamed.drop(extra)
        if on:
            joined = left.join(renamed, reduce(lambda a, b: a & b, on), how)
        else:
            joined = left.crossJoin(renamed) if how == "inner" else left.join(renamed, F.lit(True), how)
        return joined.select(*[c for c in joined.columns if not c.startswith(("rv?", "rk?"))])

    # --- queries -------------------------------------------------------------------------------

    def contexts(self, where: list[Any]) -> Bindings:
        """All bindings that fulfil the clauses."""
        out = Bindings(None, {})
        todo = list(where)
        while todo:
            clause = todo.pop(0)
            if isinstance(clause, (tuple, list)):
                star, optional = [tuple(clause)], []
                if _constant(clause):
                    # patterns of the same path up to the next optional part belong to one scan
                    for other in list(todo):
                        if isinstance(other, dict):
                            break
                        if isinstance(other, (tuple, list)) and other[0] == clause[0] and _constant(other):
                            star.append(tuple(other))
                            todo.remove(other)
                    taken = set(out.vars) | {x for p in star for x in _variables(p)}
                    for other in list(todo):  # and so do lone optional reads of fresh variables
                        if not isinstance(other, dict):
                            break
                        p = other.get("opt")
                        if p is None or p[0] != clause[0] or not _constant(p) or not is_variable(p[2]) or p[2] in taken:
                            break
                        optional.append(tuple(p))
                        taken.add(p[2])
                        todo.remove(other)
                    found = self._star(star, optional)
                else:
                    found = self._scan(tuple(clause))
                out = self._join(out, found, "inner")
            elif isinstance(clause, dict):
                group = clause["opt_all"] if "opt_all" in clause else [clause["opt"]]
                inner = self.contexts(list(group))
                out = self._join(out, inner, "left")
            elif isinstance(clause, str):
                out = self._predicate(out, clause)
            elif isinstance(clause, Callback):
                out = Bindings(out.df.where(clause.column({v[1:]: F.col(f"`{_c(v)}`") for v in out.vars})), out.vars)
            elif callable(clause):
                cols = {v: F.col(f"`{_c(v)}`") for v in out.vars}
                out = Bindings(out.df.where(clause(cols)), out.vars)
            else:
                raise TesseraError("INVALID_QUERY", f"no clause: {clause!r}")
        return out

    def _predicate(self, b: Bindings, text: str) -> Bindings:
        name, op, other = split_predicate(text)
        vals = []
        for x in (name, other):
            if is_variable(x):
                if x not in b.vars:
                    raise TesseraError("INVALID_QUERY", f"{x} is not bound where {text!r} reads it")
                var = b.vars[x]
                col = F.col(f"`{_c(x)}`")
                if not var.always:  # an error only if a row without it gets here
                    col = F.when(col.isNull(), F.raise_error(F.lit(f"INVALID_QUERY: {x} is not bound")).cast(var.kind)).otherwise(col)
                vals.append((Val(col, var.kind), var))
            else:
                try:
                    vals.append((literal(json.loads(other)), None))
                except ValueError:
                    raise TesseraError("INVALID_QUERY", f"{other} is no JSON literal") from None
        (a, va), (c, vc) = vals
        if va is not None and va.mixed:  # text of many types: compare as the other side's type
            a = _as(a, c, name)
        if vc is not None and vc.mixed:
            c = _as(c, a, other)
        env = {0: a, 1: c}
        test = ~equal(a, c) if op == "!=" else condition(Expr(_OPS[op], (_Slot(0), _Slot(1))), lambda n: env[n.i])
        return Bindings(b.df.where(test), b.vars)

    def query(self, find: list[str], where: list[Any]) -> DataFrame:
        """One row per binding, with a column per found variable (named without its ``?``)."""
        b = self.contexts(where)
        return b.df.select(*[(F.col(f"`{_c(v)}`") if v in b.vars else F.lit(None).cast("string")).alias(v[1:]) for v in find])


class _Slot(Field):
    """A side of a predicate."""

    def __init__(self, i: int):
        object.__setattr__(self, "alias", "")
        object.__setattr__(self, "name", str(i))
        object.__setattr__(self, "i", i)


def _as(a: Val, like: Val, name: str) -> Val:
    """Text of a value of unknown type as another value's type; what is of another type compares with nothing."""
    if like.family == "number":
        key = F.col(f"`{_k(name)}`")
        return Val(F.when(F.startswith(key, F.lit(NUMBER)), a.col.try_cast("double")), T.DoubleType())
    if like.family == "boolean":
        return Val(a.col.try_cast("boolean"), T.BooleanType())
    if like.family == "time":
        return Val(a.col.try_cast("timestamp"), T.TimestampType())
    return a


def _equal_filter(a: Val, b: Val) -> Column:
    pair = comparable(a, b)
    return F.lit(False) if pair is None else pair[0] == pair[1]


def _union(parts: list[Bindings], vars_: dict[str, Var]) -> DataFrame:
    """Parts of one result, brought to one form per variable."""
    frames = []
    for p in parts:
        cols = []
        for v, var in vars_.items():
            own = p.vars.get(v)
            if own is None:
                cols.append(F.lit(None).cast(var.kind).alias(_c(v)))
                if var.mixed:
                    cols.append(F.lit(None).cast("string").alias(_k(v)))
            else:
                cols.append(F.col(f"`{_c(v)}`").cast(var.kind).alias(_c(v)))
                if var.mixed:
                    cols.append(_key(v, own).alias(_k(v)))
        frames.append(p.df.select(*cols))
    return reduce(DataFrame.unionByName, frames)


def _constant(pattern: Any) -> bool:
    path, attr, _ = pattern
    return not is_variable(path) and not is_variable(attr) and not attr.endswith(".*")


def _variables(pattern: tuple) -> list[str]:
    tail = pattern[0].split("/", 2)[-1]
    return [x for x in (tail, pattern[1], pattern[2]) if is_variable(x)]

