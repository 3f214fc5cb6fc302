"""From a query of the builder to a DataFrame.

Conditions are sorted into equalities between fields (join keys, closed under transitivity), conditions
on one alias, and the rest. Where they go depends on how the alias joins: an inner alias is filtered
before its join; so is a left one, since its conditions decide whether it is present at all; right and
full joins have every condition in their ON. Fields that were equated read as one value, whichever side
of an outer join is present.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.errors import TesseraError
from tessera.functions.callback import Callback
from tessera.functions.expr import Aggregate, Expr, Field, aggregates, children, fields, required_fields
from tessera.operators.query import Query, Source, table_of
from tessera.plans.columns import Val, aggregate, aggregate_type, column, comparable, condition, equal
from tessera.sources.tables import KEYS_OF_MIXED, NULLS, RecordTable

SEP = "␟"


def _name(f: Field) -> str:
    return f"{f.alias}{SEP}{'id' if f.name == '_id' else f.name}"


def _present(alias: str) -> str:
    return f"{alias}{SEP}{SEP}here"


class _Aliases:
    """Tables, columns and equated fields of a query's aliases."""

    def __init__(self, q: Query):
        self.q = q
        self.tables: dict[str, RecordTable] = {s.alias: table_of(s.table) for s in q.sources}
        self.parent: dict[Field, Field] = {}
        self.rest: list[Any] = []
        for c in q.conditions:
            if isinstance(c, Expr) and c.op == "eq" and all(isinstance(a, Field) for a in c.args):
                a, b = self.find(self.plain(c.args[0])), self.find(self.plain(c.args[1]))
                if a != b:
                    self.parent[b] = a
            else:
                self.rest.append(c)

    def plain(self, f: Field) -> Field:
        if f.alias not in self.tables:
            raise TesseraError("INVALID_QUERY", f"the query has no alias {f.alias}")
        return Field(f.alias, "id") if f.name == "_id" else f

    def find(self, f: Field) -> Field:
        while f in self.parent:
            f = self.parent[f]
        return f

    def classes(self) -> list[list[Field]]:
        out: dict[Field, list[Field]] = {}
        for f in sorted({*self.parent, *self.parent.values()}, key=lambda f: (f.alias, f.name)):
            out.setdefault(self.find(f), []).append(f)
        return list(out.values())

    def own(self, f: Field) -> Val:
        """A field's own column, whatever it was equated with."""
        f = self.plain(f)
        t = self.tables[f.alias]
        kind = t.kind(f.name)
        if kind is None:
            return Val(F.lit(None), T.NullType())
        null = None
        if t.has_nulls and f.name != "id":
            null = F.coalesce(F.array_contains(F.col(f"`{f.alias}{SEP}{NULLS}`"), f.name), F.lit(False))
        key = t.mixed(f.name, F.col(f"`{f.alias}{SEP}{KEYS_OF_MIXED}`")) if t.has_keys else None
        return Val(F.col(f"`{_name(f)}`"), kind, null, key)

    def unified(self, f: Field) -> Val:
        """A field's value: that of any field it was equated with, if its own alias is absent."""
        f = self.plain(f)
        own = self.own(f)
        root = self.find(f)
        mates = [m for c in self.classes() if self.find(c[0]) == root for m in c if m != f]
        mates = [self.own(m) for m in mates if comparable(own, self.own(m)) and self.own(m).family == own.family]
        if not mates:
            return own
        keys = [m.as_key() for m in (own, *mates)] if any(m.key is not None for m in (own, *mates)) else None
        return Val(F.coalesce(own.col, *[m.col for m in mates]), own.kind, own.null, F.coalesce(*keys) if keys else None)


def _needed(q: Query, aliases: _Aliases) -> dict[str, set[str]]:
    """The fields of each alias that the plan reads."""
    refs = q.refs()
    templates: list[Any] = [*q.conditions, *[h(refs) for h in q.having_], *[k(refs) for k, _ in q.orders]]
    if q.projection:
        templates.append(q.projection(refs))
    if q.keys:
        templates.append(q.keys(refs))
    whole = q.projection is None or bool(q.fn_wheres)
    out: dict[str, set[str]] = {a: set(t.columns) | {"id"} if whole else set() for a, t in aliases.tables.items()}
    for f in fields(templates):
        f = aliases.plain(f)
        out[f.alias].add(f.name)
    return out


def footprint(q: Query) -> set[tuple[str, str]]:
    aliases = _Aliases(q)
    whole = q.projection is None or bool(q.fn_wheres)
    out: set[tuple[str, str]] = set()
    for alias, names in _needed(q, aliases).items():
        path = aliases.tables[alias].path
        out |= {(path, "*")} if whole else {(path, "_id")} | {(path, "_id" if n == "id" else n) for n in names}
    return out


def _both(conditions: Iterable[Column]) -> Column | None:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _joined_on(a: Val, b: Val) -> Column:
    """Equality of two present values, as a join key."""
    pair = comparable(a, b)
    if pair is None:
        return F.lit(False)
    if a.null is not None and b.null is not None:  # explicit nulls equal each other
        return F.struct(a.null.alias("n"), pair[0].alias("v")) == F.struct(b.null.alias("n"), pair[1].alias("v"))
    return pair[0] == pair[1]


class _Plan:
    def __init__(self, q: Query):
        if not q.sources:
            raise TesseraError("INVALID_QUERY", "a query needs a source")
        self.q, self.a = q, _Aliases(q)
        self.needed = _needed(q, self.a)
        refs = q.refs()
        templates = [q.projection(refs) if q.projection else None, *[h(refs) for h in q.having_]]
        #: The first alias, if its ids tell rows apart that the sort keys do not.
        self.ties: list[str] = []
        if q.orders and q.keys is None and not q.distinct_ and not any(True for _ in aggregates(templates)):
            first = q.sources[0].alias
            sorted_by = {f.name for f in (k(refs) for k, _ in q.orders) if isinstance(f, Field) and f.alias == first}
            own = self.a.tables[first]
            told = sorted_by & {"id", "_id"} or (own.key_names and set(own.key_names) <= sorted_by)
            if not own.keyless and not told:
                self.ties = [first]
                self.needed[first].add("id")
        required = {self.a.plain(f) for c in q.conditions for f in required_fields(c)}
        if q.keys:
            required |= {self.a.plain(f) for f in fields(q.keys(refs))}
        self.required = required
        # conditions of the form field = constant, or on one alias only through equality
        self.gates: dict[str, list[Expr]] = {s.alias: [] for s in q.sources}
        self.predicates: list[Any] = []
        for c in self.a.rest:
            constant = isinstance(c, Expr) and c.op == "eq" and sum(isinstance(x, Field) for x in c.args) == 1 and not any(isinstance(x, (Expr, Aggregate)) for x in c.args)
            if constant:
                own = next(x for x in c.args if isinstance(x, Field))
                self.gates[own.alias].append(c)
            else:
                self.predicates.append(c)

    def read(self, s: Source) -> DataFrame:
        """An alias's columns, under prefixed names."""
        t = self.a.tables[s.alias]
        # the id is read only where it is needed: a synthetic one costs
        names = sorted(n for n in self.needed[s.alias] if t.kind(n) is not None)
        cols = [t.value(n).alias(f"{s.alias}{SEP}{n}") for n in names]
        if t.has_nulls:
            cols.append(F.col(NULLS).alias(f"{s.alias}{SEP}{NULLS}"))
        if t.has_keys:
            cols.append(F.col(KEYS_OF_MIXED).alias(f"{s.alias}{SEP}{KEYS_OF_MIXED}"))
        return t.df.select(*cols, F.lit(True).alias(_present(s.alias)))

    def gate(self, alias: str) -> list[Column]:
        """What an alias's record must fulfil on its own to take part."""
        out = []
        for f in sorted((f for f in self.required if f.alias == alias), key=lambda f: f.name):
            v = self.a.own(f)
            if f.name != "id" or v.null is not None:
                out.append(~v.is_missing() if v.family != "null" else F.lit(False))
        out += [condition(c, self.a.own) for c in self.gates[alias]]
        for group in self.a.classes():
            own = [f for f in group if f.alias == alias]
            out += [equal(self.a.own(own[0]), self.a.own(f)) for f in own[1:]]
        return out

    def keys(self, alias: str, before: set[str]) -> list[Column]:
        """Equalities of an alias's fields with those of aliases before it."""
        out = []
        for group in self.a.classes():
            own = [f for f in group if f.alias == alias]
            others = [f for f in group if f.alias in before]
            if own and others:
                value = self.a.own(others[0])
                same = [self.a.own(f) for f in others[1:]]
                same = [v for v in same if v.family == value.family]
                if same and any(s.kind in ("left", "right", "full") for s in self.q.sources):
                    value = Val(F.coalesce(value.col, *[v.col for v in same]), value.kind, value.null)
                out.append(_joined_on(value, self.a.own(own[0])))
        return out

    def tests(self) -> list[Column]:
        return [condition(p, self.a.unified) for p in self.predicates]

    def joined(self) -> DataFrame:
        sources = self.q.sources
        outer = [s for s in sources if s.kind in ("right", "full")]
        if not outer:
            return self.core()
        if len(sources) == 2:
            left, right = sources
            cond = self.gate(left.alias) + self.gate(right.alias) + self.keys(right.alias, {left.alias}) + [condition(p, self.a.own) for p in self.predicates]
            return self.read(left).join(self.read(right), _both(cond) if cond else F.lit(True), right.kind)
        # an inner core, and each outer alias's records that are not in it: a full join by id for each such
        # alias, so that the core is computed once
        for s in sources:  # the records are told by their ids
            self.needed[s.alias].add("id")
        out = self.core()
        kept = dict.fromkeys(a for i, s in enumerate(sources) if s.kind in ("right", "full") for a in ([s.alias] if s.kind == "right" else [s.alias, *[x.alias for x in sources[:i]]]))
        for s in sources:
            if s.alias in kept:
                rows = self.read(s)
                own = rows.columns
                rows = rows.select(*[F.col(f"`{c}`").alias(f"{SEP}{c}") for c in own])
                joined = out.join(rows, F.col(f"`{s.alias}{SEP}id`") == F.col(f"`{SEP}{s.alias}{SEP}id`"), "full")
                pick = lambda c, own=own: F.coalesce(F.col(f"`{c}`"), F.col(f"`{SEP}{c}`")).alias(c) if c in own else F.col(f"`{c}`")
                out = joined.select(*[pick(c) for c in out.columns])
        return out

    def core(self) -> DataFrame:
        """All joins with right and full ones as inner joins, then the remaining predicates."""
        out, before = None, set()
        for s in self.q.sources:
            rows = self.read(s)
            gate = _both(self.gate(s.alias))
            if gate is not None:
                rows = rows.where(gate)
            if out is None:
                out = rows
            else:
                on = _both(self.keys(s.alias, before))
                kind = "left" if s.kind == "left" else "inner"
                if on is not None:
                    out = out.join(rows, on, kind)
                else:
                    out = out.crossJoin(rows) if kind == "inner" else out.join(rows, F.lit(True), "left")
            before.add(s.alias)
        tests = _both(self.tests())
        return out if tests is None else out.where(tests)

    def struct(self, alias: str) -> Column:
        """A whole record; null if the alias is absent."""
        t = self.a.tables[alias]
        names = ["id", *[c for c in t.columns if c != "id"]]
        whole = F.struct(*[F.col(f"`{alias}{SEP}{n}`").alias(n) for n in names])
        return F.when(F.col(f"`{_present(alias)}`"), whole)


class Row:
    """Columns by attribute or item, for fn_* callbacks."""

    def __init__(self, cols: dict[str, Column]):
        self._cols = cols

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__") or name not in self._cols:
            raise AttributeError(name)
        return self._cols[name]

    __getitem__ = __getattr__


def _template(node: Any, value: Callable[[Any], Column]) -> Column:
    if isinstance(node, dict):
        return F.struct(*[_template(v, value).alias(k) for k, v in node.items()])
    if isinstance(node, (list, tuple)):
        return F.array(*[_template(v, value) for v in node])
    return value(node)


def _projection(template: Any, value: Callable[[Any], Column]) -> list[Column]:
    if isinstance(template, dict):
        return [_template(v, value).alias(k) for k, v in template.items()]
    return [_template(template, value).alias("value")]


def plan(q: Query) -> DataFrame:
    """The query's DataFrame."""
    p = _Plan(q)
    df = p.joined()
    refs = q.refs()
    for test in q.fn_wheres:
        records = {a: p.struct(a) for a in p.a.tables}
        df = df.where(test.column(records) if isinstance(test, Callback) else test(Row(records)))
    template = q.projection(refs) if q.projection else None
    having = [h(refs) for h in q.having_]
    orders = [(k(refs), desc) for k, desc in q.orders]
    grouped = q.keys is not None or any(True for _ in aggregates([template, having]))
    if not grouped and any(True for _ in aggregates([k for k, _ in orders])):
        raise TesseraError("INVALID_QUERY", "an order by an aggregate needs a group")
    if grouped:
        df, env = _group(p, df, q, [template, having, [k for k, _ in orders]])
    else:
        env = p.a.unified
    value = lambda node: column(node, env).col
    if template is None:
        rows = [(F.col(f"`{a}`") if grouped else p.struct(a)).alias(a) for a in p.a.tables]
    else:
        rows = _projection(template, value)
    hidden = [value(k).alias(f"{SEP}o{i}") for i, (k, _) in enumerate(orders)]
    hidden += [F.col(f"`{a}{SEP}id`").alias(f"{SEP}t{i}") for i, a in enumerate(p.ties)]
    test = _both([condition(h, env) for h in having])
    if test is not None:
        df = df.where(test)
    df = df.select(*rows, *hidden)
    visible = [c for c in df.columns if not c.startswith(SEP)]
    for f in q.fn_havings:
        own = {c: F.col(f"`{c}`") for c in visible}
        df = df.where(f.column(own) if isinstance(f, Callback) else f(Row(own)))
    if q.distinct_:
        if hidden:
            df = df.groupBy(*[F.col(f"`{c}`") for c in visible]).agg(*[F.first(f"`{SEP}o{i}`").alias(f"{SEP}o{i}") for i in range(len(hidden))])
        else:
            df = df.distinct()
    if orders:
        df = df.orderBy(*[F.col(f"`{SEP}o{i}`").desc_nulls_last() if desc else F.col(f"`{SEP}o{i}`").asc_nulls_last() for i, (_, desc) in enumerate(orders)], *[F.col(f"`{SEP}t{i}`").asc_nulls_last() for i in range(len(p.ties))])
    if q.offset_:
        df = df.offset(q.offset_)
    if q.limit_ is not None:
        df = df.limit(q.limit_)
    df = df.select(*[F.col(f"`{c}`") for c in visible])
    for f in q.fn_selects:
        own = {c: F.col(f"`{c}`") for c in df.columns}
        if isinstance(f, Callback):
            df = df.select(f.column(own).alias("value"))
            df = df.select("value.*") if isinstance(f.returns, T.StructType) else df
            continue
        made = f(Row(own))
        df = df.select(*[v.alias(k) for k, v in made.items()]) if isinstance(made, dict) else df.select(made.alias("value"))
    return df


def _group(p: _Plan, df: DataFrame, q: Query, templates: list[Any]) -> tuple[DataFrame, Callable[[Any], Val]]:
    """Groups with folded aggregates, and how their columns are read. No row makes no group."""
    env = p.a.unified
    keys: list[Any] = []
    if q.keys is not None:
        made = q.keys(q.refs())
        keys = list(made) if isinstance(made, (list, tuple)) else [made]
    key_vals = [column(k, env) for k in keys]
    marks = [v.null.alias(f"{SEP}n{i}") for i, v in enumerate(key_vals) if v.null is not None]
    cols = [v.col.alias(f"{SEP}k{i}") for i, v in enumerate(key_vals)] + marks
    by_key = {p.a.plain(k): i for i, k in enumerate(keys) if isinstance(k, Field)}
    folds = list(dict.fromkeys(aggregates(templates)))
    out = [aggregate(a, env).alias(f"{SEP}a{i}") for i, a in enumerate(folds)]
    plain = list(dict.fromkeys(p.a.plain(f) for f in _outside(templates) if p.a.plain(f) not in by_key))
    out += [F.first(env(f).col).alias(f"{SEP}f{i}") for i, f in enumerate(plain)]
    if q.projection is None:
        out += [F.first(p.struct(a)).alias(a) for a in p.a.tables]
    df = df.groupBy(*(cols or [F.lit(1).alias(f"{SEP}k")])).agg(*(out or [F.count(F.lit(1)).alias(f"{SEP}a")]))

    def read(node: Any) -> Val:
        if isinstance(node, Aggregate):
            return Val(F.col(f"`{SEP}a{folds.index(node)}`"), aggregate_type(node, env))
        f = p.a.plain(node)
        if f in by_key:
            i = by_key[f]
            null = F.col(f"`{SEP}n{i}`") if key_vals[i].null is not None else None
            return Val(F.col(f"`{SEP}k{i}`"), key_vals[i].kind, null)
        return Val(F.col(f"`{SEP}f{plain.index(f)}`"), env(f).kind)

    return df, read


def _outside(node: Any) -> Iterable[Field]:
    """Fields read outside of aggregates."""
    if isinstance(node, Field):
        yield node
    elif not isinstance(node, Aggregate):
        for child in children(node):
            yield from _outside(child)
