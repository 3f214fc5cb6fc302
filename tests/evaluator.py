"""A nested-loop model of builder queries over small tables of Python dicts, to hold plans against."""

from __future__ import annotations

from itertools import product
from typing import Any

from tessera.functions.expr import Expr, Field, required_fields
from tessera.values import MISSING, same


def value(row: dict, f: Field) -> Any:
    record = row.get(f.alias)
    if record is None:
        return MISSING
    return record.get(f.name, MISSING)


def number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def evaluate(node: Any, row: dict) -> Any:
    if isinstance(node, Field):
        return value(row, node)
    if not isinstance(node, Expr):
        return node
    args = [evaluate(a, row) for a in node.args]
    if node.op == "eq":
        return same(*args)
    if node.op == "ne":
        return not same(*args)
    if node.op in ("gt", "gte", "lt", "lte"):
        a, b = args
        if not (number(a) and number(b) or isinstance(a, str) and isinstance(b, str)):
            return False
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[node.op]
    if node.op == "and":
        return all(bool(a) for a in args)
    if node.op == "or":
        return any(bool(a) for a in args)
    if node.op == "not":
        return not args[0]
    if node.op == "is_undefined":
        return args[0] is MISSING
    raise NotImplementedError(node.op)


def run(sources: list[tuple[str, list[dict], str]], conditions: list[Any]) -> list[dict]:
    """Rows of alias to record for from, inner and left sources, and for two sources right and full ones."""
    flat: list[Any] = []
    for c in conditions:
        flat += list(c.args) if isinstance(c, Expr) and c.op == "and" else [c]

    def is_join(c):
        return isinstance(c, Expr) and c.op == "eq" and all(isinstance(a, Field) for a in c.args)

    def is_constant(c):
        return isinstance(c, Expr) and c.op == "eq" and not is_join(c) and any(isinstance(a, Field) for a in c.args) and not any(isinstance(a, Expr) for a in c.args)

    joins = [c for c in flat if is_join(c)]
    constants = [c for c in flat if is_constant(c)]
    rest = [c for c in flat if c not in joins and c not in constants]
    required = {f for c in flat for f in required_fields(c)}

    def gated(alias, record):
        row = {alias: record}
        return all(value(row, f) is not MISSING for f in required if f.alias == alias) and all(evaluate(c, row) for c in constants if {a.alias for a in c.args if isinstance(a, Field)} == {alias})

    def joined(row, alias):
        known = [c for c in joins if alias in {a.alias for a in c.args} and all(a.alias in row for a in c.args)]
        return all(value(row, c.args[0]) is not MISSING and value(row, c.args[1]) is not MISSING and evaluate(c, row) for c in known)

    kinds = [k for _, _, k in sources]
    if len(sources) == 2 and kinds[1] in ("right", "full"):
        (a, left, _), (b, right, kind) = sources
        out, hit_a, hit_b = [], set(), set()
        for (i, x), (j, y) in product(enumerate(left), enumerate(right)):
            row = {a: x, b: y}
            if gated(a, x) and gated(b, y) and joined(row, b) and all(evaluate(c, row) for c in rest):
                out.append(row)
                hit_a.add(i)
                hit_b.add(j)
        out += [{a: None, b: y} for j, y in enumerate(right) if j not in hit_b]
        if kind == "full":
            out += [{a: x, b: None} for i, x in enumerate(left) if i not in hit_a]
        return out
    rows: list[dict] = [{}]
    for alias, records, kind in sources:
        new = []
        for row in rows:
            found = [{**row, alias: r} for r in records if gated(alias, r) and joined({**row, alias: r}, alias)]
            new += found or ([{**row, alias: None}] if kind == "left" else [])
        rows = new
    return [r for r in rows if all(evaluate(c, r) for c in rest)]
