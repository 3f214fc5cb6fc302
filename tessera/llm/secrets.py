"""Secret scans: fixed base patterns, and assignment-aware lexing that adds what the patterns miss.

The lexer reads source and configuration syntax into name-literal pairs: assignments, mappings, keyword
arguments, annotated names; values on the next line, inside calls, lists and braces, of several lines
(triple quotes, block scalars). It propagates constants through names (``a = "..."``, then ``auth = a``) and
concatenations, and scores every literal by the most sensitive name it reaches and by how random it looks.
Private keys in armour are found by their frame.

Texts are read whole, in time proportional to their length: no expression backtracks over a line, each
name is visited once by the propagation, and spans are compared in order.

Null texts count as empty. Positions are code points, ends exclusive. Repeated rows are scanned each on its
own, and an empty table gives no rows. A column of the input that bears the name of an output column is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tessera.llm.text import append_columns

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as a shorter one is dropped anyway
KINDS = ("assign", "access", "hex", "literal")

#: How much a part of a name tells that its value is secret.
SENSITIVE = {
    "password": 1.0,
    "passwd": 1.0,
    "pwd": 0.9,
    "passphrase": 1.0,
    "secret": 1.0,
    "token": 0.9,
    "apikey": 1.0,
    "credential": 0.9,
    "credentials": 0.9,
    "bearer": 0.8,
    "auth": 0.6,
    "authorization": 0.8,
    "private": 0.5,
    "signing": 0.5,
    "encryption": 0.5,
    "access": 0.4,
    "api": 0.4,
    "client": 0.2,
    "key": 0.5,
    "salt": 0.5,
    "pin": 0.5,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "xxxx", "none", "null", "true", "false", "todo")
THRESHOLD = 0.7
SHORTEST = 6

_TOKEN = re.compile(
    r"""(?P<line>(?:[^\S\n]*\n)+)
    |(?P<space>[^\S\n]+)
    |(?P<comment>(?<!\S)(?://|\#)[^\n]*)
    |(?P<prose>[A-Za-z]++(?:[ ][A-Za-z]++(?=[ ][A-Za-z]))+)
    |(?P<quote>\"\"\"|\'\'\'|"|`|(?<![A-Za-z0-9])')
    |(?P<op>=>|:=|\+=|==|!=|<=|>=|::|[=:+,;(){}\[\]<>])
    |(?P<bare>[^\s"`'=:+,;(){}\[\]<>]+)
    |(?P<other>.)""",
    re.VERBOSE | re.DOTALL,
)
#: What ends a string, or tells that it has no end, by its quote.
_ENDS = {
    '"': re.compile(r'(?:[^"\\\n]++|\\.)*+"', re.DOTALL),
    "'": re.compile(r"(?:[^'\\\n]++|\\.)*+'", re.DOTALL),
    "`": re.compile(r"[^`]*+`"),
    '"""': re.compile(r'(?:[^"\\]++|\\.|"(?!""))*+"""', re.DOTALL),
    "'''": re.compile(r"(?:[^'\\]++|\\.|'(?!''))*+'''", re.DOTALL),
}
_ASSIGNS = ("=", ":", ":=", "=>", "+=")
_NAME = re.compile(r"[A-Za-z_$][\w$.-]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BEGIN, _END = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")


def name_score(name: str) -> float:
    """How sensitive a target name is: its parts add up, at most 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    whole = "".join(parts)
    return max(min(1.0, sum(SENSITIVE.get(p, 0.0) for p in parts)), SENSITIVE.get(whole, 0.0))


def literal_score(value: str) -> float:
    """How much a literal looks like key material: by its entropy and its kinds of characters."""
    low = value.lower()
    if len(value) < SHORTEST or any(c.isspace() for c in value) or any(p in low for p in PLACEHOLDERS) or len(set(value)) < 4:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)))
    return min(1.0, entropy / 4.0) * (0.4 + 0.2 * min(3, kinds))


def _tokens(text: str):
    """Tokens as (kind, text, start, end); strings without their quotes, comments and blanks left out.

    A quote that is not closed (on its line, if strings of its kind end there) is no string, and no further
    one up to there is tried.
    """
    at, n, dead = 0, len(text), dict.fromkeys(_ENDS, 0)
    while at < n:
        m = _TOKEN.match(text, at)
        kind, value, start, at = m.lastgroup, m.group(), m.start(), m.end()
        if kind == "quote":
            if start < dead[value]:
                continue
            end = _ENDS[value].match(text, at)
            if end is None:
                line = text.find("\n", at) if value in "'\"" else -1
                dead[value] = n if line < 0 else line
                continue
            yield "string", text[at : end.end() - len(value)], at, end.end() - len(value)
            at = end.end()
        elif kind not in ("space", "comment", "other"):
            yield kind, value, start, at


def _block(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Lines of a block scalar: those after ``at`` that are indented like the first one, and where they end."""
    out, depth = [], None
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        own = len(line) - len(line.lstrip())
        if line.strip():
            if depth is None:
                if not own:
                    break
                depth = own
            if own < depth:
                break
            out.append((at + own, at + len(line.rstrip())))
        at = end + 1
    return out, at


def _bindings(text: str):
    """What names stand for, as (name, start, end, word): a literal's place, and the word if it may be a name."""
    stream = _tokens(text)
    ahead: list[tuple[str, str, int, int]] = []

    def peek(k: int) -> tuple[str, str, int, int]:
        while len(ahead) <= k:
            ahead.append(next(stream, ("end", "", len(text), len(text))))
        return ahead[k]

    frames: list[str | None] = []  # for each open bracket, the name that its contents belong to
    name, waiting, by, skip = None, False, "", 0
    while True:
        kind, value, start, end = peek(0)
        ahead.pop(0)
        if kind == "end":
            return
        if start < skip:
            continue
        if kind == "line":
            if value.count("\n") > 1:
                frames.clear()
                name, waiting = None, False
            elif not waiting:
                name = None
            by = "line" if waiting else ""
            continue
        inside = frames[-1] if frames else None
        if kind == "prose":  # a run of words: only its first one can be a value
            if waiting:
                word = value.split(" ", 1)[0]
                yield name, start, start + len(word), word
            name, waiting = None, False
            continue
        after = peek(0)
        is_name = kind in ("string", "bare") and _NAME.match(value)
        if is_name and after[1] in _ASSIGNS and after[0] == "op":
            tight = kind == "bare" and waiting and by != "line" and after[2] == end and peek(1)[2] == after[3]
            if waiting and by == ":" and after[1] == "=" and not tight:  # an annotated name
                ahead.pop(0)
                by = "="
                continue
            if not tight:
                ahead.pop(0)
                name, waiting, by = value, True, after[1]
                if after[1] == ":" and peek(0)[1] in ("|", ">", "|-", ">-", "|+", ">+") and (peek(1)[0] == "line" or (peek(1)[0] == "bare" and peek(1)[1] in "+-" and peek(2)[0] == "line")):
                    spans, skip = _block(text, text.find("\n", peek(0)[3]) + 1)
                    for a, b in spans:
                        yield name, a, b, None
                    name, waiting = None, False
                continue
        if kind == "op" and value in "([{":
            frames.append((name if name is not None else inside) if value != "{" else None)
            name, waiting = (frames[-1], frames[-1] is not None)
            by = value
        elif kind == "op" and value in ")]}":
            if frames:
                frames.pop()
            name, waiting = None, False
        elif kind == "op" and value in (",", ";"):
            name, waiting = inside, inside is not None
            by = value
        elif kind == "op" and value == "+":
            waiting = name is not None
        elif kind == "op":
            name, waiting = None, False
        elif kind == "string":
            if waiting:
                yield name, start, end, None
            waiting = False
        elif kind == "bare":
            if waiting:
                while peek(0)[2] == end and (peek(0)[0] == "bare" or peek(0)[1] in (":", "=", "+", "==", "::", "=>")):
                    end = ahead.pop(0)[3]  # one literal up to the next blank, quote, comma or bracket
                whole = text[start:end]
                words = whole.split("+")
                if all(_NAME.match(x) for x in words):
                    at = start
                    for x in words:
                        yield name, at, at + len(x), x
                        at += len(x) + 1
                else:
                    yield name, start, end, None
            waiting = False


def literals(text: str) -> list[tuple[int, int, float]]:
    """Literals that are bound to sensitive names, by themselves or through other names."""
    out = []
    if "PRIVATE KEY-----" in text:
        begins = [m.start() for m in _BEGIN.finditer(text)]
        for m in _END.finditer(text):
            k = bisect_right(begins, m.start()) - 1
            if k >= 0 and (not out or begins[k] >= out[-1][1]):
                out.append((begins[k], m.end(), 1.0))
    if "=" not in text and ":" not in text:
        return out
    bound: dict[str, list[tuple[int, int]]] = {}
    links: dict[str, list[str]] = {}
    bare: list[tuple[str, int, int, str]] = []
    for name, a, b, word in _bindings(text):
        own = bound.setdefault(name, [])
        if word is None:
            own.append((a, b))
        else:
            bare.append((name, a, b, word))
    for name, a, b, word in bare:
        if word in bound and word != name:
            links.setdefault(name, []).append(word)
        else:  # a bare word that names no constant is a literal
            bound[name].append((a, b))
    best: dict[tuple[int, int], float] = {}
    seen: set[str] = set()
    for score, target in sorted(((name_score(x), x) for x in bound), key=lambda x: (-x[0], x[1])):
        if score <= 0:
            break
        if target in seen:  # it was reached from a name that is no less sensitive
            continue
        seen.add(target)
        todo = [target]
        while todo:
            name = todo.pop()
            for span in bound[name]:
                best.setdefault(span, score)
            for other in links.get(name, ()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
    for (a, b), score in best.items():
        random = literal_score(text[a:b])
        total = 0.6 * score + 0.4 * random if random > 0.3 else 0.0
        if total >= THRESHOLD:
            out.append((a, b, round(total, 4)))
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """Matches of the fixed patterns: start, end, kind, and the bounds of the secret itself."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0, m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def scan(text: str) -> list[tuple[int, int, int, int, int]]:
    """All spans of a text: the base ones, and literals that no base span overlaps."""
    spans = base_spans(text)
    starts, ends = [], []  # the base spans' union, in order
    for s, e, *_ in spans:
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    added = []
    for a, b, _ in literals(text):
        k = bisect_left(starts, b) - 1  # the last one that begins before the literal ends
        if k < 0 or ends[k] <= a:
            added.append((a, b, 3, a, b))
    return sorted(spans + added, key=lambda x: (x[0], x[2]))


SECRET = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("value_start", T.LongType()),
        T.StructField("value_end", T.LongType()),
    ]
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64())]))


def find_secrets(docs: DataFrame, *, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the column ``out``: the secrets of each text by start, then kind."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for v in batch.column(batch.schema.get_field_index(text)):
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "value_start": a, "value_end": b} for s, e, k, a, b in scan(v.as_py() or "")])
        return [pa.array(rows, _ARROW)]

    return append_columns(docs, [T.StructField(out, T.ArrayType(SECRET))], compute, needs=[text])


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret value of ``text`` replaced by ``mark``; overlapping values share one."""

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for v in batch.column(batch.schema.get_field_index(text)):
            x = v.as_py()
            pieces, at = [], 0
            for a, b in sorted((a, b) for _, _, _, a, b in scan(x or "")):
                if a >= at:
                    pieces += [x[at:a], mark]
                at = max(at, b)
            rows.append("".join([*pieces, x[at:]]) if pieces else x)
        return [pa.array(rows, pa.string())]

    order = docs.columns
    return append_columns(docs, [T.StructField(text, T.StringType())], compute, needs=[text]).select(*[f"`{c}`" for c in order])
