"""The node query language, compiled to one column so that Catalyst can push it down.

or := and (OR and)*, and := unary (AND unary)*, unary := NOT unary | ( or ) | field:value | text. Operators are
words in any case; "..." takes backslash escapes, '...' is raw. Two neighbours without an operator are an error.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QueryError(ValueError):
    def __init__(self, said: str, column: int):
        super().__init__(f"{said} (column {column})")
        self.column = column


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Field:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Join:
    op: str
    parts: tuple


FIELDS = ("id", "tag", "kind", "db", "path", "degree", "group", "version")
_TOKEN = re.compile(r"""\s*(?:([()])|((?:"(?:\\.|[^"\\])*"|'[^']*'|[^\s()"'])+))""")
_FIELD = re.compile(rf"({'|'.join(FIELDS)}):(>=|<=|!=|>|<|=)?(.*)", re.I | re.S)
_QUOTED = re.compile(r""""((?:\\.|[^"\\])*)"|'([^']*)'""", re.S)


def _plain(word: str) -> str:
    return _QUOTED.sub(lambda m: re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2], word)


def scan(text: str) -> list[tuple[str, int]]:
    """(token, its column from 1)."""
    out, at = [], 0
    while text[at:].strip():
        if not (m := _TOKEN.match(text, at)):
            raise QueryError("unfinished quotation", at + 1)
        out.append((m[1] or m[2], m.start(1 if m[1] else 2) + 1))
        at = m.end()
    return out


def parse(text: str):
    tokens, at = scan(text), 0

    def word() -> str:
        return tokens[at][0].upper() if at < len(tokens) else ""

    def joined(op: str, part):
        nonlocal at
        parts = [part()]
        while word() == op:
            at += 1
            parts.append(part())
        flat = [q for p in parts for q in (p.parts if isinstance(p, Join) and p.op == op else (p,))]
        return Join(op, tuple(flat)) if len(flat) > 1 else flat[0]

    def either():
        return joined("OR", both)

    def both():
        return joined("AND", unary)

    def unary():
        nonlocal at
        if at >= len(tokens):
            raise QueryError("something is missing at the end", len(text) + 1)
        raw, column = tokens[at]
        at += 1
        if raw.upper() == "NOT":
            return Not(unary())
        if raw == "(":
            inner = either()
            if word() != ")":
                raise QueryError("a closing bracket is missing", column)
            at += 1
            return inner
        if raw == ")" or raw.upper() in ("AND", "OR"):
            raise QueryError(f"{raw} is not expected here", column)
        if m := _FIELD.fullmatch(raw):
            name, op, value = m[1].lower(), m[2] or "", _plain(m[3])
            number = r"\d+" if name == "degree" else r"-?\d+(\.\d+)?"
            if name in ("degree", "version") and op not in (">", "<", ">=", "<=", "="):
                raise QueryError(f"{name} needs one of > < >= <= =", column)
            if name in ("degree", "version") and not re.fullmatch(number, value):
                raise QueryError(f"{name} needs a number", column)
            if not op and re.match(r"[!$^*~+]", m[3]):
                raise QueryError(f"{name} does not know {m[3][0]}", column)
            return Field(name, op, value)
        return Text(_plain(raw))

    if not tokens:
        return None
    out = either()
    if at < len(tokens):
        raise QueryError("AND or OR is missing", tokens[at][1])
    return out


def show(q) -> str:
    """Text that parses to q."""

    def quoted(s: str) -> str:
        bare = s and not re.search(r"""[\s()"']""", s) and s.upper() not in ("AND", "OR", "NOT") and not _FIELD.fullmatch(s)
        return s if bare else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    if q is None:
        return ""
    if isinstance(q, Text):
        return quoted(q.value)
    if isinstance(q, Field):
        bare = q.value and not re.search(r"""[\s()"']""", q.value) and q.value[0] not in "<>=!"
        return f"{q.name}:{q.op}" + (q.value if bare else '"' + q.value.replace("\\", "\\\\").replace('"', '\\"') + '"')
    if isinstance(q, Not):
        return f"NOT {show(q.of) if not isinstance(q.of, Join) else f'({show(q.of)})'}"
    return f" {q.op} ".join(f"({show(p)})" if isinstance(p, Join) else show(p) for p in q.parts)


def matches(q) -> Column:
    """q over columns id, label, kind, database_id, group_label, degree, version and tags array<string>."""
    if q is None:
        return F.lit(True)
    if isinstance(q, Text):
        return F.coalesce(F.lower("label").contains(q.value.lower()), F.lit(False))
    if isinstance(q, Not):
        return ~matches(q.of)
    if isinstance(q, Join):
        out = matches(q.parts[0])
        for p in q.parts[1:]:
            out = out & matches(p) if q.op == "AND" else out | matches(p)
        return out
    value = q.value.lower()
    if q.name == "tag":
        return F.coalesce(F.exists("tags", lambda t: F.lower(t) == value.removeprefix("#")), F.lit(False))
    if q.name in ("degree", "version"):
        column, number = F.col(q.name), float(q.value)
        held = {">": column > number, "<": column < number, ">=": column >= number, "<=": column <= number, "=": column == number}[q.op]
        return F.coalesce(held, F.lit(False))
    name = {"id": "id", "path": "id", "kind": "kind", "db": "database_id", "group": "group_label"}[q.name]
    return F.coalesce(F.lower(name) == value, F.lit(False))


def _asked(query) -> object:
    """A query's tree; a text that does not parse asks for nothing, as an empty one."""
    if not isinstance(query, str):
        return query
    try:
        return parse(query)
    except QueryError:
        return None


def hidden(text: str = "", groups: list[str] = (), kinds: list[str] = (), min_degree: int = 0, query=None, orphans: bool = False, existing_only: bool = False) -> Column:
    """True for nodes that a composite filter hides, never null. orphans and existing_only hide nodes without edges."""
    out = ~matches(_asked(query))
    if text.strip():
        out = out | ~F.coalesce(F.lower("label").contains(text.strip().lower()), F.lit(False))
    if groups:
        out = out | F.coalesce(F.col("group_label").isin(*groups), F.lit(False))
    if kinds:
        out = out | F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
    if orphans or existing_only:
        out = out | (F.coalesce("degree", F.lit(0)) == 0)
    return out | (F.coalesce("degree", F.lit(0)) < min_degree)


def highlight(text: str = "", query=None) -> Column | None:
    """True for nodes that a search lights: by the query if there is one, else by the text; None if there is neither."""
    asked = _asked(query)
    if asked is not None:
        return matches(asked)
    return matches(Text(text.strip())) if text.strip() else None


def console_filter(databases: list[str] = (), kinds: list[str] = (), tags: list[str] = ()) -> Column:
    """True for nodes that stay when databases, kinds and tag labels are hidden."""
    no = F.lit(False)
    gone = F.coalesce(F.col("kind").isin(*kinds), no) | F.coalesce(F.col("database_id").isin(*databases), no)
    return ~(gone | F.coalesce((F.col("kind") == "tag") & F.col("label").isin(*tags), no))


def search(nodes: DataFrame, text: str, order: str) -> DataFrame:
    """The first node by `order` whose label holds the text; none for an empty text."""
    low = text.strip().lower()
    found = nodes.filter(F.lower("label").contains(low)) if low else nodes.limit(0)
    return found.orderBy(order).limit(1)


def visible_graph(nodes: DataFrame, edges: DataFrame, hides: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that are not hidden, and the edges between them: what a new layout of a filtered graph takes."""
    kept = nodes.filter(~hides)
    have = kept.select("id")
    return kept, edges.join(have.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(have.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def first_match(rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule (name, query text) that a node meets."""
    out = F.lit(None).cast("string")
    for name, text in reversed(rules):
        out = F.when(matches(parse(text)), name).otherwise(out)
    return out


def _finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    return out


def meets_view(x: Column, y: Column, r: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """The square around a disc meets a rectangle. A NaN edge of the rectangle is no bound; a place that is not finite is out of view."""
    left, top = (-math.inf if math.isnan(v) else v for v in (left, top))
    right, bottom = (math.inf if math.isnan(v) else v for v in (right, bottom))
    inside = (x + r >= left) & (x - r <= right) & (y + r >= top) & (y - r <= bottom)
    return _finite(x, y) & F.coalesce(inside, F.lit(False))


def segment_meets_view(x0: Column, y0: Column, x1: Column, y1: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """The box around a segment meets a rectangle."""
    wide = (F.greatest(x0, x1) >= left) & (F.least(x0, x1) <= right)
    return _finite(x0, y0, x1, y1) & wide & (F.greatest(y0, y1) >= top) & (F.least(y0, y1) <= bottom)


def in_box(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A place lies in the box with these two corners, its sides included."""
    return _finite(x, y) & x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))
