"""The query algebra: what a query says, apart from how Spark runs it."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Path:
    """A property path: op is iri, inv, seq, alt, plus, star, opt or not; args are terms or paths."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass(frozen=True)
class BGP:
    triples: tuple[Triple, ...]


@dataclass(frozen=True)
class Join:
    left: Any
    right: Any


@dataclass(frozen=True)
class LeftJoin:
    left: Any
    right: Any
    condition: Any = None


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any


@dataclass(frozen=True)
class Minus:
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    child: Any
    condition: Any


@dataclass(frozen=True)
class Extend:
    child: Any
    var: Var
    expr: Any


@dataclass(frozen=True)
class Values:
    vars: tuple[Var, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Graph:
    name: Any
    child: Any


@dataclass(frozen=True)
class Group:
    child: Any
    keys: tuple  # of (Var, expr or None)
    aggregates: tuple  # of (Var, Call)


@dataclass(frozen=True)
class Project:
    child: Any
    vars: tuple[Var, ...] | None  # None: all


@dataclass(frozen=True)
class Distinct:
    child: Any


@dataclass(frozen=True)
class OrderBy:
    child: Any
    keys: tuple  # of (expr, descending)


@dataclass(frozen=True)
class Slice:
    child: Any
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Call:
    """An expression: a function, operator or aggregate by name."""

    name: str
    args: tuple = ()
    distinct: bool = False


@dataclass(frozen=True)
class Exists:
    child: Any
    negated: bool = False


@dataclass(frozen=True)
class Query:
    kind: str  # select, ask, construct, describe
    body: Any
    template: tuple[Triple, ...] = ()
    targets: tuple = field(default_factory=tuple)
    dataset: tuple = ()  # of (named, graph) from FROM and FROM NAMED


def predicates(q: Query) -> set[str] | None:
    """The predicates of the statements that a query can touch; None where that may be any: a variable, a negated set, nodes that are there without a step, DESCRIBE."""
    found: set[str] = set()

    def of_path(p) -> bool:
        if isinstance(p, str):
            found.add(p)
            return True
        return isinstance(p, Path) and p.op not in ("not", "star", "opt") and all([of_path(a) for a in p.args])

    def walk(x) -> bool:
        if isinstance(x, Triple):
            return of_path(x.p)
        if isinstance(x, (tuple, list)):
            return all([walk(y) for y in x])
        return all([walk(getattr(x, f.name)) for f in fields(x)]) if is_dataclass(x) else True

    return found if q.kind != "describe" and walk(q.body) else None


def ensure_distinct(q: Query) -> Query:
    """Force DISTINCT under any slice or order of a select."""

    def put(node):
        if isinstance(node, (Slice, OrderBy)):
            return replace(node, child=put(node.child))
        return node if isinstance(node, Distinct) else Distinct(node)

    return replace(q, body=put(q.body)) if q.kind == "select" else q


def has_user_pagination(q: Query) -> bool:
    return isinstance(q.body, Slice)


def user_limit(q: Query) -> int | None:
    return q.body.limit if isinstance(q.body, Slice) else None


def limit_results(q: Query, most: int) -> Query:
    """At most ``most`` rows: a higher LIMIT is lowered, a lower one stays."""
    if isinstance(q.body, Slice):
        own = q.body.limit
        return replace(q, body=replace(q.body, limit=most if own is None else min(own, most)))
    return replace(q, body=Slice(q.body, limit=most))


def offset_results(q: Query, offset: int) -> Query:
    """An OFFSET, only where the query has none of its own."""
    if isinstance(q.body, Slice):
        return q if q.body.offset else replace(q, body=replace(q.body, offset=offset))
    return replace(q, body=Slice(q.body, offset=offset))
