"""Graph-pattern algebra and filter expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Lit:
    value: str
    datatype: str = "http://www.w3.org/2001/XMLSchema#string"
    lang: str | None = None


Term = Var | Iri | Lit


# Property paths
@dataclass(frozen=True)
class Link:
    iri: str


@dataclass(frozen=True)
class Inverse:
    path: Any


@dataclass(frozen=True)
class Seq:
    left: Any
    right: Any


@dataclass(frozen=True)
class Alt:
    left: Any
    right: Any


@dataclass(frozen=True)
class Plus:
    path: Any


@dataclass(frozen=True)
class Star:
    path: Any


@dataclass(frozen=True)
class Maybe:
    path: Any


@dataclass(frozen=True)
class Pattern:
    """A triple pattern; ``p`` is a term or a property path."""

    s: Term
    p: Any
    o: Term


@dataclass(frozen=True)
class Bgp:
    patterns: tuple[Pattern, ...]


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
    branches: tuple[Any, ...]


@dataclass(frozen=True)
class Minus:
    left: Any
    right: Any


@dataclass(frozen=True)
class Exists:
    """Keeps the rows of ``child`` for which ``pattern`` has a (or no) compatible solution."""

    child: Any
    pattern: Any
    negated: bool = False


@dataclass(frozen=True)
class Filter:
    child: Any
    condition: Any


@dataclass(frozen=True)
class Extend:
    child: Any
    name: str
    expression: Any


@dataclass(frozen=True)
class Values:
    names: tuple[str, ...]
    rows: tuple[tuple[Any, ...], ...]


@dataclass(frozen=True)
class Group:
    child: Any
    keys: tuple[str, ...]
    aggregates: tuple[tuple[str, str, Any, bool], ...]  # name, function, expression or None, distinct


@dataclass(frozen=True)
class Project:
    child: Any
    names: tuple[str, ...]


@dataclass(frozen=True)
class Distinct:
    child: Any


@dataclass(frozen=True)
class Reduced:
    child: Any


@dataclass(frozen=True)
class OrderBy:
    child: Any
    keys: tuple[tuple[Any, bool], ...]  # expression, descending


@dataclass(frozen=True)
class Slice:
    child: Any
    limit: int | None = None
    offset: int = 0


# Filter expressions
@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Value:
    term: Iri | Lit


@dataclass(frozen=True)
class Compare:
    op: str  # = != < > <= >=
    left: Any
    right: Any


@dataclass(frozen=True)
class And:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Or:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class In:
    left: Any
    values: tuple[Any, ...]
    negated: bool = False


@dataclass(frozen=True)
class Arith:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...] = field(default_factory=tuple)


def variables(x: Any) -> list[str]:
    """The variables that a pattern binds, in order of appearance."""
    match x:
        case Pattern():
            out = [t.name for t in (x.s, x.p, x.o) if isinstance(t, Var)]
        case Bgp():
            out = [v for p in x.patterns for v in variables(p)]
        case Join() | LeftJoin():
            out = variables(x.left) + variables(x.right)
        case Union():
            out = [v for b in x.branches for v in variables(b)]
        case Minus():
            out = variables(x.left)
        case Values():
            out = list(x.names)
        case Extend():
            out = [*variables(x.child), x.name]
        case Group():
            out = [*x.keys, *(a[0] for a in x.aggregates)]
        case Project():
            out = list(x.names)
        case _:
            out = variables(x.child)
    return list(dict.fromkeys(out))


def predicates_of(x: Any) -> set[str] | None:
    """All predicates that a query can touch; None if it may touch any."""
    if isinstance(x, Pattern):
        if isinstance(x.p, Var):
            return None
        return {x.p.value} if isinstance(x.p, Iri) else _path_predicates(x.p)
    parts = [p for name in ("patterns", "branches") for p in getattr(x, name, ())] + [getattr(x, n) for n in ("left", "right", "child", "pattern") if hasattr(x, n)]
    out: set[str] = set()
    for p in parts:
        found = predicates_of(p)
        if found is None:
            return None
        out |= found
    return out


def _path_predicates(path: Any) -> set[str] | None:
    match path:
        case Link(iri):
            return {iri}
        case Inverse(inner) | Plus(inner):
            return _path_predicates(inner)
        case Seq(left, right) | Alt(left, right):
            a, b = _path_predicates(left), _path_predicates(right)
            return None if a is None or b is None else a | b
    return None  # a path of no step may touch any node


TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def classes_of(x: Any) -> set[str] | None:
    """The classes that a query's type patterns name; None if one is a variable or inside a path."""
    if isinstance(x, Pattern):
        if isinstance(x.p, Iri):
            return set() if x.p.value != TYPE else {x.o.value} if isinstance(x.o, Iri) else None
        found = None if isinstance(x.p, Var) else _path_predicates(x.p)
        return None if found is None or TYPE in found else set()
    parts = [p for name in ("patterns", "branches") for p in getattr(x, name, ())] + [getattr(x, n) for n in ("left", "right", "child", "pattern") if hasattr(x, n)]
    out: set[str] = set()
    for p in parts:
        found = classes_of(p)
        if found is None:
            return None
        out |= found
    return out


def mentioned(e) -> frozenset[str]:
    """The variables of an expression."""
    if isinstance(e, Ref):
        return frozenset({e.name})
    if isinstance(e, tuple | list):
        return frozenset().union(*map(mentioned, e))
    return frozenset().union(*map(mentioned, vars(e).values())) if hasattr(e, "__dataclass_fields__") else frozenset()
