"""Query trees."""

from __future__ import annotations

from dataclasses import dataclass, field

SHOULD, MUST, MUST_NOT = "should", "must", "must_not"


class Node:
    """A query; ``field`` None is the default field."""


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class MatchNone(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    field: str | None
    text: str


@dataclass(frozen=True)
class Phrase(Node):
    field: str | None
    text: str
    slop: int = 0
    prefix: bool = False


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str | None
    text: str
    distance: int = 2


@dataclass(frozen=True)
class Wildcard(Node):
    field: str | None
    pattern: str


@dataclass(frozen=True)
class Regex(Node):
    field: str
    pattern: str


@dataclass(frozen=True)
class Range(Node):
    field: str | None
    low: str | None
    high: str | None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class Exists(Node):
    field: str


@dataclass(frozen=True)
class SetOf(Node):
    field: str | None
    values: tuple[str, ...]


@dataclass(frozen=True)
class Bool(Node):
    clauses: tuple[tuple[str, Node], ...]
    least: int | None = None  # should-clauses that must match


@dataclass(frozen=True)
class Boost(Node):
    inner: Node
    factor: float


@dataclass(frozen=True)
class DisMax(Node):
    parts: tuple[Node, ...]
    tie: float = 0.0


@dataclass(frozen=True)
class Const(Node):
    inner: Node
    score: float = 1.0


@dataclass(frozen=True)
class FuncScore(Node):
    function: str


@dataclass(frozen=True)
class FuncBoost(Node):
    inner: Node
    function: str
    add: bool = False


@dataclass(frozen=True)
class FuncRange(Node):
    function: str
    low: float | None = None
    high: float | None = None
    include_low: bool = True
    include_high: bool = True


@dataclass(frozen=True)
class Geo(Node):
    field: str
    lat: float
    lon: float
    km: float
    box: bool = False


@dataclass(frozen=True)
class Rectangle(Node):
    field: str
    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float


@dataclass(frozen=True)
class Interval(Node):
    field: str
    start: int
    end: int
    op: str = "intersects"


@dataclass(frozen=True)
class Payload(Node):
    field: str
    text: str
    function: str


def leaves(node: Node) -> list[Node]:
    """All nodes without inner ones."""
    match node:
        case Bool():
            return [x for _, c in node.clauses for x in leaves(c)]
        case Boost() | Const() | FuncBoost():
            return leaves(node.inner)
        case DisMax():
            return [x for p in node.parts for x in leaves(p)]
    return [node]
