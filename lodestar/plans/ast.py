"""Logical nodes of the query language."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Step:
    """A name on a path; quant: ANY, ALL or NONE; where: filters on the objects reached; depth: -1 transitive, n bounded, 0 plain."""

    name: str
    quant: str = "ANY"
    where: tuple = ()
    depth: int = 0


@dataclass(frozen=True)
class Everything:
    pass


@dataclass(frozen=True)
class Nothing:
    pass


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Range:
    low: str | None = None
    low_in: bool = True
    high: str | None = None
    high_in: bool = True


@dataclass(frozen=True)
class Clause:
    """The last step is a field (or a link, or a part of a timestamp); op: = : in range null; steps is empty for all fields."""

    steps: tuple
    op: str
    value: object = None


@dataclass(frozen=True)
class Count:
    """Number of values (distinct: of different values) at the end of a path, within a range."""

    steps: tuple
    test: Range
    distinct: bool = False


@dataclass(frozen=True)
class PathSets:
    """EQUALS, DIFFERS, INTERSECTS, CONTAINS or DISJOINT of the values at two paths."""

    kind: str
    left: tuple
    right: tuple


@dataclass(frozen=True)
class Group:
    """A grouping expression. func: none, BATCH, TRUNCATE, TERMS, UPPER, LOWER, SETS; pick: TOP, BOTTOM, FIRST, LAST."""

    steps: tuple = ()
    func: str | None = None
    args: tuple = ()
    where: tuple = ()
    pick: str | None = None
    n: int = 0
    include: tuple = ()
    exclude: tuple = ()
    alias: str | None = None


@dataclass(frozen=True)
class Metric:
    func: str
    steps: tuple = ()
    where: tuple = ()
    roundup: float | None = None


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Output:
    """A field of a result; of a link: limit, filters and the fields of the objects linked."""

    name: str
    limit: int | None = None
    where: tuple = ()
    inner: tuple = field(default=())
    alias: str | None = None
