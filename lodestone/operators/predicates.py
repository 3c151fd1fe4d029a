"""Predicates as values: they compile to Columns, so Catalyst sees (and pushes down) all of them.

A null operand never qualifies, as in SQL. Columns are named, or given by position where an operator works by position.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: op: (function, its inverse, the same with sides switched)
OPERATORS: dict[str, tuple[Callable, str, str]] = {
    "=": (operator.eq, "<>", "="),
    "<>": (operator.ne, "=", "<>"),
    "<": (operator.lt, ">=", ">"),
    "<=": (operator.le, ">", ">="),
    ">": (operator.gt, "<=", "<"),
    ">=": (operator.ge, "<", "<="),
}

Resolve = Callable[[Any], Column]


def invert(op: str) -> str:
    return OPERATORS[op][1]


def switch_sides(op: str) -> str:
    return OPERATORS[op][2]


def named(reference: Any) -> Column:
    return F.col(reference)


@dataclass(frozen=True)
class Atom:
    """column op literal"""

    column: Any
    op: str
    value: Any
    selectivity: float = field(default=1 / 3, compare=False)

    def compile(self, resolve: Resolve = named) -> Column:
        return OPERATORS[self.op][0](resolve(self.column), F.lit(self.value))

    @property
    def truth(self) -> bool | None:
        """False where no row can qualify; None where that depends on the row."""
        return False if self.value is None else None


@dataclass(frozen=True)
class Between:
    """A range on one column; either end can be open (None) or exclusive."""

    column: Any
    low: Any = None
    high: Any = None
    low_included: bool = True
    high_included: bool = True
    selectivity: float = field(default=1 / 9, compare=False)

    def compile(self, resolve: Resolve = named) -> Column:
        c, parts = resolve(self.column), []
        if self.low is not None:
            parts.append(c >= F.lit(self.low) if self.low_included else c > F.lit(self.low))
        if self.high is not None:
            parts.append(c <= F.lit(self.high) if self.high_included else c < F.lit(self.high))
        return reduce(operator.and_, parts) if parts else c.isNotNull()

    @property
    def truth(self) -> bool | None:
        if self.low is None or self.high is None:
            return None
        empty = self.low > self.high or self.low == self.high and not (self.low_included and self.high_included)
        return False if empty else None


class _Many:
    def __init__(self, *parts: Any):
        if not parts:
            raise ValueError("a conjunction or disjunction needs a part")
        self.parts = parts

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and Counter(self.parts) == Counter(other.parts)

    def __hash__(self) -> int:
        return hash((type(self), frozenset(Counter(self.parts).items())))

    def __repr__(self) -> str:
        return f"{type(self).__name__}{self.parts}"


class And(_Many):
    """All parts hold. Order doesn't matter for the result; the most selective part is put first."""

    def compile(self, resolve: Resolve = named) -> Column:
        return reduce(operator.and_, [p.compile(resolve) for p in sorted(self.parts, key=lambda p: getattr(p, "selectivity", 1.0))])

    @property
    def truth(self) -> bool | None:
        told = [p.truth for p in self.parts]
        return False if False in told else True if all(told) else None

    @property
    def selectivity(self) -> float:
        return reduce(operator.mul, [getattr(p, "selectivity", 1.0) for p in self.parts])


class Or(_Many):
    """Any part holds."""

    def compile(self, resolve: Resolve = named) -> Column:
        return reduce(operator.or_, [p.compile(resolve) for p in self.parts])

    @property
    def truth(self) -> bool | None:
        told = [p.truth for p in self.parts]
        return True if True in told else False if all(t is False for t in told) else None

    @property
    def selectivity(self) -> float:
        return 1 - reduce(operator.mul, [1 - getattr(p, "selectivity", 1.0) for p in self.parts])


@dataclass(frozen=True)
class JoinAtom:
    """left column op right column"""

    left: Any
    op: str
    right: Any

    def compile(self, left: Resolve, right: Resolve) -> Column:
        return OPERATORS[self.op][0](left(self.left), right(self.right))

    @property
    def equi(self) -> bool:
        return self.op == "="

    def switched(self) -> JoinAtom:
        return JoinAtom(self.right, switch_sides(self.op), self.left)


class JoinAnd(_Many):
    """All parts hold; an equality join if all parts are equalities."""

    def compile(self, left: Resolve, right: Resolve) -> Column:
        return reduce(operator.and_, [p.compile(left, right) for p in self.parts])

    @property
    def equi(self) -> bool:
        return all(p.equi for p in self.parts)

    def switched(self) -> JoinAnd:
        return JoinAnd(*[p.switched() for p in self.parts])


class JoinOr(_Many):
    """Any part holds; never an equality join."""

    equi = False

    def compile(self, left: Resolve, right: Resolve) -> Column:
        return reduce(operator.or_, [p.compile(left, right) for p in self.parts])

    def switched(self) -> JoinOr:
        return JoinOr(*[p.switched() for p in self.parts])
