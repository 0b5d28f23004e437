"""Predicates over rows with two truth values, and over partitions.

A comparison with a null field or a null literal is false, except ``ne``, which is then true.  SQL text
has SQL's three values instead; see ``lakespark.sql``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    def column(self) -> Column:
        raise NotImplementedError

    def parts(self) -> list["Predicate"]:
        """What must all hold."""
        return [self]

    def fields(self) -> set[str]:
        raise NotImplementedError

    def __and__(self, other: "Predicate") -> "Predicate":
        return And((self, other))

    def __or__(self, other: "Predicate") -> "Predicate":
        return Or((self, other))

    def __invert__(self) -> "Predicate":
        return Not(self)


_COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Compare(Predicate):
    field: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in _COMPARE:
            raise ValueError(self.op)

    def column(self) -> Column:
        if self.value is None:
            return F.lit(self.op == "ne")
        return F.coalesce(getattr(_named(self.field), _COMPARE[self.op])(F.lit(self.value)), F.lit(self.op == "ne"))

    def fields(self) -> set[str]:
        return {self.field}


@dataclass(frozen=True)
class In(Predicate):
    """Null is among the values if they hold None."""

    field: str
    values: tuple

    def column(self) -> Column:
        found = F.coalesce(_named(self.field).isin([v for v in self.values if v is not None]), F.lit(False))
        return found | _named(self.field).isNull() if None in self.values else found

    def fields(self) -> set[str]:
        return {self.field}


@dataclass(frozen=True)
class IsNull(Predicate):
    field: str

    def column(self) -> Column:
        return _named(self.field).isNull()

    def fields(self) -> set[str]:
        return {self.field}


@dataclass(frozen=True)
class And(Predicate):
    of: tuple[Predicate, ...]

    def column(self) -> Column:
        whole = F.lit(True)
        for p in self.of:
            whole = whole & p.column()
        return whole

    def parts(self) -> list[Predicate]:
        return [x for p in self.of for x in p.parts()]

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.of))


@dataclass(frozen=True)
class Or(Predicate):
    of: tuple[Predicate, ...]

    def column(self) -> Column:
        whole = F.lit(False)
        for p in self.of:
            whole = whole | p.column()
        return whole

    def fields(self) -> set[str]:
        return set().union(*(p.fields() for p in self.of))


@dataclass(frozen=True)
class Not(Predicate):
    of: Predicate

    def column(self) -> Column:
        return ~self.of.column()

    def fields(self) -> set[str]:
        return self.of.fields()


def eq(field: str, value) -> Predicate:
    return Compare(field, "eq", value)


def ne(field: str, value) -> Predicate:
    return Compare(field, "ne", value)


def gt(field: str, value) -> Predicate:
    return Compare(field, "gt", value)


def ge(field: str, value) -> Predicate:
    return Compare(field, "ge", value)


def lt(field: str, value) -> Predicate:
    return Compare(field, "lt", value)


def le(field: str, value) -> Predicate:
    return Compare(field, "le", value)


def is_in(field: str, values: Sequence) -> Predicate:
    return In(field, tuple(values))


def is_null(field: str) -> Predicate:
    return IsNull(field)


def between(field: str, low, high) -> Predicate:
    return ge(field, low) & le(field, high)


class PartitionPredicate:
    """Over a partition's values, which are strings and compare as such; a key that is absent or null matches nothing."""

    def __init__(self, test, column):
        self.test, self.column = test, column

    def __call__(self, spec: dict[str, str | None]) -> bool:
        return self.test(spec)

    def __and__(self, other: "PartitionPredicate") -> "PartitionPredicate":
        return PartitionPredicate(lambda s: self(s) and other(s), lambda: self.column() & other.column())

    def __or__(self, other: "PartitionPredicate") -> "PartitionPredicate":
        return PartitionPredicate(lambda s: self(s) or other(s), lambda: self.column() | other.column())

    def __invert__(self) -> "PartitionPredicate":
        return PartitionPredicate(lambda s: not self(s), lambda: ~self.column())

    @staticmethod
    def _on(key: str, test, column) -> "PartitionPredicate":
        def holds(spec: dict[str, str | None]) -> bool:
            value = spec.get(key)
            return value is not None and test(str(value).encode())

        return PartitionPredicate(holds, lambda: F.coalesce(column(_named(key).cast("string")), F.lit(False)))

    @classmethod
    def equal(cls, key: str, value: str) -> "PartitionPredicate":
        return cls._on(key, lambda v: v == str(value).encode(), lambda c: c == str(value))

    @classmethod
    def is_in(cls, key: str, values: Sequence[str]) -> "PartitionPredicate":
        held = {str(v).encode() for v in values}
        return cls._on(key, lambda v: v in held, lambda c: c.isin([str(v) for v in values]))

    @classmethod
    def greater(cls, key: str, value: str) -> "PartitionPredicate":
        return cls._on(key, lambda v: v > value.encode(), lambda c: c > value)

    @classmethod
    def at_least(cls, key: str, value: str) -> "PartitionPredicate":
        return cls._on(key, lambda v: v >= value.encode(), lambda c: c >= value)

    @classmethod
    def less(cls, key: str, value: str) -> "PartitionPredicate":
        return cls._on(key, lambda v: v < value.encode(), lambda c: c < value)

    @classmethod
    def at_most(cls, key: str, value: str) -> "PartitionPredicate":
        return cls._on(key, lambda v: v <= value.encode(), lambda c: c <= value)

    @classmethod
    def between(cls, key: str, low: str, high: str) -> "PartitionPredicate":
        return cls.at_least(key, low) & cls.at_most(key, high)

    @classmethod
    def prefix(cls, key: str, start: str) -> "PartitionPredicate":
        return cls._on(key, lambda v: v.startswith(start.encode()), lambda c: c.startswith(start))

    @classmethod
    def always(cls, value: bool) -> "PartitionPredicate":
        return cls(lambda _: value, lambda: F.lit(value))

    @classmethod
    def of(cls, spec: dict[str, str]) -> "PartitionPredicate":
        whole = cls.always(True)
        for k, v in spec.items():
            whole = whole & cls.equal(k, v)
        return whole
