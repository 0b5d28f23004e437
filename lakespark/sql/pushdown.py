"""Filters of queries as predicates over files.

Catalyst decides which filters reach which table: a query is bound to stand-ins that have the tables' columns and no
rows, and what its optimized plan filters right above a stand-in is read back.  Only conditions whose
truth implies that of a ``Predicate`` are taken; the query itself keeps them all, so a file is left out only
if none of its rows could pass.
"""

from __future__ import annotations

import decimal
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..metadata.schema import Schema
from ..operators.predicate import And, Compare, In, IsNull, Or, Predicate

_SIDES = {"EqualTo": ("eq", "eq"), "EqualNullSafe": ("eq", "eq"), "LessThan": ("lt", "gt"), "LessThanOrEqual": ("le", "ge"), "GreaterThan": ("gt", "lt"), "GreaterThanOrEqual": ("ge", "le")}
_SUBQUERIES = ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery", "DynamicPruningSubquery")


class StandIn:
    """Rows of none, with a table's columns; ``name`` marks them in plans."""

    def __init__(self, spark: SparkSession, schema: Schema):
        self.schema, self.name = schema, f"lake_{uuid.uuid4().hex}_"
        fields = T.StructType([T.StructField(f"{self.name}{k}", f.data_type) for k, f in enumerate(schema.fields)])
        self.rows: DataFrame = spark.createDataFrame(spark.sparkContext.emptyRDD(), fields).toDF(*schema.names)


def _each(sequence) -> list:
    found, it = [], sequence.iterator()
    while it.hasNext():
        found.append(it.next())
    return found


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _literal(e):
    """A literal's value as statistics hold it; KeyError if it can't be told."""
    if _kind(e) != "Literal" or e.value() is None:
        raise KeyError
    kind, v = T._parse_datatype_json_string(e.dataType().json()), e.value()
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return kind.fromInternal(v)
    if type(kind) is T.StringType and kind.isUTF8BinaryCollation():
        return v.toString()
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(v.toString())
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return v
    raise KeyError


def _field(e, to: StandIn) -> str:
    if _kind(e) != "AttributeReference" or not e.name().startswith(to.name):
        raise KeyError
    return to.schema.names[int(e.name()[len(to.name) :])]


def predicate(e, to: StandIn) -> Predicate | None:
    """What must hold of a row for which a Catalyst condition is true; None if nothing can be told."""
    kind = _kind(e)
    if kind == "And":
        sides = [p for c in _each(e.children()) if (p := predicate(c, to)) is not None]
        return And(tuple(sides)) if len(sides) > 1 else sides[0] if sides else None
    if kind == "Or":
        sides = [predicate(c, to) for c in _each(e.children())]
        return None if None in sides else Or(tuple(sides))
    try:
        if kind in _SIDES:
            left, right = _each(e.children())
            if _kind(left) == "Literal":
                return Compare(_field(right, to), _SIDES[kind][1], _literal(left))
            return Compare(_field(left, to), _SIDES[kind][0], _literal(right))
        if kind == "Not":
            inner = e.child()
            if _kind(inner) == "EqualTo":
                left, right = _each(inner.children())
                return Compare(_field(left, to), "ne", _literal(right))
        if kind == "In":
            return In(_field(e.value(), to), tuple(_literal(x) for x in _each(e.list())))
        if kind == "InSet":
            given = T._parse_datatype_json_string(e.child().dataType().json())
            if isinstance(given, (T.IntegralType, T.StringType)):
                return In(_field(e.child(), to), tuple(x if isinstance(x, int) else x.toString() for x in _each(e.hset()) if x is not None))
        if kind == "IsNull":
            return IsNull(_field(e.child(), to))
        if kind == "StartsWith":
            left, right = _each(e.children())
            return Compare(_field(left, to), "ge", _literal(right))
        if kind == "AttributeReference":  # a boolean field alone
            return Compare(_field(e, to), "eq", True)
    except KeyError:
        pass
    return None


def filters(rows: DataFrame, given: list[StandIn]) -> dict[str, Predicate | None]:
    """For each stand-in in the optimized plan of ``rows`` what its rows must fulfil (any of it, if it stands there several
    times); None if all its rows are asked for somewhere.  Stand-ins that the plan doesn't need are missing."""
    met: dict[str, list] = {}

    def inside(expression) -> None:
        if _kind(expression) in _SUBQUERIES:
            plan = expression.query().plan() if _kind(expression) == "InSubquery" else expression.plan() if hasattr(expression, "plan") else None
            if plan is not None:
                walk(plan, None)
        for c in _each(expression.children()):
            inside(c)

    def walk(node, above) -> None:
        kind = _kind(node)
        for e in _each(node.expressions()):
            inside(e)
        if kind == "LogicalRDD":
            names = [a.name() for a in _each(node.output())]
            for s in given:
                if any(n.startswith(s.name) for n in names):
                    met.setdefault(s.name, []).append(predicate(above, s) if above is not None else None)
        for c in _each(node.children()):
            walk(c, node.condition() if kind == "Filter" else above if kind == "Project" else None)

    walk(rows._jdf.queryExecution().optimizedPlan(), None)
    return {name: None if None in found else found[0] if len(found) == 1 else Or(tuple(found)) for name, found in met.items()}


def pruning(spark: SparkSession, schema: Schema, condition: Column | str) -> Predicate | None:
    """A predicate that holds wherever a condition over a table's fields does."""
    to = StandIn(spark, schema)
    return filters(to.rows.where(F.expr(condition) if isinstance(condition, str) else condition), [to]).get(to.name)
