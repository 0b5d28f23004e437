"""Which files can't hold a row that a predicate asks for: by partition, least and most, and sets of values.

Of an OR one side must be possible; a NOT or a missing statistic keeps the file.  Files
of a primary-key table are pruned by key fields alone while newer versions of a row can be in others.
"""

from __future__ import annotations

import datetime
import decimal

from ..functions.values import bucket_of
from ..metadata.files import DataFile
from ..metadata.schema import Schema, bucketed
from .predicate import And, Compare, In, IsNull, Or, PartitionPredicate, Predicate

_NUMBERS = (int, float, decimal.Decimal)


def _order(a: object, b: object) -> int | None:
    """Sign of a - b as Spark compares them; None if that isn't certain."""
    if isinstance(a, bool) or isinstance(b, bool):
        a, b = (a, b) if isinstance(a, bool) and isinstance(b, bool) else (None, None)
    elif isinstance(a, str) and isinstance(b, str):
        a, b = a.encode(), b.encode()
    elif isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS):
        if a != a or b != b:
            return None
    elif isinstance(a, datetime.datetime) != isinstance(b, datetime.datetime):
        return None
    elif type(a) is not type(b):
        return None
    if a is None or b is None:
        return None
    if isinstance(a, datetime.datetime) and (a.tzinfo is None) != (b.tzinfo is None):
        return None
    return (a > b) - (a < b)


def _can_hold(f: DataFile, key: str, op: str, value: object) -> bool:
    if value is None:
        return op == "ne"
    if op == "ne":
        values = f.values.get(key)
        return values is None or f.nulls.get(key, 1) > 0 or any(v != value for v in values)
    if f.nulls.get(key) == f.rows:
        return False
    if op == "eq" and key in f.values and type(value) in {type(v) for v in f.values[key]}:
        return value in f.values[key]
    low, high = f.least.get(key), f.most.get(key)
    below = None if low is None else _order(low, value)
    above = None if high is None else _order(high, value)
    if op in ("eq", "lt", "le") and below is not None and (below > 0 or op == "lt" and below == 0):
        return False
    return not (op in ("eq", "gt", "ge") and above is not None and (above < 0 or op == "gt" and above == 0))


def may_match(f: DataFile, part: Predicate, schema: Schema) -> bool:
    """Whether a file can hold rows for which ``part`` is true."""
    if isinstance(part, Compare):
        return _can_hold(f, str(schema[part.field].id), part.op, part.value)
    if isinstance(part, In):
        key = str(schema[part.field].id)
        if None in part.values and f.nulls.get(key, 1) > 0:
            return True
        return any(_can_hold(f, key, "eq", v) for v in part.values if v is not None)
    if isinstance(part, IsNull):
        return f.nulls.get(str(schema[part.field].id), 1) > 0
    if isinstance(part, And):
        return all(may_match(f, p, schema) for p in part.of)
    if isinstance(part, Or):
        return any(may_match(f, p, schema) for p in part.of)
    return True


def prune(files: list[DataFile], schema: Schema, predicate: Predicate | None = None, partition: PartitionPredicate | None = None, merged: bool = False) -> list[DataFile]:
    """The files that a read with these predicates needs.  ``merged``: no file hides another's rows."""
    if partition is not None:
        files = [f for f in files if partition(f.partition)]
    if predicate is None:
        return files
    safe = set(schema.names) if merged or not schema.primary_key else set(schema.primary_key)
    parts = [p for p in predicate.parts() if {schema[x].name for x in p.fields()} <= safe]
    asked = {schema[p.field].name: p.value for p in parts if isinstance(p, Compare) and p.op == "eq"}
    keys, buckets = bucketed(schema)
    if buckets and set(keys) <= set(asked):
        number = bucket_of([asked[k] for k in keys], buckets)
        files = [f for f in files if number is None or f.buckets != buckets or f.bucket == number]
    return [f for f in files if all(may_match(f, p, schema) for p in parts)]
