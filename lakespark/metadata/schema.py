"""Versioned schemas.  A field keeps its id for life; data files name columns by it, so renames cost nothing."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

from ..errors import SchemaError

#: Column types of DDL beside Spark's own names.
ALIASES = {"INTEGER": "INT", "LONG": "BIGINT", "TEXT": "STRING", "VARCHAR": "STRING", "CHAR": "STRING", "BOOL": "BOOLEAN", "FLOAT": "DOUBLE", "TIMESTAMP": "TIMESTAMP_NTZ"}
#: Types that a column may be widened to.
WIDER = {"int": ("bigint", "double"), "bigint": (), "float": ("double",), "date": ("timestamp_ntz",)}


def spark_type(text: str) -> T.DataType:
    """A type by name: the aliases, lengths of strings ignored, or any type that Spark parses."""
    head, _, rest = text.strip().partition("(")
    name = head.strip().upper()
    if name in ("VARCHAR", "CHAR"):
        rest = ""
    return T.DataType.fromDDL(ALIASES.get(name, head.strip()) + (f"({rest}" if rest else ""))


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: str
    nullable: bool = True

    @property
    def stored(self) -> str:
        return f"f{self.id}"

    @property
    def data_type(self) -> T.DataType:
        return T.DataType.fromDDL(self.type)


@dataclass(frozen=True)
class Schema:
    id: int
    fields: tuple[Field, ...]
    primary_key: tuple[str, ...] = ()
    partition_keys: tuple[str, ...] = ()
    next_id: int = 0
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if not names:
            raise SchemaError("a table needs a field")
        if len({n.lower() for n in names}) < len(names):
            raise SchemaError(f"fields repeat: {names}")
        for what, keys in (("primary key", self.primary_key), ("partition key", self.partition_keys)):
            if missing := [k for k in keys if k not in names]:
                raise SchemaError(f"{what} {missing} is no field")
            if len(set(keys)) < len(keys):
                raise SchemaError(f"{what} repeats: {keys}")
        for n in (*self.primary_key, *self.partition_keys):
            if isinstance(self[n].data_type, (T.ArrayType, T.MapType, T.StructType)):
                raise SchemaError(f"{n} can't be a key: {self[n].type}")

    @classmethod
    def of(cls, fields: T.StructType, primary_key=(), partition_keys=(), options=None) -> "Schema":
        keys = set(primary_key)
        found = tuple(Field(k, f.name, f.dataType.simpleString(), f.nullable and f.name not in keys) for k, f in enumerate(fields))
        return cls(0, found, tuple(primary_key), tuple(partition_keys), len(found), dict(options or {}))

    def __getitem__(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        for f in self.fields:
            if f.name.lower() == name.lower():
                return f
        raise SchemaError(f"no field {name!r}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def kind(self) -> str:
        return "PRIMARY_KEY" if self.primary_key else "APPEND_ONLY"

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type, f.nullable) for f in self.fields])

    def _next(self, fields, **changes) -> "Schema":
        return replace(self, id=self.id + 1, fields=tuple(fields), **changes)

    def add(self, name: str, kind: str, nullable: bool = True, after: str | None = None) -> "Schema":
        """A new column, null in older rows."""
        if not nullable:
            raise SchemaError(f"{name}: older rows would break NOT NULL")
        new = Field(self.next_id, name, spark_type(kind).simpleString(), nullable)
        at = len(self.fields) if after is None else self.names.index(self[after].name) + 1
        return self._next([*self.fields[:at], new, *self.fields[at:]], next_id=self.next_id + 1)

    def drop(self, name: str) -> "Schema":
        gone = self[name].name
        without = lambda keys: tuple(k for k in keys if k != gone)
        if gone in self.primary_key and len(self.primary_key) == 1:
            raise SchemaError(f"{gone} is the whole primary key")
        return self._next([f for f in self.fields if f.name != gone], primary_key=without(self.primary_key), partition_keys=without(self.partition_keys))

    def rename(self, old: str, new: str) -> "Schema":
        was = self[old].name
        of = lambda keys: tuple(new if k == was else k for k in keys)
        return self._next([replace(f, name=new) if f.name == was else f for f in self.fields], primary_key=of(self.primary_key), partition_keys=of(self.partition_keys))

    def widen(self, name: str, kind: str) -> "Schema":
        f, to = self[name], spark_type(kind).simpleString()
        if to != f.type and to not in WIDER.get(f.type, ()):
            raise SchemaError(f"{name}: {f.type} can't become {to}")
        return self._next([replace(f, type=to) if x.name == f.name else x for x in self.fields])

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @classmethod
    def from_json(cls, text: str) -> "Schema":
        d = json.loads(text)
        return cls(**(d | {"fields": tuple(Field(**f) for f in d["fields"]), "primary_key": tuple(d["primary_key"]), "partition_keys": tuple(d["partition_keys"])}))


def bucketed(schema: "Schema") -> tuple[list[str], int]:
    """Fields and number of the buckets that the options ``bucket`` and ``bucket-key`` (default: the key) ask for."""
    n = int(schema.options.get("bucket", "0") or 0)
    keys = [schema[c.strip()].name for c in schema.options.get("bucket-key", "").split(",") if c.strip()] or list(schema.primary_key)
    if n > 0 and schema.primary_key and not set(keys) <= set(schema.primary_key):
        raise SchemaError("buckets of a primary-key table go by its key")
    return (keys, n) if n > 0 and keys else ([], 0)
