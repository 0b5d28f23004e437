"""Databases, tables and branches below a warehouse folder."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import BranchExists, BranchMissing, DatabaseExists, DatabaseMissing, DatabaseNotEmpty, LakeError, TableExists, TableMissing
from .identifiers import DEFAULT_DATABASE, MAIN, Identifier, check_branch, check_name
from .metadata.log import CommitOptions
from .metadata.schema import Schema, spark_type
from .metadata.store import store_for
from .table import Table

_kinds: dict[str, Callable[..., "Catalog"]] = {}


def register_catalog(kind: str, factory: Callable[..., "Catalog"]) -> None:
    """Makes a kind of catalog known to ``load_catalog``."""
    _kinds[kind] = factory


def load_catalog(spark: SparkSession, warehouse: str, kind: str = "filesystem", **options) -> "Catalog":
    if kind not in _kinds:
        raise LakeError(f"no catalog of kind {kind!r}; known: {sorted(_kinds)}")
    return _kinds[kind](spark, warehouse, **options)


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str, options: CommitOptions = CommitOptions()):
        self.spark, self.options = spark, options
        self.store, self.warehouse = store_for(spark, warehouse)
        self.store.make(self.warehouse)
        self.current = DEFAULT_DATABASE

    def _of(self, name: str | Identifier) -> Identifier:
        return name if isinstance(name, Identifier) else Identifier.parse(name, self.current)

    def _root(self, i: Identifier) -> str:
        return f"{self.warehouse}/{i.database}/{i.table}"

    # databases

    def databases(self) -> list[str]:
        return self.store.names(self.warehouse)

    def database_exists(self, name: str) -> bool:
        return self.store.exists(f"{self.warehouse}/{check_name(name)}")

    def create_database(self, name: str, if_not_exists: bool = False) -> None:
        if self.database_exists(name):
            if not if_not_exists:
                raise DatabaseExists(name)
            return
        self.store.make(f"{self.warehouse}/{name}")

    def drop_database(self, name: str, if_exists: bool = False, cascade: bool = False) -> None:
        if not self.database_exists(name):
            if not if_exists:
                raise DatabaseMissing(name)
            return
        if self.tables(name) and not cascade:
            raise DatabaseNotEmpty(name)
        self.store.delete(f"{self.warehouse}/{name}")

    def use(self, name: str) -> None:
        if not self.database_exists(name):
            raise DatabaseMissing(name)
        self.current = name

    # tables

    def tables(self, database: str | None = None) -> list[str]:
        database = database or self.current
        if not self.database_exists(database):
            raise DatabaseMissing(database)
        return [n for n in self.store.names(f"{self.warehouse}/{database}") if self.store.names(f"{self.warehouse}/{database}/{n}/schema")]

    def table_exists(self, name: str | Identifier) -> bool:
        i = self._of(name)
        return bool(self.store.names(f"{self._root(i)}/schema")) and (i.branch == MAIN or i.branch in self.branches(i))

    def create_table(self, name: str | Identifier, fields: T.StructType | str | list[tuple[str, str]], primary_key: list[str] | tuple[str, ...] = (), partitioned_by: list[str] | tuple[str, ...] = (), options: dict[str, str] | None = None, description: str = "", if_not_exists: bool = False) -> Table:
        """``fields``: a struct, DDL, or pairs of name and type (with the aliases of ``schema.ALIASES``).  The option
        ``primary-key`` names key fields too."""
        i = self._of(name)
        if i.database == DEFAULT_DATABASE:
            self.create_database(i.database, if_not_exists=True)
        if not self.database_exists(i.database):
            raise DatabaseMissing(i.database)
        if self.table_exists(i):
            if if_not_exists:
                return self.table(i)
            raise TableExists(str(i))
        if isinstance(fields, str):
            fields = T.StructType.fromDDL(fields)
        elif isinstance(fields, list):
            fields = T.StructType([T.StructField(n, spark_type(t)) for n, t in fields])
        options = dict(options or {})
        primary_key = primary_key or [k.strip() for k in options.get("primary-key", "").split(",") if k.strip()]
        schema = Schema.of(fields, primary_key, partitioned_by, options)
        table = Table(self, i, self.store, self._root(i), self.options)
        table.log.put_schema(schema)
        told = {"name": i.table, "database": i.database, "type": schema.kind, "created": int(time.time() * 1000), "description": description}
        self.store.write(f"{self._root(i)}/metadata.json", json.dumps(told, indent=1))
        return table

    def metadata(self, name: str | Identifier) -> dict:
        t = self.table(name)
        told = json.loads(self.store.read(f"{t.root}/metadata.json"))
        last = t.log.latest()
        return told | {"schema_id": t.schema.id, "options": t.schema.options, "modified": last.time_millis if last else told["created"]}

    def table(self, name: str | Identifier) -> Table:
        i = self._of(name)
        if not self.store.names(f"{self._root(i)}/schema"):
            raise TableMissing(str(i))
        if i.branch != MAIN and i.branch not in self.branches(i):
            raise BranchMissing(f"{i.branch} of {i}")
        return Table(self, i, self.store, self._root(i), self.options)

    def read(self, name: str | Identifier, **options) -> DataFrame:
        """A table's rows, or a system table (``t$snapshots``, ``t$files``, ...)."""
        i = self._of(name)
        t = self.table(replace(i, system=None))
        if i.system is None:
            return t.read(**options)
        if i.system == "branches":
            return self.spark.createDataFrame([(b,) for b in self.branches(i)], "branch string")
        if i.system == "options":
            return self.spark.createDataFrame(list(t.schema.options.items()), "key string, value string")
        return getattr(t, i.system)()

    def drop_table(self, name: str | Identifier, if_exists: bool = False) -> None:
        i = self._of(name)
        if not self.table_exists(i):
            if not if_exists:
                raise TableMissing(str(i))
            return
        self.store.delete(self._root(i))

    def rename_table(self, name: str | Identifier, new: str) -> Table:
        """Within a database."""
        i, to = self._of(name), self._of(new if "." in new else f"{self._of(name).database}.{new}")
        if to.database != i.database:
            raise LakeError("a table keeps its database")
        self.table(i)
        if self.table_exists(to):
            raise TableExists(str(to))
        self.store.move(self._root(i), self._root(to))
        return self.table(to)

    def alter_table(self, name: str | Identifier, fields: list[tuple[str, str]], primary_key: list[str] | None = None, partitioned_by: list[str] | None = None) -> Schema:
        """A new schema version: fields known by name keep their column, others are new, the rest goes."""
        t = self.table(name)
        schema = t.schema
        for n in [n for n in schema.names if n not in {f for f, _ in fields}]:
            schema = schema.drop(n)
        for n, kind in fields:
            schema = schema.widen(n, kind) if n in schema.names else schema.add(n, kind)
        schema = replace(schema, fields=tuple(schema[n] for n, _ in fields), primary_key=tuple(primary_key if primary_key is not None else schema.primary_key), partition_keys=tuple(partitioned_by if partitioned_by is not None else schema.partition_keys))
        return t.log.put_schema(schema)

    # branches

    def branches(self, name: str | Identifier) -> list[str]:
        return [n.removeprefix("branch-") for n in self.store.names(f"{self._root(self._of(name))}/branch")]

    def create_branch(self, name: str | Identifier, branch: str, snapshot: int | None = None, tag: str | None = None, empty: bool = False) -> Table:
        """A branch has schemas and snapshots of its own and shares data files; it begins at a snapshot, a tag, or
        the latest version, or without rows."""
        i = self._of(name)
        check_branch(branch)
        main = self.table(replace(i, branch=MAIN))
        if branch in self.branches(i):
            raise BranchExists(f"{branch} of {i}")
        t = Table(self, replace(i, branch=branch), self.store, self._root(i), self.options)
        for n in main.log.schema_ids():
            self.store.write(f"{t.log.root}/schema/schema-{n}", main.log.schema(n).to_json())
        if empty:
            return t
        if tag is not None:
            if tag not in main.tags():
                raise BranchMissing(f"no tag {tag}")
            snapshot = main.tags()[tag]
        s = main.log.snapshot(snapshot) if snapshot is not None else main.log.latest()
        if s is not None:
            base = t.log._put_manifest(f"base-{s.id}", [("ADD", f) for f in main.log.files(s).values()])
            self.store.create(f"{t.log.root}/snapshot/snapshot-{s.id}", json.dumps(asdict(replace(s, manifests=(base,), delta=base)), indent=1))
        return t

    def drop_branch(self, name: str | Identifier, branch: str) -> None:
        i = self._of(name)
        if branch not in self.branches(i):
            raise BranchMissing(f"{branch} of {i}")
        self.store.delete(f"{self._root(i)}/branch/branch-{branch}")

    def fast_forward(self, name: str | Identifier, branch: str) -> None:
        """The main branch takes over a branch's files and schemas, if it hasn't changed since the branch began."""
        i = self._of(name)
        main, t = self.table(replace(i, branch=MAIN)), self.table(replace(i, branch=branch))
        first, last = t.log.snapshot_ids()[:1], main.log.latest()
        if last and (not first or last.id != first[0]):
            raise LakeError(f"{i} changed since {branch} began")
        for n in t.log.schema_ids():
            if n not in main.log.schema_ids():
                main.log.put_schema(t.log.schema(n))
        then, now = t.log.files(t.log.latest()), main.log.files(last)
        main._replace([f for p, f in then.items() if p not in now], [f for p, f in now.items() if p not in then], last) if last else main.log.commit(list(then.values()))

    # text

    def sql(self, text: str) -> DataFrame:
        from .sql.statements import execute

        return execute(self, text)


register_catalog("filesystem", Catalog)
