"""The format ``lake`` of ``readStream``, rows as commits appended them, with snapshot ids as offsets; and of ``read``, the
rows of a version.

Spark runs sources in Python processes of their own, which may not have this library, so this module is sent
along by value and reads the log's files itself.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: The column of the operation: I, or D for a row that takes its key away.
OPERATION = "_op"


def _numbers(root: str, kind: str) -> list[int]:
    """Ids of a table's snapshots or schemas."""
    folder = os.path.join(root, kind)
    return sorted(int(n.rpartition("-")[2]) for n in os.listdir(folder) if n.startswith(kind + "-")) if os.path.isdir(folder) else []


def _load(root: str, kind: str, number: int) -> dict:
    with open(f"{root}/{kind}/{kind}-{number}", encoding="utf-8") as f:
        return json.load(f)


def _fields(root: str) -> list[dict]:
    return _load(root, "schema", _numbers(root, "schema")[-1])["fields"]


class _File(InputPartition):
    def __init__(self, path: str, columns: list[tuple[str, str]]):
        self.path, self.columns = path, columns


def _batches(path: str, wanted: list[str]) -> Iterator:
    """Record batches of a data file with those of the wanted columns that it has."""
    if path.endswith(".orc"):
        from pyarrow import orc

        file = orc.ORCFile(path)
        held = set(file.schema.names)
        for k in range(file.nstripes):
            yield file.read_stripe(k, columns=[c for c in wanted if c in held])
        return
    import pyarrow.parquet as pq

    with pq.ParquetFile(path) as file:
        held = set(file.schema_arrow.names)
        yield from file.iter_batches(columns=[c for c in wanted if c in held])


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, after: int, changes: bool, schema: StructType):
        self.root, self.after, self.changes, self.schema = root, after, changes, schema

    def initialOffset(self) -> dict:
        return {"snapshot": self.after}

    def latestOffset(self) -> dict:
        return {"snapshot": max([self.after, *_numbers(self.root, "snapshot")])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        columns = [(f"f{f['id']}", f["name"]) for f in _fields(self.root)]
        found = []
        for n in range(start["snapshot"] + 1, end["snapshot"] + 1):
            snapshot = _load(self.root, "snapshot", n)
            if snapshot["kind"] == "OVERWRITE":
                raise ValueError(f"snapshot {n} is an overwrite")
            if snapshot["kind"] == "APPEND":
                with open(f"{self.root}/manifest/{snapshot['delta']}", encoding="utf-8") as lines:
                    entries = [json.loads(x) for x in lines]
                files = [e["file"] for e in entries if e["kind"] == "ADD"]
                if not self.changes and any(f.get("tombstones") for f in files):
                    raise ValueError(f"snapshot {n} deletes rows; the option changes=true gives them with their operation in {OPERATION}")
                found += [_File(f"{self.root}/{f['path']}", columns) for f in files]
        return found

    def read(self, partition: _File) -> Iterator:
        return _rows(partition, self.schema, self.changes)


def _rows(partition: _File, schema: StructType, changes: bool) -> Iterator:
    """A file's rows under the names of ``schema``; columns that it lacks are null."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)
    for batch in _batches(partition.path, [*(s for s, _ in partition.columns), *[OPERATION] * changes]):
        held = set(batch.schema.names)
        columns = [batch.column(s).cast(wanted.field(n).type) if s in held else pa.nulls(batch.num_rows, wanted.field(n).type) for s, n in partition.columns]
        if changes:
            columns.append(batch.column(OPERATION).cast(pa.string()).fill_null("I") if OPERATION in held else pa.array(["I"] * batch.num_rows, pa.string()))
        yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class _Batch(DataSourceReader):
    """A version's files, less those that pushed filters rule out by least and most."""

    def __init__(self, root: str, snapshot: int | None, schema: StructType):
        self.root, self.snapshot, self.schema, self.tests = root, snapshot, schema, []

    def pushFilters(self, filters: list) -> list:
        kinds = {EqualTo: (True, True), GreaterThan: (False, True), GreaterThanOrEqual: (False, True), LessThan: (True, False), LessThanOrEqual: (True, False)}
        for f in filters:
            given = list(f.value) if isinstance(f, In) else [f.value] if type(f) in kinds else []
            if given and len(f.attribute) == 1 and len({type(v) for v in given}) == 1 and type(given[0]) in (int, str):
                below, above = kinds.get(type(f), (True, True))
                self.tests.append((f.attribute[0], min(given, key=_ordered), max(given, key=_ordered), below, above))
        return filters  # Spark tests every row again

    def partitions(self) -> list[InputPartition]:
        numbers = _numbers(self.root, "snapshot")
        if not numbers:
            return []
        schema = _load(self.root, "schema", _numbers(self.root, "schema")[-1])
        ids = {f["name"]: str(f["id"]) for f in schema["fields"]}
        active: dict[str, dict] = {}
        for m in _load(self.root, "snapshot", numbers[-1] if self.snapshot is None else self.snapshot)["manifests"]:
            with open(f"{self.root}/manifest/{m}", encoding="utf-8") as lines:
                for e in map(json.loads, lines):
                    if e["kind"] == "ADD":
                        active[e["file"]["path"]] = e["file"]
                    else:
                        active.pop(e["file"]["path"], None)
        files = list(active.values())
        if schema["primary_key"] and (any(f.get("tombstones") for f in files) or len({f.get("sequence", 0) for f in files}) > 1):
            raise ValueError("rows of several commits have to be merged by key; compact the table fully, or read it through a Catalog")
        columns = [(f"f{f['id']}", f["name"]) for f in schema["fields"]]
        return [_File(f"{self.root}/{f['path']}", columns) for f in files if all(_may_hold(f, ids[n], *rest) for n, *rest in self.tests if n in ids)]

    def read(self, partition: _File) -> Iterator:
        return _rows(partition, self.schema, False)


def _ordered(v):
    return v.encode() if isinstance(v, str) else v


def _may_hold(file: dict, column: str, low, high, below: bool, above: bool) -> bool:
    """Whether a file's range reaches a value's: ``below`` if its least must not exceed ``high``, ``above`` the other way."""
    least, most = file.get("least", {}).get(column), file.get("most", {}).get(column)
    if type(least) is not type(low) or type(most) is not type(low):
        return True
    return not (below and _ordered(least) > _ordered(high) or above and _ordered(most) < _ordered(low))


class LakeSource(DataSource):
    """``readStream.format("lake").option("path", root of a table).option("after", snapshot)``, for warehouses that
    the driver and executors can open as files.

    ``spark.read`` gives the rows of the latest version, or of the option ``snapshot``, and takes filters for choosing files;
    tables whose commits have to be merged are read through a catalog.  In streams ``option("changes", "true")`` adds the column ``_op``: I for rows that came, D for rows whose key went.  Without
    it, a snapshot with deletions is an error, and an overwrite (or a rollback) always is.
    """

    @classmethod
    def name(cls) -> str:
        return "lake"

    def _changes(self) -> bool:
        return str(self.options.get("changes", "false")).lower() == "true"

    def schema(self) -> str:
        fields = ", ".join(f"`{f['name']}` {f['type']}" for f in _fields(self.options["path"]))
        return f"{fields}, {OPERATION} string" if self._changes() else fields

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("after", 0)), self._changes(), schema)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options["snapshot"]) if "snapshot" in self.options else None, schema)


def register_source(spark: SparkSession) -> None:
    """Also lets Spark hand filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LakeSource)
