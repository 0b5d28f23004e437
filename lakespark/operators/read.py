"""From files to rows: projection to the current schema, and latest-wins merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..metadata.files import DataFile
from ..metadata.schema import Schema
from .pruning import _order

SEQUENCE, OPERATION = "_sequence", "_op"
#: Of data files, told by their suffix.
FORMATS = ("parquet", "orc")
#: With more commits than this, a row's commit comes from a join with the names of files instead of a union.
UNION = 24
#: Rows of that join which may be broadcast; a row is a file's name and a number.
BROADCAST_FILES = 100_000


def stored_struct(schema: Schema) -> T.StructType:
    return T.StructType([T.StructField(f.stored, f.data_type) for f in schema.fields])


def _scan(spark: SparkSession, root: str, files: list[DataFile], schema: Schema, more: tuple[T.StructField, ...] = ()) -> DataFrame:
    struct = T.StructType([*stored_struct(schema).fields, *more])
    parts = [spark.read.schema(struct).format(kind).load([f"{root}/{f.path}" for f in files if f.path.endswith(f".{kind}")]) for kind in FORMATS if any(f.path.endswith(f".{kind}") for f in files)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


def _columns(schema: Schema) -> list[Column]:
    return [F.col(f.stored).alias(f.name) for f in schema.fields]


def empty(spark: SparkSession, schema: Schema) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(f.name, f.data_type) for f in schema.fields]))


def read_rows(spark: SparkSession, root: str, files: list[DataFile], schema: Schema) -> DataFrame:
    """All rows of files, by column id: columns that a file lacks are null."""
    if not files:
        return empty(spark, schema)
    return _scan(spark, root, files, schema).select(*_columns(schema))


def with_path(spark: SparkSession, root: str, files: list[DataFile], schema: Schema) -> DataFrame:
    """Rows of files as they are, with the file's path in ``_path``."""
    parts = [_scan(spark, root, own, schema).select(*_columns(schema), F.col("_metadata.file_path").alias("_path")) for kind in FORMATS if (own := [f for f in files if f.path.endswith(f".{kind}")])]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


def sections(files: list[DataFile], schema: Schema) -> tuple[list[DataFile], list[DataFile]]:
    """(files whose rows no other file can hide, the others), by ranges of the first key field.

    Files are sorted by their least key; a run of files whose ranges overlap is merged, unless all of it comes
    from one commit.  Without statistics all files are merged.  Buckets hold different keys and are told apart.
    """
    if len({f.buckets for f in files}) == 1 and files[0].buckets and len({f.bucket for f in files}) > 1:
        by: dict[int, list[DataFile]] = {}
        for f in files:
            by.setdefault(f.bucket, []).append(f)
        found = [sections(own, schema) for own in by.values()]
        return [f for alone, _ in found for f in alone], [f for _, mixed in found for f in mixed]
    if len({f.sequence for f in files}) <= 1 and not any(f.tombstones for f in files):
        return files, []
    key = str(schema[schema.primary_key[0]].id)
    if any(key not in f.least or key not in f.most or _order(f.least[key], f.most[key]) is None for f in files):
        return [], files
    import functools

    if any(_order(files[0].least[key], f.least[key]) is None for f in files):
        return [], files
    ordered = sorted(files, key=functools.cmp_to_key(lambda a, b: _order(a.least[key], b.least[key])))
    alone: list[DataFile] = []
    mixed: list[DataFile] = []
    run: list[DataFile] = []
    high = None

    def close() -> None:
        (alone if len({f.sequence for f in run}) == 1 and not any(f.tombstones for f in run) else mixed).extend(run)

    for f in ordered:
        if run and _order(f.least[key], high) > 0:
            close()
            run, high = [], None
        run.append(f)
        high = f.most[key] if high is None or _order(f.most[key], high) > 0 else high
    close()
    return alone, mixed


def with_sequence(spark: SparkSession, root: str, files: list[DataFile], schema: Schema) -> DataFrame:
    """Rows under stored names with the operation, and the number of the commit that wrote them."""
    more = (T.StructField(OPERATION, T.StringType()),) if any(f.tombstones for f in files) else ()
    numbers = sorted({f.sequence for f in files})
    if len(numbers) <= UNION:
        parts = [_scan(spark, root, [f for f in files if f.sequence == n], schema, more).withColumn(SEQUENCE, F.lit(n).cast("long")) for n in numbers]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionAll(p)
        return whole
    # files of one write that are in several partitions can share a name, and then their number
    names = spark.createDataFrame(sorted({(f.path.rsplit("/", 1)[-1], f.sequence) for f in files}), f"file string, {SEQUENCE} long")
    names = F.broadcast(names) if len(files) <= BROADCAST_FILES else names
    named = [_scan(spark, root, part, schema, more).withColumn("file", F.col("_metadata.file_name")) for kind in FORMATS if (part := [f for f in files if f.path.endswith(f".{kind}")])]
    rows = named[0]
    for p in named[1:]:
        rows = rows.unionAll(p)
    return rows.join(names, "file").drop("file")


def merge_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of a key, the one that comes last in ``order`` (its first column weighs most)."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return rows.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")


def read_merged(spark: SparkSession, root: str, files: list[DataFile], schema: Schema, keep_deleted: bool = False) -> DataFrame:
    """The latest version of each key.  Filters on key columns that are put on the result reach the scan; others don't."""
    if not files:
        return empty(spark, schema)
    alone, mixed = sections(files, schema)
    parts = [_scan(spark, root, alone, schema).select(*_columns(schema))] if alone else []
    if mixed:
        rows = with_sequence(spark, root, mixed, schema)
        merged = merge_rows(rows, [schema[k].stored for k in schema.primary_key], [F.col(SEQUENCE)])
        if OPERATION in merged.columns and not keep_deleted:
            merged = merged.where(F.coalesce(F.col(OPERATION), F.lit("I")) != "D")
        parts.append(merged.select(*_columns(schema)))
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
