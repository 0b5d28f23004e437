"""From rows to data files: checks, order of keys, partitions, and statistics of what was written."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, Unsupported
from ..metadata.files import DataFile
from ..metadata.schema import Schema, bucketed
from ..functions.values import bucket
from .read import FORMATS, OPERATION, merge_rows

_PLAIN = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Hive's name for the directory of null.
_NULL = "__HIVE_DEFAULT_PARTITION__"
#: Most values of a bitmap index.
BITMAP = 256


def conform(rows: DataFrame, schema: Schema) -> DataFrame:
    """Rows under the table's names and types, in its order; columns left out are null; nulls where none may be fail the write."""
    given = {c.lower(): c for c in rows.columns}
    if unknown := [c for c in rows.columns if c.lower() not in {n.lower() for n in schema.names} and c != OPERATION]:
        raise SchemaError(f"no fields {unknown}")
    columns = []
    for f in schema.fields:
        c = F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)
        c = c.cast(f.data_type)
        if not f.nullable:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"null in {f.name}, which is NOT NULL")).cast(f.data_type)).otherwise(c)
        columns.append(c.alias(f.name))
    if OPERATION in rows.columns:
        columns.append(F.upper(F.col(OPERATION)).alias(OPERATION))
    return rows.select(*columns)


def indexed(schema: Schema) -> dict[str, set[str]]:
    """Index kinds (bloom, minmax, bitmap) of fields, from both spellings of the options."""
    kinds = {"bloom-filter": "bloom", "bloom_filter": "bloom", "bloomfilter": "bloom", "min-max": "minmax", "min_max": "minmax", "minmax": "minmax", "bitmap": "bitmap"}
    found: dict[str, set[str]] = {n: set() for n in schema.names}
    for k, v in schema.options.items():
        parts = k.split(".")
        if k == "file.index.all":
            for name in found:
                found[name] |= {kinds[x.strip().lower()] for x in v.split(",") if x.strip().lower() in kinds}
        elif len(parts) == 4 and parts[:2] == ["file", "index"] and parts[2] in found and str(v).lower() == "true" and parts[3] in kinds:
            found[parts[2]].add(kinds[parts[3]])
        elif len(parts) == 3 and parts[0] == "index" and parts[2] == "type" and parts[1] in found:
            found[parts[1]] |= {kinds[x.strip().lower()] for x in v.split(",") if x.strip().lower() in kinds}
    return found


#: The folder of a bucket.
_BUCKET = "_bucket"


def _plain(schema: Schema) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.data_type, _PLAIN)]


def latest_of_batch(rows: DataFrame, schema: Schema, sequence: str | None = None) -> DataFrame:
    """One row of each key: the last by the sequence field, or else by place in the input.

    Without partition keys, rows are parted by ranges of the key here: the same shuffle then serves the
    window and the order of the files.
    """
    order = f"`{sequence}`" if sequence else "_row"
    if not sequence:
        rows = rows.withColumn("_row", F.monotonically_increasing_id())
    if not schema.partition_keys:
        rows = rows.repartitionByRange(*[F.col(f"`{k}`") for k in schema.primary_key])
    rows = merge_rows(rows, list(schema.primary_key), [F.col(order)])
    return rows if sequence else rows.drop("_row")


def write_files(rows: DataFrame, root: str, schema: Schema, store, dealt: bool = False, files: int | None = None) -> list[DataFile]:
    """Writes conforming rows (unique by key, if there is one) and tells what each file holds.

    Rows of a primary-key table, and of tables with the option ``cluster-by``, are parted by ranges, so
    that files can be told apart by their least and most keys; ``dealt`` tells that this has been done.
    """
    spark = rows.sparkSession
    batch = uuid.uuid4().hex
    staged = f"{root}/_staging/{batch}"
    tombstones = OPERATION in rows.columns
    keys = [c.strip() for c in schema.options.get("cluster-by", "").split(",") if c.strip()] or list(schema.primary_key)
    by, buckets = bucketed(schema)
    order = [F.col(f"`{k}`") for k in dict.fromkeys([*schema.partition_keys, *keys])]
    if buckets:
        # a file for each bucket of a partition; adaptive execution splits large ones
        rows = rows.withColumn(_BUCKET, bucket(by, buckets)).hint("rebalance", _BUCKET, *schema.partition_keys).sortWithinPartitions(_BUCKET, *order)
    elif keys and not dealt:
        rows = (rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    elif schema.partition_keys and not dealt:
        # few files for each partition; adaptive execution splits large partitions
        rows = rows.hint("rebalance", *schema.partition_keys)
    elif files and not dealt:
        rows = rows.repartition(files)
    folders = [*([_BUCKET] if buckets else []), *schema.partition_keys]
    data = rows.select(*[F.col(f"`{f.name}`").alias(f.stored) for f in schema.fields], *([F.col(OPERATION)] if tombstones else []), *([F.col(_BUCKET)] if buckets else []), *[F.col(f"`{k}`").cast("string").alias(k) for k in schema.partition_keys])
    indexes = indexed(schema)
    writer = data.write.option("maxRecordsPerFile", schema.options.get("target-file-rows", "5000000"))
    for name in schema.names:
        if "bloom" in indexes[name]:
            stored = schema[name].stored
            # a column whose pages are all in a dictionary gets no bloom filter
            writer = writer.option(f"parquet.bloom.filter.enabled#{stored}", "true").option(f"parquet.enable.dictionary#{stored}", "false")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{stored}", schema.options.get("bloom.ndv", "1000000"))
    if folders:
        writer = writer.partitionBy(*folders)
    kind = schema.options.get("file.format", "parquet").lower()
    if kind not in FORMATS:
        raise Unsupported(f"data files in {kind!r}; known: {FORMATS}")
    writer.format(kind).save(staged)
    sizes = {p: n for p, n in store.sizes(staged).items() if p.endswith(f".{kind}")}
    if not sizes:
        store.delete(staged)
        return []
    found = _statistics(spark, staged, schema, indexes, kind)
    made = []
    for path, size in sizes.items():
        *folders, name = path.split("/")
        stats = found.get(path)
        if not stats or not stats["rows"]:
            continue
        spec = {k: None if v == _NULL else unquote(v) for k, _, v in (x.partition("=") for x in folders)}
        number = int(spec.pop(_BUCKET)) if buckets else 0
        target = "/".join(["data", *folders, f"{batch[:8]}-{name}"])
        store.move(f"{staged}/{path}", f"{root}/{target}")
        made.append(DataFile(path=target, size=size, schema_id=schema.id, partition=spec, tombstones=tombstones, bucket=number, buckets=buckets, **stats))
    store.delete(staged)
    return made


def _statistics(spark, staged: str, schema: Schema, indexes: dict[str, set[str]], kind: str) -> dict[str, dict]:
    """Rows of each file, and least, most, nulls and few values of its indexed and key fields: one pass over those columns."""
    plain = _plain(schema)
    ranged = [n for n in plain if "minmax" in indexes[n] or n in schema.primary_key or n in schema.options.get("cluster-by", "")]
    ranged += [n for n in plain if n in schema.partition_keys and n not in ranged]
    bitmaps = [n for n in plain if "bitmap" in indexes[n]]
    struct = T.StructType([T.StructField(schema[n].stored, schema[n].data_type) for n in dict.fromkeys([*ranged, *bitmaps])])
    rows = spark.read.schema(struct).option("recursiveFileLookup", "true").format(kind).load(staged)
    wanted = [F.count("*").alias("rows")]
    for n in ranged:
        s, c = schema[n].stored, F.col(schema[n].stored)
        wanted += [F.min(c).alias(f"{s}-least"), F.max(c).alias(f"{s}-most"), F.count(c).alias(f"{s}-count")]
    for n in bitmaps:
        c = F.col(schema[n].stored)
        wanted += [F.approx_count_distinct(c).alias(f"{schema[n].stored}-distinct"), F.count(c).alias(f"{schema[n].stored}-held")]
    path = F.col("_metadata.file_path").alias("file")
    told = list(rows.groupBy(path).agg(*wanted).toLocalIterator())
    # sets of values are gathered only where an estimate says that they are small
    sets: dict[str, dict] = {}
    few = {n: [r["file"] for r in told if r[f"{schema[n].stored}-distinct"] <= 1.25 * BITMAP] for n in bitmaps}
    if any(few.values()):
        value = lambda n: F.collect_set(F.when(path.isin(few[n]), F.col(schema[n].stored))).alias(schema[n].stored)
        sets = {r["file"]: r.asDict() for r in rows.groupBy(path).agg(*[value(n) for n in bitmaps if few[n]]).toLocalIterator()}
    found = {}
    for r in told:
        d = {"rows": r["rows"], "least": {}, "most": {}, "nulls": {}, "values": {}}
        for n in ranged:
            s, k = schema[n].stored, str(schema[n].id)
            d["nulls"][k] = r["rows"] - r[f"{s}-count"]
            low, high = r[f"{s}-least"], r[f"{s}-most"]
            if low is not None and high is not None and not (isinstance(high, float) and high != high):
                d["least"][k], d["most"][k] = low, high
        for n in bitmaps:
            s, k = schema[n].stored, str(schema[n].id)
            d["nulls"][k] = r["rows"] - r[f"{s}-held"]
            if r["file"] in few[n] and len(sets[r["file"]][s]) <= BITMAP:
                d["values"][k] = sorted(sets[r["file"]][s])
        found[unquote(r["file"]).rpartition(f"/{staged.rpartition('/')[2]}/")[2]] = d
    return found
