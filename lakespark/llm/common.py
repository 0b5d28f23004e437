"""What the operators of this package share: inputs, scratch tables, and columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as _ship

__all__ = ["held_out", "identified", "among", "release", "renamed", "scratch", "ship", "stored", "table", "tidy", "valued", "with_column", "without"]


#: Rows of an Arrow batch, where the session has Spark's own number: texts are long, and workers hold a batch whole.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Makes the executors' Python ready: the library's files, and batches of a size that fits long texts."""
    _ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of applications on a local master that name no shared one.
_local: dict[str, str] = {}


def _shared(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or _local.get(spark.sparkContext.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``.  Where that is unset, a temporary folder serves
    a local master; on a cluster it is an error."""
    root = _shared(spark)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lakespark-")
    return f"{root}/lakespark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes what this application has put into the shared folder; results that still read it must be written before."""
    root = _shared(spark)
    if root:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/lakespark/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to shared storage and read again: lineage ends here, so a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by 5 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def renamed(df: DataFrame, **names: str | Column) -> DataFrame:
    """Only the columns that an operator needs, under its own names, so that further columns can't clash."""
    return df.select(*((F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in names.items()))


def valued(docs: DataFrame, text: str, kind: str, batches) -> DataFrame:
    """``docs`` under plain names with a last column ``value`` that ``batches`` computes: a function of an iterator of
    record batches whose column ``text`` it is to read.  ``toDF`` gives the columns their names back, whatever they are."""
    ship(docs.sparkSession)
    plain = ["text" if c == text else f"c{k}" for k, c in enumerate(docs.columns)]
    schema = ", ".join(f"`{p}` {f.dataType.simpleString()}" for p, f in zip(plain, docs.schema))
    return docs.toDF(*plain).mapInArrow(batches, f"{schema}, value {kind}")


def with_column(docs: DataFrame, text: str, name: str, kind: str, batches) -> DataFrame:
    """``docs`` with a last column ``name``; see ``valued``."""
    return valued(docs, text, kind, batches).toDF(*docs.columns, name)


def tidy() -> None:
    """Gives memory that a worker has freed back to the system; workers live on, and the next task may need other things."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` under plain names (``c0``, ...), so that theirs can't clash, with ``id`` (the key as a long), ``body`` (the
    text) and ``row``: a hash of all columns, by which rows that share an id are told apart."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    kinds = [f.dataType.simpleString() for f in docs.schema]
    # nulls are hashed by place; maps can't be hashed
    hashes = [F.xxhash64(F.col(p).cast("string") if "map<" in k or "variant" in k else F.col(p)) for p, k in zip(plain, kinds)]
    at = {c: F.col(p) for c, p in zip(docs.columns, plain)}
    return docs.toDF(*plain).withColumns({"id": at[key].cast("long"), "body": at[text], "row": F.xxhash64(*hashes)})


#: Keys that are broadcast at most; a key is two longs.
BROADCAST_KEYS = 250_000


def _held(rows: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    few = keys.count() <= BROADCAST_KEYS
    keys = keys.select(*(F.col(c).alias(f"{c}_held") for c in on))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_held")) for c in on))
    return rows.join(F.broadcast(keys) if few else keys.hint("merge"), same, how)


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns ``on`` are not among ``keys`` (a stored table, which is counted; null equals null).  Up to
    ``BROADCAST_KEYS`` keys are broadcast, and the rows stay where they are; more are sorted and merged."""
    return _held(rows, keys, on, "left_anti")


def among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose columns ``on`` are among ``keys``; see ``without``."""
    return _held(rows, keys, on, "left_semi")
