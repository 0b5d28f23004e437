"""Values of partitions and buckets."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_value(rows: DataFrame, name: str) -> Column:
    """Text of a partition value: ``yyyy-MM-dd`` for times in fields named dt or date, ``HH`` for hour, else the
    value's own; ``null`` for null."""
    kind = rows.schema[name].dataType.typeName()
    c = F.col(f"`{name}`")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        if name in ("dt", "date"):
            c = F.date_format(c, "yyyy-MM-dd")
        elif name == "hour":
            c = F.date_format(c, "HH")
    return F.coalesce(c.cast("string"), F.lit("null"))


def with_time_partitions(rows: DataFrame, time: str, day: str = "dt", hour: str | None = None) -> DataFrame:
    """Adds the day (and the hour) of a time field as text."""
    c = F.col(f"`{time}`")
    rows = rows.withColumn(day, F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("null")))
    return rows.withColumn(hour, F.coalesce(F.date_format(c, "HH"), F.lit("null"))) if hour else rows


def bucket(columns: list[str], buckets: int) -> Column:
    """The bucket of a key, from 0: of the MD5 of its fields as text the first 32 bits, modulo the number of buckets, so
    that any engine can tell it; null fields are empty."""
    whole = F.concat_ws("\x01", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    return F.pmod(F.conv(F.substring(F.md5(whole.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def bucket_of(values: list, buckets: int) -> int | None:
    """The same for whole numbers and text; None for others, whose text isn't certain."""
    if not all(isinstance(v, (int, str)) and not isinstance(v, bool) for v in values):
        return None
    return int(hashlib.md5("\x01".join(map(str, values)).encode()).hexdigest()[:8], 16) % buckets
