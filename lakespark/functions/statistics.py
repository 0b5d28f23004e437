"""Statistics of columns, and how two of them add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = "column string, least string, most string, nulls long, distinct long, rows long"


def column_statistics(rows: DataFrame, exact: bool = False) -> DataFrame:
    """A row for each plain column: least and most as text, nulls, distinct values (estimated, unless ``exact``) and
    rows.  All columns are aggregated in one pass, partially before the shuffle."""
    plain = [f.name for f in rows.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    count = F.count_distinct if exact else F.approx_count_distinct
    wanted = [F.count("*").alias("rows")]
    for k, n in enumerate(plain):
        c = F.col(f"`{n}`")
        wanted += [F.min(c).cast("string").alias(f"least{k}"), F.max(c).cast("string").alias(f"most{k}"), F.count(c).alias(f"held{k}"), count(c).alias(f"distinct{k}")]
    one = rows.agg(*wanted)
    told = [F.struct(F.lit(n).alias("column"), F.col(f"least{k}").alias("least"), F.col(f"most{k}").alias("most"), (F.col("rows") - F.col(f"held{k}")).alias("nulls"), F.col(f"distinct{k}").cast("long").alias("distinct"), F.col("rows")) for k, n in enumerate(plain)]
    return one.select(F.explode(F.array(*told)).alias("s")).select("s.*")


def merged(parts: DataFrame) -> DataFrame:
    """Statistics of parts together: nulls and rows add up, distinct is the largest."""
    return parts.groupBy("column").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("nulls").alias("nulls"), F.max("distinct").alias("distinct"), F.sum("rows").alias("rows"))
