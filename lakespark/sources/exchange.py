"""Import and export: files of Spark's formats into tables, and tables into them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import Unsupported
from ..metadata.log import Snapshot
from ..table import Table

FORMATS = ("parquet", "csv", "json", "orc")
#: Of CSV: a header, quotes doubled inside quotes, and ``\\N`` for null, so that empty text stays text.
CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "\\N"}


def _known(kind: str) -> None:
    if kind not in FORMATS:
        raise Unsupported(f"format {kind!r}; known: {FORMATS}")


def load(table: Table, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Rows of files under the table's schema; nothing is inferred."""
    _known(kind)
    reader = table.spark.read.schema(table.schema.struct)
    return reader.options(**((CSV if kind == "csv" else {}) | options)).format(kind).load(path)


def import_files(table: Table, path: str, kind: str = "parquet", sequence: str | None = None, **options) -> Snapshot | None:
    return table.write(load(table, path, kind, **options), sequence=sequence)


def export_files(table: Table, path: str, kind: str = "parquet", **options) -> None:
    _known(kind)
    table.read().write.options(**((CSV if kind == "csv" else {}) | options)).format(kind).save(path)
