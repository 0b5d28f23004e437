"""Entries of manifests, and what is known of each data file."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class DataFile:
    """``sequence`` orders files of a primary-key table: rows of a higher one win.  Statistics go by field id."""

    path: str
    rows: int
    size: int
    schema_id: int
    partition: dict[str, str | None] = field(default_factory=dict)
    sequence: int = 0
    level: int = 0
    tombstones: bool = False
    least: dict[str, object] = field(default_factory=dict)
    most: dict[str, object] = field(default_factory=dict)
    nulls: dict[str, int] = field(default_factory=dict)
    distinct: dict[str, int] = field(default_factory=dict)
    values: dict[str, list] = field(default_factory=dict)
    #: The bucket of all its keys, and of how many buckets (0: none).
    bucket: int = 0
    buckets: int = 0


def _pack(value: object) -> object:
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        return {"f": repr(value)}
    if isinstance(value, decimal.Decimal):
        return {"d": str(value)}
    if isinstance(value, datetime.datetime):
        return {"t": value.isoformat()}
    if isinstance(value, datetime.date):
        return {"e": value.isoformat()}
    if isinstance(value, (bytes, bytearray)):
        return {"b": base64.b64encode(value).decode()}
    raise TypeError(f"no statistics for {type(value)}")


def _unpack(d: dict) -> object:
    if len(d) == 1:
        (kind, text), *_ = d.items()
        if isinstance(text, str):
            if kind == "f":
                return float(text)
            if kind == "d":
                return decimal.Decimal(text)
            if kind == "t":
                return datetime.datetime.fromisoformat(text)
            if kind == "e":
                return datetime.date.fromisoformat(text)
            if kind == "b":
                return base64.b64decode(text)
    return d


def _plain(f: DataFile) -> dict:
    d = asdict(f)
    for k in ("least", "most"):
        d[k] = {c: _pack(v) for c, v in d[k].items()}
    d["values"] = {c: [_pack(v) for v in vs] for c, vs in d["values"].items()}
    return {k: v for k, v in d.items() if v not in ({}, 0, False) or k in ("rows", "size", "schema_id")}


def write_entries(entries: list[tuple[str, DataFile]]) -> str:
    """A manifest: a line for each entry, ADD or DELETE."""
    return "".join(json.dumps({"kind": kind, "file": _plain(f)}) + "\n" for kind, f in entries)


def read_entries(text: str) -> list[tuple[str, DataFile]]:
    found = []
    for line in text.splitlines():
        d = json.loads(line)
        plain = d["file"]
        for k in ("least", "most"):
            plain[k] = {c: _unpack(v) if isinstance(v, dict) else v for c, v in plain.get(k, {}).items()}
        plain["values"] = {c: [_unpack(v) if isinstance(v, dict) else v for v in vs] for c, vs in plain.get("values", {}).items()}
        found.append((d["kind"], DataFile(**plain)))
    return found
