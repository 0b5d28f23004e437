"""Names of tables: ``[db.]table[$branch_name][$system]``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import InvalidName

MAIN = "main"
DEFAULT_DATABASE = "default"
SYSTEM_TABLES = ("snapshots", "files", "manifests", "partitions", "schemas", "branches", "options")
_NAME = re.compile(r"[A-Za-z0-9_]+")
_BRANCH = re.compile(r"[A-Za-z0-9_-]+")


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise InvalidName(f"{name!r} must be letters, digits and underscores")
    return name


def check_branch(name: str) -> str:
    """Branch names are not ``main``, not blank, not a number, and made of letters, digits, ``_`` and ``-``."""
    if name == MAIN or not _BRANCH.fullmatch(name or "") or name.isdigit():
        raise InvalidName(f"{name!r} is no name for a branch")
    return name


@dataclass(frozen=True)
class Identifier:
    database: str
    table: str
    branch: str = MAIN
    system: str | None = None

    @classmethod
    def parse(cls, text: str, database: str = DEFAULT_DATABASE) -> "Identifier":
        parts = [p.strip().strip("`") for p in text.strip().split(".")]
        if len(parts) > 2:
            raise InvalidName(f"{text!r} has too many parts")
        db, name = (parts if len(parts) == 2 else (database, parts[0]))
        table, *marks = name.split("$")
        branch, system = MAIN, None
        for mark in marks:
            if mark.startswith("branch_") and branch == MAIN and system is None:
                branch = check_branch(mark.removeprefix("branch_"))
            elif system is None and mark in SYSTEM_TABLES:
                system = mark
            else:
                raise InvalidName(f"{text!r}: no system table {mark!r}")
        return cls(check_name(db), check_name(table), branch, system)

    def __str__(self) -> str:
        return f"{self.database}.{self.table}" + (f"$branch_{self.branch}" if self.branch != MAIN else "") + (f"${self.system}" if self.system else "")
