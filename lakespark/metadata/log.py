"""The log of a table's branch: snapshots, manifests, schemas, and the commit protocol."""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from ..errors import CommitConflict, SchemaError, SnapshotMissing
from .files import DataFile, read_entries, write_entries
from .schema import Schema

APPEND, COMPACT, OVERWRITE, ANALYZE = "APPEND", "COMPACT", "OVERWRITE", "ANALYZE"


@dataclass(frozen=True)
class Snapshot:
    """``manifests``: a base that holds all files active then, and the changes since; the last one is this commit's."""

    id: int
    schema_id: int
    kind: str
    user: str
    identifier: int
    time_millis: int
    manifests: tuple[str, ...]
    delta: str
    total_rows: int
    delta_rows: int
    watermark: int | None = None
    properties: dict[str, str] = field(default_factory=dict)
    #: The largest number that a user has given a commit of a kind, of users that number theirs.
    numbered: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class CommitOptions:
    """How often and how long a commit is tried, and after how many changes a base is written."""

    retries: int = 50
    wait: float = 0.1
    most_wait: float = 30.0
    timeout: float = 600.0
    base_every: int = 30


#: Manifests never change, so they are kept by full path.
_manifests: dict[str, list[tuple[str, DataFile]]] = {}
_MANIFESTS = 1000


class Log:
    def __init__(self, store, root: str, options: CommitOptions = CommitOptions()):
        self.store, self.root, self.options = store, root, options

    # schemas

    def schema_ids(self) -> list[int]:
        return sorted(int(n.removeprefix("schema-")) for n in self.store.names(f"{self.root}/schema"))

    def schema(self, number: int | None = None) -> Schema:
        ids = self.schema_ids()
        if not ids or number is not None and number not in ids:
            raise SchemaError(f"no schema {number} in {self.root}")
        return Schema.from_json(self.store.read(f"{self.root}/schema/schema-{ids[-1] if number is None else number}"))

    def put_schema(self, schema: Schema) -> Schema:
        """Ids count from 0; two changes at once: the later one fails."""
        ids = self.schema_ids()
        schema = replace(schema, id=ids[-1] + 1 if ids else 0)
        if not self.store.create(f"{self.root}/schema/schema-{schema.id}", schema.to_json()):
            raise CommitConflict(f"schema {schema.id} was written by another")
        return schema

    # snapshots

    def snapshot_ids(self) -> list[int]:
        return sorted(int(n.removeprefix("snapshot-")) for n in self.store.names(f"{self.root}/snapshot") if n.startswith("snapshot-"))

    def latest(self) -> Snapshot | None:
        """From the number that the last commit left behind and a look for the next ones; only without it from a listing."""
        hint = f"{self.root}/snapshot/LATEST"
        told = self.store.read(hint).strip() if self.store.exists(hint) else ""
        number = int(told) if told.isdigit() else 0
        if not number or not self.store.exists(f"{self.root}/snapshot/snapshot-{number}"):
            ids = self.snapshot_ids()
            return self.snapshot(ids[-1]) if ids else None
        while self.store.exists(f"{self.root}/snapshot/snapshot-{number + 1}"):
            number += 1
        return self.snapshot(number)

    def snapshot(self, number: int) -> Snapshot:
        path = f"{self.root}/snapshot/snapshot-{number}"
        if not self.store.exists(path):
            raise SnapshotMissing(f"no snapshot {number} in {self.root}")
        d = json.loads(self.store.read(path))
        return Snapshot(**(d | {"manifests": tuple(d["manifests"])}))

    def snapshots(self) -> list[Snapshot]:
        return [self.snapshot(n) for n in self.snapshot_ids()]

    def at_time(self, millis: int) -> Snapshot:
        found = [s for s in self.snapshots() if s.time_millis <= millis]
        if not found:
            raise SnapshotMissing(f"no snapshot at or before {millis}")
        return found[-1]

    # files

    def entries(self, manifest: str) -> list[tuple[str, DataFile]]:
        path = f"{self.root}/manifest/{manifest}"
        if path not in _manifests:
            if len(_manifests) >= _MANIFESTS:
                _manifests.pop(next(iter(_manifests)))
            _manifests[path] = read_entries(self.store.read(path))
        return _manifests[path]

    def files(self, snapshot: Snapshot | None) -> dict[str, DataFile]:
        """Active files by path: additions put, deletions take away."""
        active: dict[str, DataFile] = {}
        for m in snapshot.manifests if snapshot else ():
            for kind, f in self.entries(m):
                if kind == "ADD":
                    active[f.path] = f
                else:
                    active.pop(f.path, None)
        return active

    def _put_manifest(self, name: str, entries: list[tuple[str, DataFile]]) -> str:
        name = f"{name}-{uuid.uuid4().hex}"
        self.store.write(f"{self.root}/manifest/{name}", write_entries(entries))
        return name

    # commits

    def committed(self, user: str, identifier: int, kind: str) -> Snapshot | None:
        """The snapshot of an earlier try of the same commit.  Replays can come late, so all are looked through, unless
        the number is above all that this user has given."""
        last = self.latest()
        if last is None or identifier > last.numbered.get(f"{user} {kind}", identifier - 1):
            return None
        for n in reversed(self.snapshot_ids()):
            s = self.snapshot(n)
            if (s.user, s.identifier, s.kind) == (user, identifier, kind):
                return s
        return None

    def commit(
        self,
        added: list[DataFile],
        removed: list[DataFile] | Callable[[Snapshot | None], list[DataFile]] = (),
        kind: str = APPEND,
        user: str | None = None,
        identifier: int | None = None,
        schema_id: int | None = None,
        watermark: int | None = None,
        properties: dict[str, str] | None = None,
        base: int | None = None,
        check: Callable[[Snapshot | None], None] | None = None,
        renumber: bool = True,
    ) -> Snapshot | None:
        """Publishes a snapshot; None if there was nothing to do.

        Files to remove must still be active.  ``base`` is the snapshot that the change was computed from: an
        overwrite fails if rows came or went since, unless ``removed`` is a function that looks again.
        ``check`` can reject what was published since.  Files take this commit's number as their sequence, unless they
        are compacted ones or ``renumber`` is false.  A commit that ``user`` has made with this
        ``identifier`` before isn't made again.
        """
        repeat = user is not None and identifier is not None
        user, identifier = user or uuid.uuid4().hex, time.time_ns() if identifier is None else identifier
        if repeat and (done := self.committed(user, identifier, kind)):
            return done
        if not added and not removed and kind != OVERWRITE:
            return None
        began, turn = time.monotonic(), 0
        while True:
            last = self.latest()
            active = self.files(last)
            gone = removed(last) if callable(removed) else list(removed)
            if lost := [f.path for f in gone if f.path not in active]:
                raise CommitConflict(f"files are no longer active: {lost[:3]}")
            if twice := [f.path for f in added if f.path in active]:
                raise CommitConflict(f"files are active already: {twice[:3]}")
            if kind == OVERWRITE and base is not None and last and last.id != base and not callable(removed):
                since = [self.snapshot(n) for n in self.snapshot_ids() if n > base]
                if any(s.kind != COMPACT for s in since):
                    raise CommitConflict(f"the table changed since snapshot {base}")
            if check:
                check(last)
            number = last.id + 1 if last else 1
            new = [f if kind == COMPACT or not renumber else replace(f, sequence=number) for f in added]
            entries = [("DELETE", f) for f in gone] + [("ADD", f) for f in new]
            delta = self._put_manifest(f"delta-{number}", entries)
            manifests, base_manifest = (*(last.manifests if last else ()), delta), None
            if len(manifests) > self.options.base_every:
                paths = {f.path for f in gone}
                whole = [f for p, f in active.items() if p not in paths] + new
                base_manifest = self._put_manifest(f"base-{number}", [("ADD", f) for f in whole])
                manifests = (base_manifest,)
            plus, minus = sum(f.rows for f in new), sum(f.rows for f in gone)
            numbered = dict(last.numbered) if last else {}
            if repeat:
                numbered[f"{user} {kind}"] = max(identifier, numbered.get(f"{user} {kind}", identifier))
            made = Snapshot(
                number, schema_id if schema_id is not None else last.schema_id if last else 0, kind, user, identifier, int(time.time() * 1000), manifests, delta, (last.total_rows if last else 0) + plus - minus, plus - minus, watermark, properties or {}, numbered
            )
            if self.store.create(f"{self.root}/snapshot/snapshot-{number}", json.dumps(asdict(made), indent=1)):
                # a hint alone: it may be lost, or be behind
                self.store.write(f"{self.root}/snapshot/LATEST", str(number))
                return made
            for m in filter(None, (delta, base_manifest)):
                self.store.delete(f"{self.root}/manifest/{m}")
            turn += 1
            if turn > self.options.retries or time.monotonic() - began > self.options.timeout:
                raise CommitConflict(f"gave up after {turn} tries")
            if repeat and (done := self.committed(user, identifier, kind)):
                return done
            time.sleep(min(self.options.most_wait, self.options.wait * 2 ** min(turn, 8)) * random.uniform(0.2, 1) if turn > 3 else random.uniform(0, self.options.wait))
