"""Compaction beside other work: one thread, one run for each table at a time."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from ..errors import CommitConflict
from ..metadata.log import Snapshot
from ..table import Table


class Compactor:
    """``submit`` gives a ``Future`` of the snapshot, or None where nothing was to do; a table that waits or runs already isn't
    taken again.  A run that loses to another commit is tried again, ``tries`` times; writers never wait for it."""

    def __init__(self, threads: int = 1, tries: int = 3):
        self._pool, self._tries = ThreadPoolExecutor(threads, "lakespark-compaction"), tries
        self._running: dict[str, Future] = {}
        self.counts = {"done": 0, "idle": 0, "failed": 0}

    def submit(self, table: Table, full: bool = False, least: int = 4, then: Callable[[Snapshot | None], None] | None = None) -> Future:
        now = self._running.get(table.log.root)
        if now is not None and not now.done():
            return now

        def run() -> Snapshot | None:
            for turn in range(self._tries):
                try:
                    made = table.compact(full=full, least=least)
                    break
                except CommitConflict:
                    if turn == self._tries - 1:
                        self.counts["failed"] += 1
                        raise
            self.counts["done" if made else "idle"] += 1
            if then:
                then(made)
            return made

        self._running[table.log.root] = self._pool.submit(run)
        return self._running[table.log.root]

    def wait(self) -> None:
        for f in list(self._running.values()):
            f.result()

    def close(self) -> None:
        self._pool.shutdown(wait=True)

    def __enter__(self) -> "Compactor":
        return self

    def __exit__(self, *_) -> None:
        self.close()
