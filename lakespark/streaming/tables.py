"""Tables as ends of streams.

A sink publishes each micro-batch once: the query's name and the batch's number mark its commit, and a
replayed batch finds it.  ``follow`` hands each new version's rows to a function as an ordinary DataFrame.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..errors import Unsupported
from ..metadata.log import APPEND, OVERWRITE
from ..operators.background import Compactor
from ..table import Table


def sink(table: Table, query: str, sequence: str | None = None, watermark: Callable[[DataFrame], int | None] | None = None, compact_at: int = 0, compactor: Compactor | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: upserts into a primary-key table (a column ``_op`` can delete), or appends.

    ``compact_at`` rewrites a primary-key table once so many commits hold overlapping keys, beside the next batches if
    there is a ``compactor``.
    """

    def publish(rows: DataFrame, batch: int) -> None:
        table.write(rows, sequence=sequence, user=query, identifier=batch, watermark=watermark(rows) if watermark else None)
        if compact_at and table.needs_compaction(compact_at):
            if compactor:
                compactor.submit(table, least=compact_at)
            else:
                table.compact(least=compact_at)

    return publish


def follow(table: Table, use: Callable[[DataFrame, int], None], after: int = 0, state: str | None = None, changes: bool = False) -> int:
    """Gives the rows of each snapshot after ``after`` to ``use``, with the snapshot's id; returns the last one.

    ``state`` names a file that keeps how far this came, so a later call goes on from there.
    """
    if state and table.store.exists(state):
        after = json.loads(table.store.read(state))["snapshot"]
    for n in table.log.snapshot_ids():
        if n > after:
            s = table.log.snapshot(n)
            if s.kind == OVERWRITE:
                raise Unsupported(f"snapshot {n} is an overwrite")
            if s.kind == APPEND:
                use(table.read_incremental(n - 1, n, changes), n)
            after = n
            if state:
                table.store.write(state, json.dumps({"snapshot": n}))
    return after
