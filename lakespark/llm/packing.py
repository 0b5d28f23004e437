"""Best-fit packing of token sequences by hierarchical merging of what stays underfull.

Each task encodes its documents, cuts those that are too long, and packs the pieces best-fit decreasing.
Bins that are nearly full are final.  The others become items: groups of them meet in fewer tasks, round by
round, and are packed best-fit again, until one task holds them all or a round saves next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import renamed, scratch, ship, tidy
from .tokens import crc32, encoder, gathered

#: Distinct chunks that a worker keeps, and characters that it encodes at once: other stages have used the same workers.
CACHE, CHARACTERS = 400_000, 4_000_000
BINS = "sequence_id long, size int, doc_id array<long>, piece array<int>, start array<long>, length array<int>, ids_crc32 array<long>"
_LISTS = ("doc_id", "piece", "start", "length", "ids_crc32")
_TYPES = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64()}


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each bin, best-fit decreasing: an item goes where the least room remains."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r is set if some bin has room r
    bins: list[list[int]] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
            bins[b].append(k)
        else:
            free, b = capacity, len(bins)
            bins.append([k])
        left = free - size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bins


def _batch(ids: list[int], sizes: list[int], lists: dict[str, list[list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(lists[c], pa.list_(_TYPES[c])) for c in _LISTS)], ["sequence_id", "size", *_LISTS])


def _ids(turn: int, n: int, at: int) -> list[int]:
    """Numbers that no other task or round gives."""
    first = (turn << 56) | (TaskContext.get().partitionId() << 32) | at
    return list(range(first, first + n))


def _first(tokenizer: str, end: int, capacity: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, given = encoder(tokenizer, CACHE), 0
        held: list[tuple] = []

        def pack() -> pa.RecordBatch:
            nonlocal held, given
            bins = best_fit(np.array([p[3] for p in held], np.int64), capacity)
            lists = {c: [[held[k][i] for k in b] for b in bins] for i, c in enumerate(_LISTS)}
            out = _batch(_ids(0, len(bins), given), [sum(x) for x in lists["length"]], lists)
            given += len(bins)
            held = []
            return out

        for docs, texts in gathered(batches, CHARACTERS):
            for first, last, ids, counts in own.encode_in_blocks(texts, CHARACTERS):
                ids = np.insert(ids, np.cumsum(counts), end)
                ends = np.cumsum(counts + 1)
                for doc, stop, n in zip(docs[first:last], ends.tolist(), (counts + 1).tolist()):
                    mine = ids[stop - n : stop]
                    at = piece = 0
                    while at < n:
                        size = (n - at) % capacity or capacity  # only the first piece can be shorter
                        held.append((doc, piece, at, size, crc32(mine[at : at + size])))
                        at, piece = at + size, piece + 1
                if len(held) >= pieces:
                    yield pack()
        if held:
            yield pack()
        tidy()

    return run


def _again(turn: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        # a fixed order, so that a task that runs again gives the same bins
        rows = rows.sort_by([("size", "descending"), ("sequence_id", "ascending")])
        bins = best_fit(rows.column("size").to_numpy(), capacity)
        whole = {c: rows.column(c).to_pylist() for c in _LISTS}
        sizes = rows.column("size").to_pylist()
        for at in range(0, len(bins), 10_000):
            part = bins[at : at + 10_000]
            yield _batch(_ids(turn, len(part), at), [sum(sizes[k] for k in b) for b in part], {c: [[x for k in b for x in whole[c][k]] for b in part] for c in _LISTS})

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = b.column("length").value_lengths().to_numpy(zero_copy_only=False)
        flat = {c: b.column(c).flatten() for c in _LISTS}
        sizes = flat["length"].to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(counts)), counts)
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        before = ends - sizes
        yield pa.RecordBatch.from_arrays(
            [flat["doc_id"], flat["piece"], flat["start"], pa.array(sizes), flat["ids_crc32"], pa.array(b.column("sequence_id").to_numpy()[of]), pa.array(before - before[first[of]] if len(of) else before)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, slack: int = 2, group: int = 50_000, pieces: int = 200_000, gain: float = 0.001, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end``; only longer ones are cut, into pieces of ``capacity`` of which the
    first may be shorter.  Bins with at most ``slack`` tokens of room are final.  ``group`` bounds the bins
    that meet in a task of a later round, ``pieces`` the pieces that a task of the first one holds at once.  Rounds go on
    until one group is left or a round closes less than the part ``gain`` of the open bins.  A text's cost is in proportion to its length.
    Null and empty texts are the end id alone; repeated rows and null ids are packed like others; an empty
    table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = renamed(docs, doc_id=F.col(f"`{key}`").cast("long"), text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    made = rows.mapInArrow(_first(tokenizer, end, capacity, pieces), BINS)
    final: list[DataFrame] = []
    left = turn = 0
    while True:
        path = scratch(spark, f"bins-{turn}")
        made.write.parquet(path)
        bins = spark.read.schema(BINS).parquet(path)
        open_bins = bins.where(F.col("size") < capacity - slack)
        before, left = left, open_bins.count()
        groups = -(-left // group)
        done = left < 2 or (turn > 0 and (tasks == 1 or left > (1 - gain) * before))
        final.append(bins if done else bins.where(F.col("size") >= capacity - slack))
        if done:
            break
        turn, tasks = turn + 1, groups
        made = open_bins.repartition(groups, "sequence_id").mapInArrow(_again(turn, capacity), BINS)
    whole = final[0]
    for more in final[1:]:
        whole = whole.unionAll(more)
    return whole.mapInArrow(_pieces, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
