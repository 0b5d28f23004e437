"""Token ids in wavelet-matrix shards.

A shard holds the ids of consecutive documents as bit planes, most significant bit first.  Each plane is
stably parted by its bit, zeros first, before the next one is taken.  With counts of ones before every
512-bit block, a shard answers access, rank, select and occurrence queries, and gives back all its ids.

File format of a shard, little-endian: ``WVM1``, u32 number of planes, u64 ids, u64 documents; then
zstd frames, each after its u64 length: document ids (i64), which of them are null (u8), ids per document
(i64), and for each plane its block counts (u32) and its packed bits, in frames of ``CHUNK`` bytes.  A reader keeps the
frames as they are and unpacks those that a query asks for.
Shards are rows of a Parquet table (columns of ``SHARDS``), so that Spark's committer publishes each once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import renamed, ship, tidy
from .tokens import crc32, encoder, gathered

SHARDS = "part int, shard int, n_docs long, n_tokens long, payload binary"
BLOCK = 512
#: Distinct chunks that a writer keeps, and characters that it encodes at once.
CACHE, BLOCK_CHARACTERS = 1_000_000, 6_000_000
#: Bytes of a plane that are packed together.
CHUNK = 1 << 15
#: Bytes of text in a range of ids, as Spark estimates them, and ranges at most (their borders come to the driver).
RANGE_BYTES, RANGES = 10 << 20, 100_000


class Plane:
    """Packed bits in compressed chunks; slices unpack the chunks that they touch, the last few of which are kept."""

    def __init__(self, chunks: list[bytes], size: int):
        self.chunks, self.size, self.kept = chunks, size, {}

    def __len__(self) -> int:
        return self.size

    def _chunk(self, k: int) -> np.ndarray:
        if k not in self.kept:
            if len(self.kept) >= 4:
                self.kept.pop(next(iter(self.kept)))
            self.kept[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[k]), np.uint8)
        return self.kept[k]

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self._chunk(at // CHUNK)[at % CHUNK]
        first, last, _ = at.indices(self.size)
        parts = [self._chunk(k)[max(0, first - k * CHUNK) : last - k * CHUNK] for k in range(first // CHUNK, -(-last // CHUNK))]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint8)

    def whole(self) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        return np.frombuffer(b"".join(map(unpack, self.chunks)), np.uint8)


class WaveletMatrix:
    """Bit planes of a sequence of ids below ``2 ** bits``."""

    def __init__(self, planes: list[np.ndarray], n: int, ranks: list[np.ndarray] | None = None):
        self.planes, self.n = planes, n
        self.ranks = ranks or [self._counts(p) for p in planes]
        self.zeros = [n - self._ones(k, n) for k in range(len(planes))]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> "WaveletMatrix":
        now = np.asarray(ids, np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for shift in range(bits - 1, -1, -1):
            one = (now >> shift) & 1 != 0
            planes.append(np.packbits(one, bitorder="little"))
            now = np.concatenate([np.compress(~one, now), np.compress(one, now)])
        return cls(planes, len(ids))

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        size = BLOCK // 8
        whole = np.zeros(-(-len(plane) // size) * size, np.uint8)
        whole[: len(plane)] = plane
        return np.concatenate([[0], np.cumsum(np.bitwise_count(whole.reshape(-1, size)).sum(1, dtype=np.int64))]).astype(np.uint32)

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        block, rest = divmod(at, BLOCK)
        first = block * (BLOCK // 8)
        part = self.planes[level][first : first + -(-rest // 8)]
        ones = int(np.bitwise_count(part).sum(dtype=np.int64))
        if rest % 8:
            ones -= int(np.bitwise_count(np.uint8(part[-1] >> (rest % 8))))
        return int(self.ranks[level][block]) + ones

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8] >> (at % 8)) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(len(self.planes)):
            bit = self._bit(level, at)
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        for level in range(len(self.planes)):
            a, b = self._ones(level, first), self._ones(level, last)
            if token >> (len(self.planes) - 1 - level) & 1:
                first, last = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, last = first - a, last - b
        return first, last

    def rank(self, token: int, at: int) -> int:
        """How often an id stands before a place."""
        return self.count(token, 0, at)

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """How often an id stands in [first, last)."""
        last = self.n if last is None else min(last, self.n)
        if token < 0 or token >> len(self.planes) or first >= last:
            return 0
        a, b = self._range(token, first, last)
        return b - a

    def _find(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        counts = self.ranks[level].astype(np.int64)
        if not bit:
            counts = np.minimum(np.arange(len(counts)) * BLOCK, self.n) - counts
        block = int(np.searchsorted(counts, k, side="right")) - 1
        first = block * (BLOCK // 8)
        bits = np.unpackbits(self.planes[level][first : first + BLOCK // 8], bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def select(self, token: int, k: int) -> int:
        """Place of an id's k-th (from 0) occurrence."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, 0, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        """All places of an id."""
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            plane = self.planes[level]
            one = np.unpackbits(plane.whole() if isinstance(plane, Plane) else plane, count=self.n, bitorder="little").view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~one)] = now[: self.zeros[level]]
            above[np.flatnonzero(one)] = now[self.zeros[level] :] | now.dtype.type(1 << (len(self.planes) - 1 - level))
            now = above
        return now.astype(np.uint32)


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    matrix = WaveletMatrix.build(ids, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    frames = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8), np.asarray(counts, "<i8")]
    for plane, ranks in zip(matrix.planes, matrix.ranks):
        frames += [ranks.astype("<u4"), *(plane[at : at + CHUNK] for at in range(0, len(plane), CHUNK))]
    packed = [pack(f.tobytes()) for f in frames]
    return b"".join([b"WVM1", struct.pack("<IQQ", bits, len(ids), len(doc_ids)), *(x for p in packed for x in (struct.pack("<Q", len(p)), p))])


def read_shard(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, ids per document, and the wavelet matrix of a shard's file."""
    if data[:4] != b"WVM1":
        raise ValueError("not a wavelet-matrix shard")
    bits, n, n_docs = struct.unpack_from("<IQQ", data, 4)
    at, frames = 24, []
    unpack = zstandard.ZstdDecompressor().decompress
    size = -(-n // 8)
    chunks = -(-size // CHUNK)
    for _ in range(3 + bits * (1 + chunks)):
        (length,) = struct.unpack_from("<Q", data, at)
        frames.append(data[at + 8 : at + 8 + length])
        at += 8 + length
    keys, missing, counts = (np.frombuffer(unpack(f), kind) for f, kind in zip(frames, ("<i8", np.uint8, "<i8")))
    own = [frames[k : k + 1 + chunks] for k in range(3, len(frames), 1 + chunks)]
    ranks = [np.frombuffer(unpack(f[0]), "<u4") for f in own]
    return [None if m else k for k, m in zip(keys.tolist(), missing.tolist())], counts, WaveletMatrix([Plane(f[1:], size) for f in own], n, ranks)


def _write(tokenizer: str, end: int | None, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, shard = encoder(tokenizer, CACHE), TaskContext.get().partitionId(), 0
        bits = max(own.vocabulary - 1, end or 0, 1).bit_length()
        keys: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, counts, ids, held, shard
            n = np.concatenate(counts)
            row = [[part], [shard], [len(keys)], [int(n.sum())], [shard_bytes(keys, n, np.concatenate(ids), bits)]]
            keys, counts, ids, held, shard = [], [], [], 0, shard + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)

        names = ["part", "shard", "n_docs", "n_tokens", "payload"]
        for docs, texts in gathered(batches, BLOCK_CHARACTERS):
            for first, last, got, n in own.encode_in_blocks(texts, BLOCK_CHARACTERS):
                if end is not None:
                    got, n = np.insert(got, np.cumsum(n), end), n + 1
                keys += docs[first:last]
                counts.append(n)
                ids.append(got)
                held += len(got)
                if held >= shard_tokens:
                    yield flush()
        if keys:
            yield flush()
        tidy()

    return run


def _ranges(rows: DataFrame) -> int:
    """Ranges of ids by the bytes that Spark expects to read, and one for each core at least."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known
        return max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(RANGES, -(-size // RANGE_BYTES)))


def write_shards(docs: DataFrame, path: str, tokenizer: str, end: int | None = None, shard_tokens: int = 1 << 21, key: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts in ascending order of their ids into wavelet-matrix shards at ``path``.

    ``end`` follows each document.  Null text is empty; null ids come first; rows with the same id stay
    in the order of their texts; an empty table gives a table without shards.  A shard is closed once it
    holds ``shard_tokens`` ids; documents are never parted.  Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = renamed(docs, doc_id=F.col(f"`{key}`").cast("long"), text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    dealt = rows.repartitionByRange(_ranges(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_write(tokenizer, end, shard_tokens), SHARDS).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, shard, payload in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("payload")):
            keys, counts, matrix = read_shard(payload.as_buffer().to_pybytes())
            ids = matrix.decode()
            ends = np.cumsum(counts)
            starts = ends - counts
            sums = [crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist())]
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, shard), pa.int32()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the ids that the shards give back."""
    ship(spark)
    shards = spark.read.schema(SHARDS).parquet(path)
    # starts: within a shard, of the shard in its part, and of the part; a part is a range of ids, so they are few
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = sizes.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("n_tokens").join(parts, "part")
    docs = shards.select("part", "shard", "payload").mapInArrow(_read, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("shard_start") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
