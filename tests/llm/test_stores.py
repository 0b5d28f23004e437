"""Token counts, wavelet shards and packing."""

import random
import zlib

import numpy as np
import pytest
from conftest import ROWS
from lakespark.llm.common import scratch
from lakespark.llm.digest_cache import cached_counts, count_tokens, tokenizer_version
from lakespark.llm.packing import best_fit, pack_documents
from lakespark.llm.tokens import vocabulary_path
from lakespark.llm.wavelet import SHARDS, WaveletMatrix, read_documents, read_shard, shard_bytes, write_shards
from tokenizers import Tokenizer


def library(name):
    return Tokenizer.from_file(vocabulary_path(name))


def test_counts(spark, odd, none, documents):
    cache, tokenizer = scratch(spark, "cache"), library("byte_bpe_50k.json")
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    got = sorted(map(tuple, count_tokens(odd, "byte_bpe_50k.json", cache, limit=10).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), size(t), size(t) > 10) for i, t in ROWS), key=repr)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t in ROWS})
    assert count_tokens(odd, "byte_bpe_50k.json", cache).count() == len(ROWS) and spark.read.parquet(cache).count() == stored  # all known
    assert count_tokens(none, "byte_bpe_50k.json", scratch(spark, "cache")).count() == 0
    count_tokens(documents, "word_bpe_49k.json", cache)  # another tokenizer shares no counts
    assert cached_counts(spark, cache, tokenizer_version("byte_bpe_50k.json")).count() == stored


def test_cached_counts_are_used(spark, documents):
    from pyspark.sql import functions as F

    cache = scratch(spark, "cache")
    version = tokenizer_version("byte_bpe_50k.json")
    documents.select(F.lit(version).alias("tokenizer"), F.unhex(F.sha2("text", 256)).alias("digest"), F.lit(-7).cast("long").alias("n_tokens")).write.parquet(cache)
    assert {r.n_tokens for r in count_tokens(documents, "byte_bpe_50k.json", cache).collect()} == {-7}


@pytest.mark.parametrize("bits, n", [(1, 0), (3, 1), (3, 700), (16, 5000), (17, 513)])
def test_wavelet_matrix(bits, n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.5, n), 2**bits - 1).astype(np.uint32)
    counts = np.array([n], np.int64)
    keys, got, m = read_shard(shard_bytes([None], counts, ids, bits))
    assert keys == [None] and got.tolist() == [n] and m.decode().tolist() == ids.tolist() and m.n == n
    plain = ids.tolist()
    for at in range(0, n, 37):
        assert m.access(at) == plain[at]
    for token in {0, 1, 2, 5, 2**bits - 1, *plain[:5]}:
        places = [k for k, x in enumerate(plain) if x == token]
        assert m.occurrences(token) == places and m.count(token) == len(places)
        for a, z in ((0, n), (n // 3, n // 2), (n // 2, n // 3), (n - 1, n + 9)):
            assert m.count(token, max(a, 0), z) == sum(max(a, 0) <= p < z for p in places)
        assert m.rank(token, n // 2) == sum(p < n // 2 for p in places)
    assert m.count(2**bits) == m.count(-1) == 0
    for bad in (-1, n):
        with pytest.raises(IndexError):
            m.access(bad)
    with pytest.raises(IndexError):
        m.select(2**bits - 1, n + 1)
    with pytest.raises(ValueError):
        read_shard(b"none")


def test_shards_round_trip(spark, odd, none, documents):
    tokenizer = library("word_bpe_49k.json")
    for df, limit in ((documents, 1 << 21), (documents, 3000), (odd, 100), (none, 100)):
        path = scratch(spark, "wavelet")
        write_shards(df, path, "word_bpe_49k.json", end=2, shard_tokens=limit)
        got = read_documents(spark, path).collect()
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
        want, at = [], 0
        for i, t in rows:
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert spark.read.schema(SHARDS).parquet(path).count() == 0


def test_best_fit():
    rng = random.Random(5)
    for n in (0, 1, 500):
        sizes = np.array([rng.randint(1, 64) for _ in range(n)], np.int64)
        bins = best_fit(sizes, 64)
        assert sorted(k for b in bins for k in b) == list(range(n)) and all(sizes[b].sum() <= 64 for b in bins)
        # plain best fit decreasing
        rooms = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [k for k, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits, key=lambda k: rooms[k])] -= s
            else:
                rooms.append(64 - s)
        assert len(bins) == len(rooms)


@pytest.mark.parametrize("options", [{}, {"group": 20, "pieces": 10}, {"capacity": 16, "group": 5}])
def test_packing(spark, odd, none, documents, options):
    tokenizer, capacity = library("byte_bpe_50k.json"), options.get("capacity", 1024)
    for df in (documents, odd, none):
        got = pack_documents(df, "byte_bpe_50k.json", **options).collect()
        want = []
        for i, t in ((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()):
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            at = piece = 0
            while at < len(ids):
                n = (len(ids) - at) % capacity or capacity
                want.append((i, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                at, piece = at + n, piece + 1
        assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
        by: dict = {}
        for r in got:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in by.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(w[3] for w in want)
        assert -(-total // capacity) <= len(by) <= 1.15 * total / capacity + 12
