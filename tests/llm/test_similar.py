"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline as cp
import numpy as np
from conftest import DATA
from lakespark.llm import shingles


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_heads(rows):
    sets, top = [plain_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for j, y in enumerate(sets):
        for i, x in enumerate(sets[:j]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {rows[k][0] for k in range(len(rows)) if find(k) == k}


def edited_copies():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(500)]
    shared = rng.choices(vocabulary, k=40)  # a notice that many texts hold
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 200)) + (shared if rng.random() < 0.7 else [])
        for edits in (0, rng.randint(0, 3), rng.randint(1, 8)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_every_similar_pair_is_found(spark, documents):
    rows = edited_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [plain_shingles(t) for _, t in rows]
    near = {frozenset((shingles.shingles(rows[i][1]).tobytes(), shingles.shingles(rows[j][1]).tobytes())) for j in range(len(rows)) for i in range(j) if sets[i] != sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    for limits in ({}, {"often": 2, "most": 100, "share": 1}):
        assert {r.doc_id for r in shingles.one_of_each_similar(df, **limits).collect()} == plain_heads(rows)
    # with nothing joined before, all pairs come from the first members
    held = spark.createDataFrame([(k, shingles.shingles(t).tolist(), shingles._counts(shingles.shingles(t))) for k, t in rows], "digest long, members array<long>, counts binary").dropDuplicates(["members"])
    apart = shingles._all_apart(shingles.first_rows(held, often=5), spark.createDataFrame([], "node long, component long"), shingles.LEAST)
    assert near and shingles.confirmed(held, shingles.stored(apart, "pairs")).count() == len(near)
    assert {r.doc_id for r in cp.near_duplicates(spark, df, DATA).collect()} == plain_heads(rows)
    rows = sorted((r.doc_id, r.text) for r in documents.collect())
    assert {r.doc_id for r in cp.near_duplicates(spark, documents, DATA).collect()} == plain_heads(rows)


def test_large_groups_of_near_copies(spark):
    """Texts that each differ from one text, and more from each other, are one group; the links of both ends are found."""
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(2000)]
    rows = []
    for group in range(3):
        base = rng.choices(vocabulary, k=180)
        for _ in range(80):
            copy = list(base)
            for at in rng.sample(range(180), rng.randint(0, 3)):
                copy[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = shingles.one_of_each_similar(df, often=10).collect()
    assert {r.doc_id for r in kept} == plain_heads(rows) and len(kept) < 100


def test_counts_rule_out_no_similar_pair():
    rng = random.Random(5)
    for n in (1, 7, 300, 4000, 90_000):
        members = [rng.getrandbits(64) - (1 << 63) for _ in range(n + n // 3 + 1)]
        x, y = (np.array(sorted(m), np.int64) for m in (members[:n], members[n // 3 :]))
        cx, cy = shingles._counts(x), shingles._counts(y)
        assert (cx is None) == (n == 90_000)
        if cx is not None and cy is not None:
            assert np.minimum(np.frombuffer(cx, np.uint8), np.frombuffer(cy, np.uint8)).sum() >= len(np.intersect1d(x, y))


def test_odd_rows(spark, odd, none):
    kept = shingles.one_of_each_similar(odd)
    assert kept.columns == odd.columns and shingles.one_of_each_similar(none).count() == 0
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert got == [1, 2, 3, 6, 8, 9, None]


def test_repeated_ids(spark):
    a, b = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    near = a.replace("a30", "x")
    rows = [(1, a), (3, near), (3, b), (9, b), (9, a), (None, b), (4, "few words"), (4, "few words")]
    kept = shingles.one_of_each_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in kept) == [(1, a), (3, b), (4, "few words")]
