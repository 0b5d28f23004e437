import random
import re

import numpy as np
import pytest
import xxhash
from conftest import ROWS
from lakespark.llm import simhash
from lakespark.llm.components import components


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, within=3):
    top = list(range(len(fps)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= within:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return [find(k) for k in range(len(fps))]


def test_fingerprints(documents):
    texts = [r.text for r in documents.limit(60).collect()] + [None, "", "a", "A b", "A b C", "x " * 700, " \x1c x", "É é"]
    assert simhash.fingerprints(texts).view(np.uint64).tolist() == [plain_fingerprint(t) for t in texts]


def clustered(n, seed=0):
    rng = random.Random(seed)
    found = {rng.getrandbits(64) for _ in range(n)}
    for x in list(found)[: n // 3]:
        for _ in range(rng.randint(1, 4)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            found.add(x)
    centre = rng.getrandbits(64)
    found |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}  # a dense group
    return sorted(found)


@pytest.mark.parametrize("limits", [{}, {"homes": 40, "least": 1}, {"least": 1, "most": 1}, {"least": 4, "block": 16}])
def test_links_lose_no_component(spark, limits):
    fps = clustered(300)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    points = spark.createDataFrame([(fp,) for fp in signed], "fp long").repartition(5)
    got = {r.node: r.component for r in components(simhash.links(points, 3, **limits)).collect()}
    want = plain_components(fps)
    least: dict = {}
    for fp, g in zip(signed, want):
        least[g] = min(fp, least.get(g, fp))
    assert [got.get(fp, fp) for fp in signed] == [least[g] for g in want] and len(set(want)) < len(fps)


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3), (3, None), (9, 8), (9, 8), (8, 9)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top: dict = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = top.setdefault(a, {a}), top.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                top[k] = x
    assert got == {k: min(v) for k, v in top.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, odd, none, documents):
    for df, rows in ((odd, ROWS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        fps = [plain_fingerprint(t) for _, t in rows]
        group = plain_components(fps)
        least: dict = {}
        for (i, _), g in zip(rows, group):
            least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
        want = sorted(((i, f"{fp:016x}", least[g]) for (i, _), fp, g in zip(rows, fps, group)), key=repr)
        assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == want
    assert simhash.near_duplicates(none).count() == 0


A, NEAR_A, B = (" ".join(f"{w}{k}" for k in range(400)) for w in ("a", "a", "b"))
NEAR_A = NEAR_A.replace("a399", "x")


def test_repeated_ids_with_other_texts(spark):
    assert bin(plain_fingerprint(A) ^ plain_fingerprint(NEAR_A)).count("1") <= 3 < bin(plain_fingerprint(A) ^ plain_fingerprint(B)).count("1")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(make([(1, NEAR_A), (3, A), (3, B), (9, B)])).collect()}
    of = lambda i, t: got[i, f"{plain_fingerprint(t):016x}"]
    assert [of(1, NEAR_A), of(3, A), of(3, B), of(9, B)] == [1, 1, 3, 3]
    kept = simhash.one_of_each(make([(1, A), (3, A), (3, B), (9, B)])).collect()
    assert sorted(tuple(r) for r in kept) == [(1, A), (3, B)]
    # two rows of one id in one component: a determined one stays, whatever the partitions
    twice = [(2, A), (2, NEAR_A), (2, A), (2, B), (2, B)]
    runs = [sorted(tuple(r) for r in simhash.one_of_each(make(rows)).collect()) for rows in (twice, twice[::-1], [twice[k] for k in (2, 4, 1, 3, 0)])]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 2 and (2, B) in runs[0]


@pytest.mark.parametrize("most", [0, 250_000])
def test_rows_stay_whole_with_any_names(spark, most, monkeypatch):
    from lakespark.llm import common

    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    names = ["doc_id", "text", "id", "row", "body", "node", "component", "stays", "id_held", "row_held", "head", "c0", "c1"]
    rows = [(1, A, *[f"x{k}" for k in range(11)]), (1, A, *["y"] * 11), (1, A, *["y"] * 11), (None, A, *["z"] * 11), (4, None, *[None] * 11), (4, "", *["w"] * 11)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    kept = simhash.one_of_each(df)
    got = [tuple(r) for r in kept.collect()]
    assert kept.columns == names and len(got) == 2 and set(got) <= set(rows) and sorted(r[0] for r in got) == [1, 4]


def test_one_of_each(spark, odd, none, documents):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()), key=repr)
    # 5, 4 and 1 have no words, nor has a null id; 3 is repeated; 7 is its copy
    assert got == sorted([r for k, r in enumerate(ROWS) if r[0] in (1, 2, 3, 6, 8, 9) and k != 3 or r == (None, "no id here")], key=repr)
    heads = {r.component_id for r in simhash.near_duplicates(documents).collect()}
    assert {r.doc_id for r in simhash.one_of_each(documents).collect()} == heads
    assert simhash.one_of_each(none).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, "e f g h i"), (4, "e f g h i")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in simhash.one_of_each(nameless).collect()), key=repr) == [(4, "e f g h i"), (None, "a b c d")]
