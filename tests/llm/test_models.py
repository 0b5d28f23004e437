"""Toxicity, quality and personal data."""

import random

import brute
import numpy as np
import pytest
from conftest import DATA, ROWS
from lakespark.llm import pii, quality, toxicity

BIGGER = "/root/testdata/sf0.1"


def accuracy(spark, scored, column):
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    right = [r for r in rows if r[column] == r.predicted]
    return len(right) / len(rows), rows


def test_toxicity_held_out(spark):
    documents = spark.read.parquet(f"{BIGGER}/documents.parquet")
    got = toxicity.toxicity(documents, spark.read.parquet(f"{BIGGER}/labels.parquet")).cache()
    right, rows = accuracy(spark, got, "toxic")
    assert right > 0.97 and sum(r.predicted > r.toxic for r in rows) < 0.01 * len(rows)
    assert got.count() == documents.count()
    assert all(r.held_out == brute.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.limit(500).collect())


def test_quality_held_out(spark):
    documents = spark.read.parquet(f"{BIGGER}/documents.parquet")
    got = quality.quality(documents, spark.read.parquet(f"{BIGGER}/labels.parquet"), documents=1500).cache()
    right, rows = accuracy(spark, got, "quality")
    assert right > 0.97 and sum(r.predicted < r.quality for r in rows) < 0.02 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.limit(500).collect())


def test_odd_rows(spark, odd, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    blank = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for run in (toxicity.toxicity, quality.quality):
        for given in (labels, blank, blank.limit(0)):
            got = run(odd, given).collect()
            assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in ROWS)
            assert all(r.held_out for r in got if r.doc_id is None)
            assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1  # null is empty
            assert run(none, given).count() == 0
    kept = toxicity.remove_toxic(odd, blank)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_held_out_labels_are_not_learnt(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    from lakespark.llm.common import held_out
    from pyspark.sql import functions as F

    lying = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out(F.col("doc_id")), 0).otherwise(F.col("quality")))
    for run in (toxicity.toxicity, quality.quality):
        assert sorted(map(tuple, run(documents, labels).collect())) == sorted(map(tuple, run(documents, lying).collect()))


def test_nnpu_finds_the_positive_direction():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 6)) < 0.1).astype(float)
    toxic = rng.random(4000) < 0.2
    x[toxic, 0] = rng.random(toxic.sum()) < 0.95
    x[~toxic, 0] = 0
    w, b = toxicity.fit_nnpu(x[toxic][:300], x, 0.2)
    predicted = x @ w + b > 0
    assert (predicted == (x[:, 0] > 0)).mean() > 0.98 and w[0] > 3 * np.abs(w[1:]).max()


def test_few_labels(spark):
    """At sf0.001, ten toxic texts may be learnt from; at sf0.01, 45: words that hardly any text holds otherwise are found."""
    for sf, found, wrong in (("sf0.001", 6, 2), ("sf0.01", 33, 10)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
        assert sum(r.predicted == r.toxic == 1 for r in rows) >= found and sum(r.predicted > r.toxic for r in rows) <= wrong
        held = [r for r in rows if r.held_out and r.toxic == 1]
        assert sum(r.predicted for r in held) >= 0.6 * len(held)


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_nnpu_gradient_is_the_risks_slope(shift):
    """In both branches, against differences; distinct rows count as often as they stand."""
    rng = np.random.default_rng(3)
    p, u, prior = rng.random((40, 5)) < 0.5, rng.random((90, 5)) < 0.3, 0.9 if shift else 0.4
    theta = np.append(rng.normal(0, 0.3, 5), -shift)
    theta[:5] += shift / 2
    (dp, np_), (du, nu) = toxicity._distinct(p), toxicity._distinct(u)
    given = (dp, du, prior, np_ / 40, nu / 90)
    gain, rest, grad = toxicity.nnpu_risk(theta, *given)
    f = lambda rows: rows @ theta[:5] + theta[5]
    assert np.isclose(gain, prior * np.log1p(np.exp(-f(p))).mean()) and np.isclose(rest, np.log1p(np.exp(f(u))).mean() - prior * np.log1p(np.exp(f(p))).mean())
    assert (rest < 0) == (shift > 0)
    for k in range(6):
        a, b = theta.copy(), theta.copy()
        a[k], b[k] = a[k] + 1e-5, b[k] - 1e-5
        (ga, ra, _), (gb, rb, _) = toxicity.nnpu_risk(a, *given), toxicity.nnpu_risk(b, *given)
        slope = ((ga + ra) - (gb + rb)) / 2e-5 if rest >= 0 else -(ra - rb) / 2e-5
        assert np.isclose(grad[k], slope, atol=1e-5)


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x, counts, y = rng.standard_normal((9, 5)).astype(np.float32), np.array([2, 4, 3]), np.array([1, 0, 1], np.float32)
    m = quality.fit(x, counts, y, hidden=4, gate=3, epochs=1, batch=9, rate=0.0)

    def loss():
        s = m.scores(x, counts)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    before = {k: v.copy() for k, v in m.p.items()}
    step = quality.fit(x, counts, y, hidden=4, gate=3, epochs=200, batch=9, rate=0.02).scores(x, counts)
    assert -np.mean(y * np.log(step) + (1 - y) * np.log(1 - step)) < 0.2 * loss() and all((before[k] == m.p[k]).all() for k in before)
    assert np.allclose(np.add.reduceat(m.forward(x, counts)["a"], [0, 2, 6]), 1)


def test_passages():
    x, counts = quality.passages([None, "", "a" * 1025, "A b!\n" * 3])
    assert counts.tolist() == [1, 1, 2, 1] and x.shape == (5, quality.FEATURES) and np.isfinite(x).all() and (x[:2] == 0).all()


KINDS = pii.KINDS


def test_base_spans():
    rng = random.Random(1)
    texts = ["".join(rng.choices("a1@.+- (0)5é9", k=rng.randint(0, 40))) for _ in range(5000)] + [t or "" for _, t in ROWS]
    texts += ["1" * 5000 + ".1.1.1", "0000000.00.1.255", "a@b.c@d.e", "x@y@z.com", "a.b@c", "@a.b", "4111 1111-1111 1111 1", "+1 (555) 010-9999+2 000 000 0000"]
    for t in texts:
        assert [(a, KINDS[k], z) for a, k, z in pii.base_spans(t)] == sorted(brute.personal(t), key=lambda s: (s[0], KINDS.index(s[1]))), t


def test_model_finds_entities():
    model = pii.fit(pii.sentences())
    right = wrong = missed = 0
    for text, entities in pii.sentences(300, seed=77):
        got = set(model.spans(text))
        right, wrong, missed = right + len(got & set(entities)), wrong + len(got - set(entities)), missed + len(set(entities) - got)
    assert right > 50 * (wrong + missed)
    assert model.spans("no data in here, nor 3.14 or 2024-01-15") == []
    text = "please call (415) 555-0132 today"
    assert [text[a:z] for a, k, z in model.spans(text) if KINDS[k] == "phone"] == ["(415) 555-0132"]


def test_decoding_is_the_best_segmentation():
    model = pii.fit(pii.sentences(60))
    model.next_to = -0.7

    def best(text, run):
        found = {(i, j): (s, z, got) for i, j, s, z, got in pii.segments(text, run)}

        def go(i, after):
            if i == len(run):
                return 0.0, []
            options = [go(i + 1, False)]
            for (a, j), (s, z, got) in found.items():
                if a == i:
                    for k in range(len(KINDS)):
                        value, rest = go(j, True)
                        options.append((value + model.score(k, got) + (model.next_to if after else 0), [(s, k, z), *rest]))
            return max(options, key=lambda o: o[0])

        return go(0, False)

    for text, _ in pii.sentences(40, seed=5):
        for run in pii.runs(text):
            if len(run) < 7:
                assert model.decode(text, run) == best(text, run)[1]


def test_personal_data(spark, odd, none, documents):
    for df, rows in ((odd, ROWS), (documents, [(r.doc_id, r.text) for r in documents.collect()])):
        got = pii.find_personal_data(df).collect()
        want = []
        for i, t in rows:
            base = brute.personal(t)
            want.append((i, *(sum(k == x for _, k, _ in base) for x in KINDS), brute.sha(brute.listed(base, KINDS))))
        assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
        by = {(r.doc_id, r.base_sha256): r.spans for r in got}
        for (i, t), w in zip(rows, want):
            assert set(brute.listed(brute.personal(t), KINDS).split(",")) <= set(by[i, w[-1]].split(",")) | {""}
    assert pii.find_personal_data(none).count() == 0


def test_added_spans_overlap_no_base():
    model = pii.fit(pii.sentences(100))
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(s[0] for s in (pii.sentences(3, seed=rng.randint(0, 10**6))))
        base, every = pii.find(text, model)
        assert [s for s in every if s in base] == base and every == sorted(every)
        for s in set(every) - set(base):
            assert all(z <= s[0] or s[2] <= a for a, _, z in base)


@pytest.mark.parametrize("digits, ok", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(digits, ok):
    assert pii.luhn(digits) is ok and brute.luhn(digits) is ok
