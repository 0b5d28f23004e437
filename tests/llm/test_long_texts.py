"""Texts that are very long, or hold very many matches."""

import hashlib
import random
import time

import brute
import numpy as np
from lakespark.llm import pii, quality, secret_scan


def test_a_million_digits():
    model = pii.fit(pii.sentences(60))
    for text in ("7" * 1_000_000, "1." * 500_000, "(" * 400_000 + "1" * 20, "1 " * 300_000, "@" * 300_000, "+1" * 300_000):
        began = time.perf_counter()
        pii.find(text, model)
        assert time.perf_counter() - began < 10, text[:4]
    began = time.perf_counter()
    assert pii.base_spans("7" * 1_000_000) == []
    assert time.perf_counter() - began < 1


def test_dotted_numbers_match_four_and_four():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("0125.. x", k=rng.randint(0, 50)))
        assert [s for s in pii.base_spans(text) if s[1] == 1] == sorted((a, 1, z) for a, k, z in brute.personal(text) if k == "ip"), text


def test_many_secrets_in_a_text(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("0123456789abcdef", k=16)) if rng.random() < 0.7 else "token=" + "x" * 12 for _ in range(12_000)]
    text = " é ".join(words)
    df = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    began = time.perf_counter()
    got = secret_scan.scan(df).first()
    assert time.perf_counter() - began < 15
    base = brute.secrets(text)
    assert got.n_hex + got.n_assign == len(base) and got.base_sha256 == hashlib.sha256(brute.listed(base, secret_scan.KINDS[:3]).encode()).hexdigest()
    began = time.perf_counter()
    clean = secret_scan.redact(df).first()
    assert time.perf_counter() - began < 20
    assert clean.text == " é ".join(["[SECRET]"] * len(words)) and clean.n_chars == len(clean.text)


def test_added_spans_against_a_plain_log_ratio(spark):
    """Candidates that lie inside no base span, scored step by step."""
    import math
    import re

    rng = random.Random(7)
    texts = []
    for _ in range(150):
        pieces = [rng.choice([t for t, _ in secret_scan.labelled_samples(20, rng.randint(0, 99))] + ["token = abcdef0123456789abcd", "AKIA" + "Q1" * 9, "plain words", "0123456789abcdef0123", "ab" * 6 + "0123456789abcdef" + "Zq" * 5]) for _ in range(rng.randint(0, 6))]
        texts.append(rng.choice((" ", ", ", "\n", "=")).join(pieces))
    counts = {True: {}, False: {}}
    for t, random_one in secret_scan.labelled_samples():
        t = [c for c in t if c in secret_scan.ALPHABET]
        for a, b in zip(t, t[1:]):
            counts[random_one].setdefault(a, {}).setdefault(b, 0)
            counts[random_one][a][b] += 1
    size = len(secret_scan.ALPHABET)

    def chance(kind, a, b):
        row = counts[kind].get(a, {})
        return (row.get(b, 0) + 0.5) / (sum(row.values()) + 0.5 * size)

    def plain(text):
        base = [(a, k, z) for a, k, z in brute.secrets(text)]
        added = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            s = sum(round(1000 * math.log(chance(True, a, b) / chance(False, a, b))) for a, b in zip(m[0], m[0][1:]))
            if s >= max(8000, 250 * (len(m[0]) - 1)) and not any(a <= m.start() and m.end() <= z for a, _, z in base):
                added.append((m.start(), "random", m.end()))
        return brute.listed(base + added, secret_scan.KINDS)

    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.spans for r in rows} == {k: plain(t) for k, t in enumerate(texts)}
    assert any("random" in r.spans for r in rows)


def test_long_texts_are_scored_whole():
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("abc DE.1\n"), size=n)) for n in (0, 10, 5000, 40_000)] + [None]
    x, counts = quality.passages(texts)
    model = quality.fit(x, counts, np.array([0, 1, 0, 1, 0], np.float32), hidden=4, gate=3, epochs=2, batch=2)
    whole = model.scores(x, counts)
    before = quality.AT_ONCE
    try:
        for quality.AT_ONCE in (quality.PASSAGE, 3 * quality.PASSAGE, before):
            assert np.allclose(model.scores_of(texts), whole, atol=1e-6)
    finally:
        quality.AT_ONCE = before
    assert model.scores_of([]).shape == (0,)


def test_attention_by_hand_and_by_differences():
    rng = np.random.default_rng(1)
    x, counts, y = rng.standard_normal((9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    m = quality.fit(x.astype(np.float32), counts, y.astype(np.float32), hidden=4, gate=3, epochs=3, batch=9, rate=0.05)
    m.p = {k: np.array(v, np.float64) for k, v in m.p.items()}
    p, at, logits = m.p, 0, []
    for n in counts:
        hs, es = [], []
        for row in x[at : at + n]:
            h = np.tanh(((row - p["mean"]) / p["scale"]) @ p["W"] + p["b"])
            hs.append(h)
            es.append(sum(p["w"][k] * np.tanh(h @ p["V"][:, k]) / (1 + np.exp(-(h @ p["U"][:, k]))) for k in range(3)))
        a = np.exp(es) / np.exp(es).sum()
        logits.append(sum(w * h for w, h in zip(a, hs)) @ p["c"] + p["d"])
        at += n
    f = m.forward(x, counts)
    assert np.allclose(f["logit"], logits)

    def loss():
        z = m.forward(x, counts)["logit"]
        return np.mean(np.logaddexp(0, z) - y * z)

    for name, g in m.gradients(f, x, y).items():
        for at in np.ndindex(np.shape(g)):
            was = float(p[name][at])
            p[name][at] = was + 1e-5
            up = loss()
            p[name][at] = was - 1e-5
            down = loss()
            p[name][at] = was
            assert np.isclose(np.asarray(g)[at], (up - down) / 2e-5, atol=1e-6), (name, at)
