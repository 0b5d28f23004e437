"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts whose labels are not looked at are the unlabelled.  A linear
classifier over the words that a text holds, over beginnings of words, so that inflected forms count together, and over
those that it holds twice, minimises the class-prior-corrected risk
``prior * P[loss(f)] + max(0, U[loss(-f)] - prior * P[loss(-f)])``; where the second part falls below zero,
its gradient is reversed.  The sample that is fitted on is bounded by parameters.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, renamed, ship, stored, tidy, valued, with_column

_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the beginnings of words that are features.
STEMS = range(4, 9)
#: Words whose features a worker keeps.
_KNOWN = 200_000


#: Ends the name of a feature that a text holds at least twice.
TWICE = "#2"


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def features_of(word: str) -> list[str]:
    """The word, and its beginnings with a hyphen."""
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) > k)]


def held_features(words: Counter, known: dict[str, tuple[str, ...]], names: set[str] | dict[str, float]) -> set[str]:
    """Those of ``names`` that words hold; ``known`` keeps what each word adds to."""
    times: dict[str, int] = {}
    for w, n in words.items():
        got = known.get(w)
        if got is None:
            got = known[w] = tuple(f for f in features_of(w) if f in names or f + TWICE in names)
        for f in got:
            times[f] = times.get(f, 0) + n
    return {f for f in times if f in names} | {f + TWICE for f, n in times.items() if n > 1 and f + TWICE in names}


def _all_features(words: str) -> Column:
    """The same for an array of words, each once."""
    stems = ", ".join(f"case when char_length(w) > {k} then concat(left(w, {k}), '-') end" for k in STEMS)
    return F.expr(f"array_distinct(filter(flatten(transform({words}, w -> array(w, {stems}))), f -> f is not null))")


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def found(self, text: str | None) -> set[str]:
        """The features with weights that a text holds."""
        if len(self.known) > _KNOWN:
            self.known.clear()
        return held_features(words_of(text), self.known, self.weights)

    def logit(self, text: str | None) -> float:
        return self.bias + sum(map(self.weights.__getitem__, sorted(self.found(text))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix as float32, and how often each one stands in it: most texts hold the same few features, or none."""
    if not rows.shape[1]:
        return np.zeros((min(1, len(rows)), 0), np.float32), np.full(min(1, len(rows)), len(rows), np.float32)
    keys = np.packbits(rows, axis=1) if rows.dtype == bool else rows
    _, first, n = np.unique(np.ascontiguousarray(keys).view(np.dtype((np.void, keys.dtype.itemsize * keys.shape[1]))).ravel(), return_index=True, return_counts=True)
    return rows[first].astype(np.float32), n.astype(np.float32)


def nnpu_risk(theta: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, of_p: np.ndarray, of_u: np.ndarray, beta: float = 0.0, gamma: float = 1.0) -> tuple[float, float, np.ndarray]:
    """The part of the risk that positives give, the corrected part (not below -``beta`` in the risk), and the gradient of a
    step: that of the whole risk, or where the corrected part falls below -``beta`` that of its rise, times ``gamma``.
    Rows count ``of_p`` and ``of_u``, which sum to 1; ``theta`` ends with the bias."""
    p, u = positive @ theta[:-1] + theta[-1], unlabelled @ theta[:-1] + theta[-1]
    gain = prior * float(of_p @ np.logaddexp(0, -p))
    rest = float(of_u @ np.logaddexp(0, u)) - prior * float(of_p @ np.logaddexp(0, p))
    gp, gu = of_p * _sigmoid(p), of_u * _sigmoid(u)  # of loss(-f); loss(f) has gradient sigmoid(f) - 1
    negative = np.append(gu @ unlabelled - prior * (gp @ positive), gu.sum() - prior * gp.sum())
    if rest < -beta:
        return gain, rest, -gamma * negative
    return gain, rest, negative + prior * np.append((gp - of_p) @ positive, (gp - of_p).sum())


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1000, rate: float = 0.05, decay: float = 1e-5, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier, by Adam on the non-negative risk with the logistic loss."""
    d = positive.shape[1]
    positive, of_p = _distinct(positive)
    unlabelled, of_u = _distinct(unlabelled)
    of_p, of_u = of_p / of_p.sum(), of_u / of_u.sum()
    theta, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    theta[d] = np.log(prior / (1 - prior))
    for step in range(1, rounds + 1):
        _, _, grad = nnpu_risk(theta, positive, unlabelled, prior, of_p, of_u, beta, gamma)
        grad[:d] += decay * theta[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:d], float(theta[d])


def screen(positive: np.ndarray, unlabelled: np.ndarray, prior: float, price: float = 10.0, share: float = 0.002, least: int = 4) -> list[int]:
    """Features that tell something: of those of which positives explain all that unlabelled texts hold, within a standard
    error, each one; and of the others, one after the other, those that tell something new.

    Of texts that no chosen feature holds yet, a feature gains the share of all texts that it finds among
    positives, less ``price`` times what unlabelled texts hold beyond that (and beyond a standard error).  It must
    find a ``share`` of the positives, and ``least`` of them.
    """
    n, k, d = len(positive), len(unlabelled), positive.shape[1]
    floor = max(least, share * n)
    (p, of_p), (u, of_u) = _distinct(positive), _distinct(unlabelled)
    a, b = of_p @ p, of_u @ u
    chosen = np.flatnonzero((a >= floor) & ((b - np.sqrt(b)) / k <= prior * a / n)).tolist()
    left_p, left_u = ~p[:, chosen].any(1), ~u[:, chosen].any(1)
    while d > len(chosen):
        new = of_p[left_p] @ p[left_p]
        right = prior * new / n
        held = of_u[left_u] @ u[left_u]
        wrong = np.maximum((held - np.sqrt(held)) / k - right, 0)
        gain = np.where(new >= floor, right - price * wrong, 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        chosen.append(best)
        left_p &= p[:, best] == 0
        left_u &= u[:, best] == 0
    return chosen


def fit(names: list[str], positive: list[list[str]], unlabelled: list[list[str]], prior: float) -> Model:
    """A model over those of the features ``names`` that pass ``screen``, from the ones that each text holds.  ``prior`` is
    lowered to what the unlabelled texts allow: labels may be given to toxic texts more often than to others."""
    if not names or not positive or not unlabelled:
        return Model({}, float(np.log(prior / (1 - prior))))
    place = {w: k for k, w in enumerate(names)}

    def matrix(rows: list[list[str]]) -> np.ndarray:
        m = np.zeros((len(rows), len(names)), bool)
        for k, words in enumerate(rows):
            m[k, [place[w] for w in words]] = True
        return m

    p, u = matrix(positive), matrix(unlabelled)
    # of features that the same texts hold the longest, which is the least likely to be met by chance
    longest: dict[bytes, int] = {}
    for c, column in enumerate(np.packbits(np.concatenate([p, u]), axis=0).T):
        at = longest.setdefault(column.tobytes(), c)
        if (len(names[c]), names[c]) > (len(names[at]), names[at]):
            longest[column.tobytes()] = c
    kept = sorted(longest.values())
    chosen = [kept[c] for c in screen(p[:, kept], u[:, kept], prior)]
    if chosen:
        # positives hold the features as often as toxic unlabelled texts do, so their share there bounds the prior
        prior = min(prior, max(u[:, chosen].any(1).mean(), 1 / len(u)) / p[:, chosen].any(1).mean())
    weights, bias = fit_nnpu(p[:, chosen].astype(np.float32), u[:, chosen].astype(np.float32), prior)
    return Model(dict(zip((names[k] for k in chosen), weights.tolist())), bias)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [words_of(t) for t in b.column("text").to_pylist()]
        rows = [sorted(c) for c in counts]
        times = [[min(c[w], 2) for w in r] for c, r in zip(counts, rows)]
        yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(rows, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int8()))], ["toxic", "words", "times"])


def _held(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        asked = set(names)
        for b in batches:
            held = [sorted(held_features(Counter(dict(zip(w, n))), known, asked)) for w, n in zip(b.column("words").to_pylist(), b.column("times").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(held, pa.list_(pa.string()))], ["toxic", "words"])

    return run


def learn(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 12_000, prior: float | None = None, vocabulary: int = 1000, least: int = 4, explained: float = 0.4) -> Model:
    """Fits on at most ``positives`` toxic texts and ``unlabelled`` others, neither from held-out rows.

    The features looked at are those that ``least`` positives hold, so much more often than the others that among all
    such features chance would give about one, and of whose use by the others positives explain the part ``explained``;
    the ``vocabulary`` ones that are least likely by chance (so the model has a bounded size), and the same held
    twice.  The prior is the share of toxic ones among the labels that may be learnt from,
    unless given.  Rows are chosen by a hash of their ids.  Labels that are null count as none; without
    positives every score is the prior.
    """
    ship(docs.sparkSession)
    rows = renamed(docs, doc_id=F.col("doc_id").cast("long"), text="text").where(~held_out(F.col("doc_id")))
    known = renamed(labels, doc_id=F.col("doc_id").cast("long"), toxic=F.col("toxic").cast("int")).where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        mean = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
        prior = float(np.clip(0.1 if mean is None else mean, 0.001, 0.5))
    mixed = F.xxhash64("doc_id", F.lit(5))
    toxic = known.where("toxic = 1").orderBy(mixed).limit(positives).select("doc_id", F.lit(1).alias("toxic"))
    # the unlabelled stand for all texts, toxic ones among them
    others = rows.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(6))).limit(unlabelled).distinct().select("doc_id", F.lit(0).alias("toxic"))
    chosen = toxic.unionAll(others)  # at most positives + unlabelled ids
    # of rows that share an id, the one with the smallest text: the choice must not depend on the order of rows
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stored(texts.select("toxic", "text").mapInArrow(_sets, "toxic int, words array<string>, times array<tinyint>"), "toxicity-sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    n, k = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not k:
        return fit([], [], [], prior)
    held = sample.select("toxic", F.explode(_all_features("words")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    held = stored(held.where(F.col("a") >= least), "toxicity-features")
    sure = math.log(max(2, held.count()))
    # a Poisson tail: how unlikely so many positives would hold a word if they were like the others
    usual = n * (F.col("b") + 1) / (k + 1)
    held = held.withColumn("z", F.col("a") * F.log(F.col("a") / usual) - (F.col("a") - usual))
    told = (F.col("a") > usual) & (F.col("z") >= sure) & (prior * F.col("a") / n >= explained * F.col("b") / k)
    names = [r[0] for r in held.where(told).orderBy(F.desc("z"), "word").limit(vocabulary).collect()]
    names += [f + TWICE for f in names]
    few = sample.select("toxic", "words", "times").mapInArrow(_held(names), "toxic int, words array<string>").toArrow()
    # the matrix of the fit has at most positives + unlabelled rows, and 2 * vocabulary columns of a byte
    flags, found = few.column("toxic").to_pylist(), few.column("words").to_pylist()
    order = sorted(range(len(flags)), key=lambda i: (flags[i], found[i]))
    return fit(names, [found[i] for i in order if flags[i]], [found[i] for i in order if not flags[i]], prior)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            logits = np.array([model.logit(t) for t in b.column("text").to_pylist()], np.float64)
            yield b.append_column("value", pa.array(_sigmoid(logits)))
        model.known.clear()
        tidy()

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name`` between 0 and 1; null and empty texts get the score of no words."""
    return with_column(docs, text, name, "double", _score(model))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, in its whole text.

    Repeated rows and null ids (held out) give a row each; an empty table gives none.  Only doc_id and
    text of ``docs`` are read, and only the text is scored.
    """
    model = learn(docs, labels, **sample)
    rows = score(renamed(docs, doc_id="doc_id", text="text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample) -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more; the others keep all their columns, whatever their
    names.  Null and empty texts hold no word and stay unless the prior is that high; repeated rows are judged alike."""
    return valued(docs, "text", "double", _score(learn(docs, labels, **sample))).where(F.col("value") < threshold).drop("value").toDF(*docs.columns)
