"""Quality by attention-based multiple-instance learning.

A text is a bag of passages.  Each passage is described by the classes of its characters, one and two at a
time, and by how much it repeats itself; an encoder maps it to a hidden vector.  Gated attention, learnt
from document labels alone, weighs the passages, and the weighted mean is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, renamed, ship, tidy, with_column

#: Bytes of a passage, and of the passages that are described at once (about 50 bytes of memory each).
PASSAGE, AT_ONCE = 1024, 1 << 20
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "|", "#", "$", "%", "&", "*", "'\"`", "()[]{}<>", "-_/\\+=~^@")
_CLASSES = len(_KINDS) + 2  # and other ASCII, and bytes beyond it
_CLASS = np.full(256, len(_KINDS), np.int64)
_CLASS[128:] = len(_KINDS) + 1
for _k, _kind in enumerate(_KINDS):
    _CLASS[list(_kind.encode())] = _k
FEATURES = _CLASSES + _CLASSES**2 + 3


def passages(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of each text's; an empty text is one empty passage."""
    data = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(d) // PASSAGE)) for d in data], np.int64)
    n = int(counts.sum())
    sizes = np.array([len(d) for d in data], np.int64)
    joined = _CLASS[np.frombuffer(b"".join(data), np.uint8)]
    within = np.arange(len(joined)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    of = np.repeat(np.cumsum(counts) - counts, sizes) + within // PASSAGE
    one = np.bincount(of * _CLASSES + joined, minlength=n * _CLASSES).reshape(n, _CLASSES)
    pair = (of[:-1] * _CLASSES + joined[:-1]) * _CLASSES + joined[1:]
    two = np.bincount(pair[of[:-1] == of[1:]], minlength=n * _CLASSES**2).reshape(n, _CLASSES**2)
    length = np.maximum(one.sum(1, keepdims=True), 1)
    rest = np.zeros((n, 3), np.float32)
    k = 0
    for d in data:
        for at in range(0, max(1, len(d)), PASSAGE):
            parts = d[at : at + PASSAGE].split()
            if parts:
                rest[k] = len(set(parts)) / len(parts), sum(map(len, parts)) / len(parts) / 10, len(parts) / 200
            k += 1
    return np.concatenate([np.sqrt(one / length), np.sqrt(two / length), rest], 1).astype(np.float32), counts


def parts(texts: Iterator[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts' places and pieces of whole passages, ``AT_ONCE`` bytes of them or less at a time."""
    places: list[int] = []
    pieces: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        data = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(1, len(data)), AT_ONCE):
            piece = data[at : at + AT_ONCE]
            if pieces and size + len(piece) > AT_ONCE:
                yield places, pieces
                places, pieces, size = [], [], 0
            places.append(k)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield places, pieces


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """W, b: encoder; V, U, w: gated attention; c, d: score of the weighted mean; mean, scale: of the features."""

    p: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each passage its hidden vector, both gates, and its attention before it is set against the others'."""
        p = self.p
        h = np.tanh((x - p["mean"]) / p["scale"] @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        return h, t, g, (t * g) @ p["w"]

    def pool(self, h: np.ndarray, e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention, weighted means and logits of bags."""
        firsts = np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(counts)), counts)
        e = np.exp(e - np.maximum.reduceat(e, firsts)[of])
        a = e / np.add.reduceat(e, firsts)[of]
        z = np.add.reduceat(a[:, None] * h, firsts)
        return a, z, z @ self.p["c"] + self.p["d"]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        h, t, g, e = self.encode(x)
        a, z, logit = self.pool(h, e, counts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "of": np.repeat(np.arange(len(counts)), counts), "firsts": np.cumsum(counts) - counts, "logit": logit}

    def gradients(self, f: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss of bags with labels ``y``, by what ``forward`` gave."""
        p = self.p
        dl = ((_sigmoid(f["logit"]) - y) / len(y)).astype(x.dtype)
        of, a, h = f["of"], f["a"], f["h"]
        dz = dl[:, None] * p["c"]
        da = (dz[of] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, f["firsts"])[of])
        dt, dg = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
        return {"W": ((x - p["mean"]) / p["scale"]).T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum()}

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, counts)["logit"].astype(np.float64)) if len(counts) else np.empty(0)

    def scores_of(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts; of a passage only the hidden vector is kept until its text is done."""
        if not texts:
            return np.empty(0)
        hidden, attention, counts = [], [], np.zeros(len(texts), np.int64)
        for places, pieces in parts(texts):
            x, n = passages(pieces)
            h, _, _, e = self.encode(x)
            hidden.append(h)
            attention.append(e)
            np.add.at(counts, places, n)
        return _sigmoid(self.pool(np.concatenate(hidden), np.concatenate(attention), counts)[2].astype(np.float64))


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """Learns all parts together from the labels of bags, by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"mean": x.mean(0), "scale": x.std(0) + 0.02, "W": draw(x.shape[1], hidden), "b": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros((), np.float32)}
    model, learnt = Model(p), ("W", "b", "V", "U", "w", "c", "d")
    m, v = ({k: np.zeros_like(p[k]) for k in learnt} for _ in range(2))
    firsts, step = np.cumsum(counts) - counts, 0
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for at in range(0, len(order), batch):
            bags = order[at : at + batch]
            n = counts[bags]
            rows = np.repeat(firsts[bags] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            xs = x[rows]
            f = model.forward(xs, n)
            grads = model.gradients(f, xs, y[bags])
            step += 1
            for k in learnt:
                g = grads[k] + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _describe(bag: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, text in zip(b.column("quality"), b.column("text").to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                n = max(1, -(-len(data) // PASSAGE))
                which = range(n) if n <= bag else sorted({k * (n - 1) // (bag - 1) for k in range(bag)})
                x, _ = passages([data[k * PASSAGE : (k + 1) * PASSAGE] for k in which])
                yield pa.RecordBatch.from_arrays([pa.array([label.as_py()], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["quality", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, documents: int = 4000, bag: int = 32) -> Model | None:
    """Fits on at most ``documents`` labelled texts, none of them held out, chosen by a hash of their ids, and of each on at
    most ``bag`` passages, evenly spread: the sample that comes to the driver has a bounded size (1.5 kB a passage).

    Labels that are null count as none.  None if there is nothing to learn from.
    """
    ship(docs.sparkSession)
    known = renamed(labels, doc_id=F.col("doc_id").cast("long"), quality=F.col("quality").cast("int")).where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit(9))).limit(documents)
    texts = renamed(docs, doc_id=F.col("doc_id").cast("long"), text="text").join(F.broadcast(chosen), "doc_id")
    # of rows that share an id, the one with the smallest text; the order of rows must not matter
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    sample = texts.select("quality", "text").mapInArrow(_describe(bag), "quality int, x binary").toArrow().sort_by([("quality", "ascending"), ("x", "ascending")])
    if not sample.num_rows:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in sample.column("x").to_pylist()]
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), sample.column("quality").to_numpy().astype(np.float32))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = np.full(part.num_rows, 0.5) if model is None else model.scores_of(part.column("text").to_pylist())
                yield part.append_column("value", pa.array(got, pa.float64()))
        tidy()

    return run


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name`` between 0 and 1; null counts as the empty text, one empty passage."""
    return with_column(docs, text, name, "double", _score(model))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, documents: int = 4000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, in its whole text.

    Repeated rows and null ids (held out) give a row each; an empty table gives none; without labels every
    score is 0.5.  A long text is described a part at a time and scored as a whole.  Only doc_id and text of ``docs`` are read, and only the text is scored.
    """
    rows = score(renamed(docs, doc_id="doc_id", text="text"), learn(docs, labels, documents))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
