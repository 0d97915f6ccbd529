"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, only the document has a label. Every passage is encoded, a gated
attention (tanh branch times sigmoid branch) gives it a weight among the passages of its document,
and the weighted representation is scored. The model is fitted on a bounded sample of labelled
documents; every document is then scored over all its passages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches, texts_of
from runlens.llm.features import WIDTH, Passages, labelled_sample, stored_sample, within_budget
from runlens.llm.words import blocks

TRAIN_DOCS = 3000
#: Words that are fitted on, in whole documents.
FIT_WORDS = 2_000_000
ENCODED = 24
GATES = 12
EPOCHS = 25
BATCH = 64
RATE = 0.01
DECAY = 1e-4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights of encoder (w, b), attention (v, u, a) and scorer (c, d), and the input's mean and scale."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """``first``: where each bag begins; no bag is empty."""
        p, f = self.p, {"x": (x - self.mean) / self.scale}
        f["h"] = np.tanh(f["x"] @ p["w"] + p["b"])
        f["t"], f["s"] = np.tanh(f["h"] @ p["v"]), sigmoid(f["h"] @ p["u"])
        gate = (f["t"] * f["s"]) @ p["a"]
        sizes = np.diff(np.append(first, len(x)))
        f["bag"] = np.repeat(np.arange(len(first)), sizes)
        raised = np.exp(gate - np.maximum.reduceat(gate, first)[f["bag"]])
        f["weight"] = raised / np.add.reduceat(raised, first)[f["bag"]]
        f["z"] = np.add.reduceat(f["weight"][:, None] * f["h"], first, axis=0)
        f["logit"] = f["z"] @ p["c"] + p["d"]
        return f

    def backward(self, f: dict[str, np.ndarray], first: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for d loss / d logit = ``error``."""
        p, bag, weight, h = self.p, f["bag"], f["weight"], f["h"]
        dz = error[:, None] * p["c"]
        pull = (h * dz[bag]).sum(axis=1)
        dgate = weight * (pull - np.add.reduceat(weight * pull, first)[bag])
        dts = dgate[:, None] * p["a"]
        dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
        dh = weight[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T
        dpre = dh * (1 - h ** 2)
        return {"w": f["x"].T @ dpre, "b": dpre.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds,
                "a": (f["t"] * f["s"]).T @ dgate, "c": f["z"].T @ error, "d": error.sum(keepdims=True)}


def fit(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> Model:
    """Adam on the mean log loss of the bags; bags follow one another in ``x``, ``sizes`` passages each.

    With labels of one kind only, or none, the model is the constant smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    shape = {"w": (x.shape[1], ENCODED), "b": (ENCODED,), "v": (ENCODED, GATES), "u": (ENCODED, GATES),
             "a": (GATES,), "c": (ENCODED,), "d": (1,)}
    p = {k: rng.standard_normal(s) / np.sqrt(s[0]) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    prior = (labels.sum() + 1) / (len(labels) + 2)
    p["d"][:] = np.log(prior / (1 - prior))
    model = Model(p, x.mean(axis=0) if len(x) else np.zeros(x.shape[1]), (x.std(axis=0) if len(x) else 0) + 0.05)
    if len(np.unique(labels)) < 2:
        p["c"][:] = 0
        return model
    begin = np.concatenate([[0], np.cumsum(sizes)])
    m, s, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in chosen])
            first = np.concatenate([[0], np.cumsum(sizes[chosen])[:-1]])
            f = model.forward(x[rows], first)
            grads = model.backward(f, first, (sigmoid(f["logit"]) - labels[chosen]) / len(chosen))
            step += 1
            for k, g in grads.items():
                g = g + DECAY * p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, column: str, limit: int = TRAIN_DOCS, words: int = FIT_WORDS) -> Model:
    """Fit on all passages of documents named by ``labels``: of at most ``limit`` those, in the order
    of a hash, that fit ``words`` words together. A longer document teaches nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, x, sizes = texts_of(batch), [], []
        for a, b in blocks(texts):
            found = Passages(texts[a:b])
            sizes += np.diff(found.first).tolist()
            x.append(found.x)
        rows = np.split(np.concatenate(x), np.cumsum(sizes)[:-1]) if x else []
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "x"])

    sample = stored_sample(docs, labelled_sample(labels, column, limit), "quality-sample")
    found = map_batches(within_budget(sample, words, 11), run, "doc_id long, label int, x binary").toArrow().to_pylist()
    bags = sorted((r["doc_id"], r["label"], r["x"]) for r in found)
    x = [np.frombuffer(b[2], np.float32).reshape(-1, WIDTH) for b in bags]
    return fit(np.concatenate(x).astype(float) if x else np.zeros((0, WIDTH)), np.array([len(b) for b in x], dtype=int),
               np.array([b[1] for b in bags], dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), passages and attention_top (the passage with the largest weight).

    Every row is scored over all its passages. A null or empty text is one empty passage and has a
    score too. Rows without an id and repeated rows are rows like any other; other columns are not
    read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, scores, counts, top = texts_of(batch), [], [], []
        for a, b in blocks(texts):
            found = Passages(texts[a:b])
            first = found.first[:-1]
            f = shared.value.forward(found.x, first)
            scores.append(sigmoid(f["logit"]))
            counts.append(np.diff(found.first))
            best = np.lexsort((-f["weight"], found.doc))[first]
            top.append(best - first)
        merged = [np.concatenate(c) if c else np.zeros(0) for c in (scores, counts, top)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(merged[0], pa.float64()), pa.array(merged[1].astype(np.int64)),
             pa.array(merged[2].astype(np.int64))], ["doc_id", "score", "passages", "attention_top"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run,
                       "doc_id long, score double, passages long, attention_top long")
