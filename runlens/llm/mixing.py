"""Mixing to target weights with soft domain membership.

A softmax classifier, fitted on a bounded sample of a labelled table, gives every document a
posterior over domains. Each document gets a non-negative rate, its expected number of copies;
the rates solve a weighted least-squares problem: the expected tokens of every domain, tokens
times rate times posterior summed over all documents, shall match the targets while rates stay as
close to 1 as that allows. Only targets that no rates reach are approached with at most ``MOST_COPIES``
(they would otherwise repeat a few documents without end), and reported. It is solved by projected
gradient steps, scaled by the spread of the posteriors whose rates are free, each one aggregation over the
posteriors; a rate depends on a document's posterior and the residuals of the steps only, so no
state is kept per document. Posteriors are whole 1/``GRID``, which lets equal ones be summed first.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm import tokens as vocabularies
from runlens.llm.arrow import map_batches, stored, texts_of
from runlens.llm.features import stored_sample, within_budget
from runlens.llm.words import SPREAD, Words, blocks

TRAIN_DOCS = 4000
#: Words that the classifier is fitted on, in whole documents.
FIT_WORDS = 2_000_000
CELL_BITS = 15
STEM = 5
EPOCHS = 12
RATE = 0.2
GRID = 256
KINDS = 8
SHAPES = KINDS + 4
STEPS = 60
PULL = 1e-3
#: Largest rate of a document. Targets that need more are approached as far as it goes.
MOST_COPIES = 64.0
TOLERANCE = 1e-4
VOCABULARY = "byte_bpe_50k.json"


# ---------------------------------------------------------------- classifier


def _kinds() -> np.ndarray:
    """Kind of each code point below 128, and of all others."""
    kind = np.full(129, 5, dtype=np.uint8)
    for number, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!?")):
        kind[[ord(c) for c in chars]] = number
    kind[[9, 10, 11, 12, 13, 32]] = 6
    kind[128] = 7
    return kind


_KIND = _kinds()


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two cells per token (its lower-cased letters and digits, and the first of them), and the
    shape of every text: shares of the kinds of characters, of repeated and of one-letter words,
    mean word length, and size."""
    kind = _KIND[np.minimum(words.cps, 128)]
    low = words.cps + np.uint32(32) * (kind == 0)
    keep = (kind <= 2) | (kind == 7)
    upto = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
    begin, end = upto[words.start], upto[words.end]
    chars = np.append(low[keep], np.uint32(0))
    with np.errstate(over="ignore"):
        core, stem = words.hashes(values=low, keep=keep), np.zeros(len(begin), dtype=np.uint32)
        for k in range(STEM):
            stem = stem * np.uint32(1_000_003) + chars[np.minimum(begin + k, len(chars) - 1)] * (begin + k < end)
        both = np.column_stack([core, stem ^ np.uint32(0x5BD1E995)]) * np.uint32(SPREAD)
    size = np.diff(words.text_start)
    home = np.repeat(np.arange(words.n) * KINDS, size)
    counts = np.bincount(home + kind, minlength=words.n * KINDS).reshape(words.n, KINDS)
    again = np.zeros(len(core), dtype=bool)
    again[1:] = (core[1:] == core[:-1]) & (words.doc[1:] == words.doc[:-1])
    n = np.maximum(words.count, 1)
    shapes = np.column_stack([counts / np.maximum(size, 1)[:, None], words.per_text(again) / n, words.per_text(words.length == 1) / n,
                              words.per_text(words.length) / n / 10, np.log1p(words.count) / 10])
    return (both >> np.uint32(32 - CELL_BITS)).astype(np.int64), shapes


@dataclass
class Classifier:
    """Softmax over hashed words (scaled by the root of the text's length) and shape features."""

    domains: list[str]
    cells: np.ndarray
    shapes: np.ndarray
    bias: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(SHAPES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(SHAPES))

    def logits(self, cells: np.ndarray, doc: np.ndarray, count: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        summed = np.column_stack([np.bincount(doc, weights=w[cells[:, 0]] + w[cells[:, 1]], minlength=len(count))
                                  for w in np.ascontiguousarray(self.cells.T)])
        return summed / np.sqrt(np.maximum(count, 1))[:, None] + ((shapes - self.mean) / self.scale) @ self.shapes + self.bias

    def units(self, texts: list[str]) -> np.ndarray:
        """Posterior of each text in whole 1/GRID."""
        words = Words(texts)
        cells, shapes = features(words)
        z = self.logits(cells, words.doc, words.count, shapes)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) * GRID
        whole = np.floor(p).astype(np.int64)
        short = GRID - whole.sum(axis=1)
        order = np.argsort(-(p - whole), axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        return whole + (rank < short[:, None])


def fit(cells: np.ndarray, sizes: np.ndarray, shapes: np.ndarray, labels: np.ndarray, domains: list[str],
        seed: int = 9, epochs: int = EPOCHS) -> Classifier:
    """Adagrad on the log loss; the words of a text follow one another in ``cells``, ``sizes`` each.

    A domain without samples keeps a small constant posterior.
    """
    d = len(domains)
    prior = np.log((np.bincount(labels, minlength=d) + 0.5) / (len(labels) + 0.5 * d))
    model = Classifier(domains, np.zeros((1 << CELL_BITS, d)), np.zeros((SHAPES, d)), prior)
    if len(np.unique(labels)) < 2:
        return model
    begin = np.cumsum(sizes) - sizes
    model.mean, model.scale = shapes.mean(axis=0), shapes.std(axis=0) + 0.05
    seen = [np.full(w.shape, 1e-6) for w in (model.cells, model.shapes, model.bias)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), 64):
            chosen = order[at:at + 64]
            size = sizes[chosen]
            rows = np.repeat(begin[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            doc = np.repeat(np.arange(len(chosen)), size)
            z = model.logits(cells[rows], doc, size, shapes[chosen])
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = p / p.sum(axis=1, keepdims=True)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            error /= len(chosen)
            share = (error / np.sqrt(np.maximum(size, 1))[:, None])[doc]
            used, where = np.unique(cells[rows], return_inverse=True)
            grad = np.column_stack([np.bincount(where.ravel(), weights=np.repeat(share[:, k], 2), minlength=len(used))
                                    for k in range(d)])
            for weights, total, g, part in (
                    (model.cells, seen[0], grad + 1e-5 * model.cells[used], used),
                    (model.shapes, seen[1], ((shapes[chosen] - model.mean) / model.scale).T @ error, slice(None)),
                    (model.bias, seen[2], error.sum(axis=0), slice(None))):
                total[part] += g * g
                weights[part] -= RATE * g / np.sqrt(total[part])
    return model


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], limit: int = TRAIN_DOCS, budget: int = FIT_WORDS) -> Classifier:
    """Fit on whole documents of at most ``limit`` rows of ``labelled`` (doc_id, domain), in the order of
    a hash as many as fit ``budget`` words; a longer document teaches nothing. Other domains are ignored.

    An id labelled twice has its first domain by name. Features are computed where the texts are.
    """
    number = F.array_position(F.array(*[F.lit(x) for x in domains]), F.col("domain")) - 1
    one = (labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
           .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
           .select("doc_id", number.cast("int").alias("label")))
    sample = stored_sample(docs, one.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(limit), "mixing-sample")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, cells, shapes = texts_of(batch), [], []
        for a, b in blocks(texts):
            words = Words(texts[a:b])
            found, shape = features(words)
            found = found.astype(np.uint16)
            shapes += [row.tobytes() for row in shape]
            cells += [found[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary()),
                                           pa.array(shapes, pa.binary())], ["doc_id", "label", "cells", "shapes"])

    found = map_batches(within_budget(sample, budget, 13), run, "doc_id long, label int, cells binary, shapes binary").toArrow().to_pylist()
    got = sorted(found, key=lambda r: (r["doc_id"], r["label"], r["cells"], r["shapes"]))
    cells = [np.frombuffer(r["cells"], np.uint16).reshape(-1, 2) for r in got]
    return fit(np.concatenate(cells) if cells else np.zeros((0, 2), np.uint16), np.array([len(c) for c in cells], dtype=int),
               np.array([np.frombuffer(r["shapes"]) for r in got]).reshape(-1, SHAPES),
               np.array([r["label"] for r in got], dtype=int), domains)


# ---------------------------------------------------------------- rates


@dataclass
class Mixture:
    """Domains, bound, and the direction of every step: all that a document's rate depends on.

    ``residual``: largest difference between a domain's expected share and its target.
    """

    domains: list[str]
    pull: float
    most: float = MOST_COPIES
    moves: list[list[float]] = field(default_factory=list)
    residual: float = 0.0

    @property
    def reached(self) -> bool:
        return self.residual < TOLERANCE

    def directions(self) -> np.ndarray:
        return np.array(self.moves, dtype=float).reshape(-1, len(self.domains))

    def rate(self, units: Column) -> Column:
        """The rate of a posterior: the projected gradient steps, one after the other, from 1."""
        step = 1 / (1 + self.pull)
        steps = [F.array(*[F.lit(float(x)) for x in d]) for d in self.directions()]
        if not steps:
            return F.lit(1.0)

        def move(r: Column, d: Column) -> Column:
            slope = F.aggregate(F.zip_with(units, d, lambda u, x: u / F.lit(float(GRID)) * x), F.lit(0.0), lambda a, b: a + b)
            return F.least(F.lit(self.most), F.greatest(F.lit(0.0), r - F.lit(step) * (slope + F.lit(self.pull) * (r - 1))))

        return F.aggregate(F.array(*steps), F.lit(1.0), move)


def posteriors(docs: DataFrame, model: Classifier, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens (by the vocabulary file that packing uses), units (posterior in 1/GRID, by domain)."""
    path = vocabulary or vocabularies.public_path(VOCABULARY)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights by cell and domain, a fixed size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, counts, units = texts_of(batch), [], []
        for a, b in blocks(texts):
            counts += [len(ids) for ids in vocabularies.byte_level(path)(texts[a:b])]
            units += shared.value.units(texts[a:b]).tolist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()),
                                           pa.array(units, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "units"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run,
                       "doc_id long, n_tokens long, units array<long>")


def solve(rows: DataFrame, targets: dict[str, float], steps: int = STEPS, pull: float = PULL, most: float = MOST_COPIES) -> Mixture:
    """Projected gradient over (units, n_tokens); the targets are shares of all tokens.

    Rates lie between 0 and ``most``. Where the targets cannot be met under that bound, the rates
    are those that come nearest; ``residual`` of the result says how far they are off, with a warning.
    """
    domains, total = list(targets), sum(targets.values())
    if total <= 0 or min(targets.values()) < 0:
        raise ValueError("targets must be non-negative and not all zero")
    goal = np.array([targets[d] / total for d in domains])
    cells = stored(rows.groupBy("units").agg(F.sum("n_tokens").alias("tokens")), "posterior-cells").where("tokens > 0")
    tokens = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not tokens:
        return Mixture(domains, pull, most)
    mixture = _steps(cells, tokens, goal, Mixture(domains, pull, most), steps)
    if not mixture.reached:
        warnings.warn(f"targets {targets} are not reached, largest difference of a share {mixture.residual:.4f}", stacklevel=2)
    return mixture


def _steps(cells: DataFrame, tokens: float, goal: np.ndarray, mixture: Mixture, steps: int) -> Mixture:
    """Steps from the rates 1 until the expected shares are the targets, at most ``steps``."""
    d, pull = range(len(goal)), mixture.pull
    share = [F.get("units", F.lit(k)) / F.lit(float(GRID)) for k in d]
    for number in range(steps + 1):
        rated = cells.withColumn("rate", mixture.rate(F.col("units")))
        free = F.when((F.col("rate") > 0) & (F.col("rate") < mixture.most), F.col("tokens")).otherwise(0)
        got = rated.agg(*[F.sum(F.col("tokens") * F.col("rate") * share[k]).alias(f"t{k}") for k in d],
                        *[F.sum(free * (F.col("rate") - 1) * share[k]).alias(f"f{k}") for k in d],
                        *[F.sum(free * share[i] * share[k]).alias(f"h{i}_{k}") for i in d for k in d]).first()
        residual = np.array([got[f"t{k}"] / tokens for k in d]) - goal
        mixture.residual = float(np.abs(residual).max())
        if mixture.reached or number == steps:
            break
        spread = np.array([[got[f"h{i}_{k}"] / tokens for k in d] for i in d])
        away = np.array([got[f"f{k}"] / tokens for k in d])  # what the pull towards 1 takes back
        move = np.linalg.solve(spread + 1e-9 * np.eye(len(goal)), (1 + pull) * residual - pull * away)
        mixture.moves.append([round(float(x), 9) for x in move])
    return mixture


def copies(rate: Column, *identity: Column) -> Column:
    """Whole copies with the rate as expectation: the fraction is drawn by a hash of the row."""
    draw = F.pmod(F.xxhash64(*identity, F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float],
        most: float = MOST_COPIES) -> tuple[DataFrame, Mixture, Classifier]:
    """Per row doc_id, n_tokens, units, rate, copies and residual; the fitted mixture and classifier with it.

    ``targets``: share of all tokens for each domain; ``most`` as in ``solve``. A null or empty text has no tokens, moves no
    total and has the rate of its posterior. Rows without an id and repeated rows are rows like
    any other (equal ids with equal token counts draw alike); other columns are not read. For an
    empty table there are no rows; without labels every posterior is the same and rates stay 1
    as far as the targets allow.
    """
    model = train(docs, labelled, list(targets))
    rows = stored(posteriors(docs, model), "posteriors")
    mixture = solve(rows, targets, most=most)
    rated = rows.withColumn("rate", mixture.rate(F.col("units"))).withColumn("residual", F.lit(mixture.residual))
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("n_tokens"))), mixture, model


def apply(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], most: float = MOST_COPIES) -> DataFrame:
    """The documents, all columns, each row as often as its copies say.

    Two passes over the texts: one for the totals, one to decide; texts are not shuffled. The
    same defined cases as in ``mix``; columns of any name are carried along.
    """
    _, mixture, model = mix(docs, labelled, targets, most)
    path = vocabularies.public_path(VOCABULARY)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    hidden = "_units"
    while hidden in names:
        hidden += "_"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, units, counts = texts_of(batch), [], []
        for a, b in blocks(texts):
            units += shared.value.units(texts[a:b]).tolist()
            counts += [len(ids) for ids in vocabularies.byte_level(path)(texts[a:b])]
        both = pa.array([{"u": u, "n": n} for u, n in zip(units, counts)],
                        pa.struct([("u", pa.list_(pa.int64())), ("n", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns, both], [*batch.schema.names, hidden])

    schema = ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes], f"`{hidden}` struct<u:array<long>,n:long>"])
    rows = map_batches(docs, run, schema)
    times = copies(mixture.rate(F.col(f"{hidden}.u")), F.col("doc_id").cast("long"), F.col(f"{hidden}.n"))
    return (rows.withColumn(hidden, F.explode(F.array_repeat(F.lit(0), times))).drop(hidden))
