"""Toxic spans by a linear-chain conditional random field with two states.

Labels are given per document, the field needs labelled tokens. A word counts as toxic if, over a
bounded sample of labelled documents, it or one of its stems (its first 3 to 7 letters) stands
in toxic documents in significantly more different surroundings than chance would put there (a
word of a repeated passage has few). The tokens of toxic documents that are such words are
labelled 1, all tokens of other documents 0; every other token of a toxic document stays open, as
nothing tells whether it is part of the offence. The field is fitted to that partial labelling, by
the difference of its marginals with and without the labels given: it learns from word, stems,
neighbours, ending and form. Forward-backward marginals of every token then give the offending
spans, and their aggregate, calibrated on the same sample, the document's score.

Texts are never cut: a chain is run in segments of ``SEGMENT`` tokens whose transfer matrices are
multiplied up, so the messages are exact whatever the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches, pieces, stored, texts_of
from runlens.llm.features import labelled_sample, stored_sample, within_budget
from runlens.llm.words import SPREAD, Words, blocks

#: Labelled documents of either kind that words are counted in and the score is calibrated on.
TRAIN_DOCS = 3000
#: Tokens of either kind of document that the field is fitted on: whole documents, as many as fit.
FIT_TOKENS = 800_000
SEGMENT = 32
CELL_BITS = 18
EPOCHS = 12
RATE = 0.3
DECAY = 5e-5
#: Chance of taking any clean word of the sample for a toxic one.
SIGNIFICANCE = 0.01
MIN_PRECISION = 0.8
STEMS = (3, 4, 5, 6, 7)
#: Log-potential of a token that is held to its label.
HOLD = 40.0
KINDS = ("word", "previous", "next", "ending", "form", *(f"stem{n}" for n in STEMS))


def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and alphanumeric mark of every character of the basic plane."""
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x10000))] + [0], np.uint32)
    return lower, np.array([chr(c).isalnum() for c in range(0x10000)] + [True])


_LOWER, _ALNUM = _fold()


def folded_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every word, over its lower-cased letters and digits alone.

    Whole word, last three characters, and one column per stem length (0 where the word is not
    longer than the stem).
    """
    cps = np.minimum(words.cps, 0x10000)
    values = np.where(cps < 0x10000, _LOWER[cps], words.cps).astype(np.uint32)
    used = words.inside & _ALNUM[cps]
    upto = np.concatenate([[0], np.cumsum(used)])
    begin, end = upto[words.start], upto[words.end]
    chars = np.append(values[used], np.uint32(0))
    with np.errstate(over="ignore"):
        core = words.hashes(values=values, keep=_ALNUM[cps])
        tail = np.zeros(len(core), dtype=np.uint32)
        for back in (3, 2, 1):
            tail = tail * np.uint32(1_000_003) + np.where(end - back >= begin, chars[np.maximum(end - back, 0)], np.uint32(0))
        stems, rolling = np.zeros((len(core), len(STEMS)), dtype=np.uint32), np.zeros(len(core), dtype=np.uint32)
        for k in range(STEMS[-1]):
            rolling = rolling * np.uint32(31) + chars[np.minimum(begin + k, len(chars) - 1)]
            if k + 1 in STEMS:
                at = STEMS.index(k + 1)
                stems[:, at] = np.where(end - begin > k + 1, rolling * np.uint32(SPREAD) + np.uint32(k + 1), np.uint32(0))
    return core, tail, stems


def features(words: Words, bits: int = CELL_BITS) -> np.ndarray:
    """One cell per token and kind of feature."""
    core, tail, stems = folded_words(words)
    with np.errstate(over="ignore"):
        back, ahead = np.zeros_like(core), np.zeros_like(core)
        same = words.doc[1:] == words.doc[:-1]
        back[1:] = np.where(same, core[:-1], np.uint32(1))
        ahead[:-1] = np.where(same, core[1:], np.uint32(1))
        alnum = np.concatenate([[0], np.cumsum(_ALNUM[np.minimum(words.cps, 0x10000)])])
        form = np.minimum(words.length, 20) * 4 + (alnum[words.end] - alnum[words.start] < words.length)
        columns = []
        for number, value in enumerate((core, back, ahead, tail, form.astype(np.uint32), *stems.T)):
            mixed = (value + np.uint32(number * 0x01000193)) * np.uint32(SPREAD)
            columns.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits))
        return np.column_stack(columns)


def segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first token, size, text) of every segment; a text without words has none."""
    per = -(-words.count // SEGMENT)
    doc = np.repeat(np.arange(words.n), per)
    number = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    begin = words.first[doc] + number * SEGMENT
    return begin, np.minimum(SEGMENT, words.first[doc + 1] - begin), doc


def marginals(energy: np.ndarray, trans: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray,
              pairs: bool = False):
    """P(state 1) of every token, by exact forward and backward messages.

    ``energy``: log-potential of state 1 against state 0 per token; ``trans``: 2x2 log-potentials.
    With ``pairs`` also the summed pair marginals (2x2) and the log-partition of every chain.
    """
    lanes, step = len(begin), np.exp(trans)
    if not lanes:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(0)) if pairs else np.zeros(0)
    at = np.minimum(begin[None, :] + np.arange(SEGMENT)[:, None], len(energy) - 1)
    live = np.arange(SEGMENT)[:, None] < size[None, :]
    e = np.where(live, energy[at], 0.0)
    high = np.maximum(e, 0)
    node = np.stack([np.exp(-high), np.exp(e - high)], axis=-1)  # (SEGMENT, lanes, 2)

    lead = np.concatenate([[True], doc[1:] != doc[:-1]])
    opening = np.where(lead[:, None, None], np.eye(2), step)  # a chain's first token follows no other
    product = np.broadcast_to(np.eye(2), (lanes, 2, 2)).copy()
    for t in range(SEGMENT):
        moved = (product @ (step if t else opening)) * node[t][:, None, :]
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        product = np.where(live[t][:, None, None], moved, product)
    enter, leave, first = np.ones((lanes, 2)), np.ones((lanes, 2)), np.flatnonzero(lead)
    length = np.diff(np.append(first, lanes))
    for k in range(1, int(length.max())):
        here = first[length > k] + k
        moved = (enter[here - 1][:, None, :] @ product[here - 1])[:, 0, :]
        enter[here] = moved / moved.sum(axis=1, keepdims=True)
    for k in range(1, int(length.max())):
        here = (first + length)[length > k] - 1 - k
        moved = (product[here + 1] @ leave[here + 1][:, :, None])[:, :, 0]
        leave[here] = moved / moved.sum(axis=1, keepdims=True)

    ahead = np.empty((SEGMENT, lanes, 2))
    logs, state = np.zeros(lanes), enter
    for t in range(SEGMENT):
        moved = (state @ step if t else (state[:, None, :] @ opening)[:, 0, :]) * node[t]
        total = moved.sum(axis=1, keepdims=True)
        logs += np.where(live[t], np.log(total[:, 0]) + high[t], 0)
        state = ahead[t] = np.where(live[t][:, None], moved / total, state)
    prob, joint, back = np.empty((SEGMENT, lanes)), np.zeros((2, 2)), leave
    for t in range(SEGMENT - 1, -1, -1):
        both = ahead[t] * back
        prob[t] = both[:, 1] / both.sum(axis=1)
        if pairs:
            before = ahead[t - 1] if t else enter
            cell = before[:, :, None] * step[None] * (node[t] * back)[:, None, :]
            inner = live[t] if t else live[t] & ~lead
            joint += (cell / cell.sum(axis=(1, 2), keepdims=True))[inner].sum(axis=0)
        moved = (node[t] * back) @ step.T
        back = np.where(live[t][:, None], moved / moved.sum(axis=1, keepdims=True), back)
    out = prob.T[live.T]
    return (out, joint, logs) if pairs else out


@dataclass
class Field:
    """Weights by feature cell, bias, transition log-potentials, and the calibration of the document score."""

    weights: np.ndarray
    bias: float
    trans: np.ndarray
    calibration: np.ndarray

    def energy(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(axis=1) + self.bias

    def token_marginals(self, words: Words) -> np.ndarray:
        return marginals(self.energy(features(words)), self.trans, *segments(words))

    def scores(self, words: Words, prob: np.ndarray | None = None) -> np.ndarray:
        """Calibrated document scores of a block."""
        prob = self.token_marginals(words) if prob is None else prob
        logit = aggregate(prob, words) @ self.calibration[:2] + self.calibration[2]
        return 0.5 * (1 + np.tanh(0.5 * logit))


def fit_field(cells: np.ndarray, gold: np.ndarray, sizes: np.ndarray, bits: int = CELL_BITS, seed: int = 3,
              epochs: int = EPOCHS) -> Field:
    """Maximum likelihood by Adagrad; chains of at most ``SEGMENT`` tokens follow one another.

    ``gold`` is 1 or 0 where a token's label is known and -1 where it is open. The gradient is the
    difference of two sums of marginals: of the field as it is, and of the field held to the
    known labels.
    """
    rng = np.random.default_rng(seed)
    field = Field(np.zeros(1 << bits), -2.0, np.zeros((2, 2)), np.array([0.0, 0.0, 0.0]))
    if not (gold == 1).any():
        field.bias = -8.0
        return field
    seen, seen_trans, seen_bias = np.full(1 << bits, 1e-6), np.full((2, 2), 1e-6), 1e-6
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    for _ in range(epochs):
        order = rng.permutation(len(sizes))
        for at in range(0, len(order), 512):
            chosen = np.sort(order[at:at + 512])
            size = sizes[chosen]
            rows = np.repeat(begin[chosen], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            first = np.cumsum(size) - size
            here, y = cells[rows], gold[rows]
            energy, lanes = field.energy(here), np.arange(len(chosen))
            prob, joint, _ = marginals(energy, field.trans, first, size, lanes, pairs=True)
            held = np.where(y == 1, HOLD, np.where(y == 0, -HOLD, energy))
            known, known_joint, _ = marginals(held, field.trans, first, size, lanes, pairs=True)
            error = (prob - known) / len(chosen)
            used, where = np.unique(here, return_inverse=True)
            grad = np.bincount(where.ravel(), weights=np.repeat(error, cells.shape[1]), minlength=len(used))
            grad += DECAY * field.weights[used]
            turn = (joint - known_joint) / len(chosen) + DECAY * field.trans
            seen[used] += grad * grad
            field.weights[used] -= RATE * grad / np.sqrt(seen[used])
            seen_trans += turn * turn
            field.trans -= RATE * 0.3 * turn / np.sqrt(seen_trans)
            seen_bias += error.sum() ** 2
            field.bias -= RATE * 0.3 * error.sum() / np.sqrt(seen_bias)
    return field


def aggregate(prob: np.ndarray, words: Words) -> np.ndarray:
    """Per text: log-odds of its largest marginal, and log of 1 + its expected number of toxic tokens."""
    top = np.full(words.n, 1e-6)
    np.maximum.at(top, words.doc, np.clip(prob, 1e-6, 1 - 1e-6))
    expected = words.per_text(np.where(prob > 0.05, prob, 0.0))
    return np.column_stack([np.log(top / (1 - top)), np.log1p(expected)])


def calibrate(aggregates: np.ndarray, labels: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression from aggregates to document labels; weights are kept non-negative."""
    x = np.column_stack([aggregates, np.ones(len(aggregates))])
    w = np.array([0.5, 0.5, 0.0])
    if len(np.unique(labels)) < 2:
        prior = (labels.sum() + 1) / (len(labels) + 2)
        return np.array([0.0, 0.0, np.log(prior / (1 - prior))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + np.diag([1e-3, 1e-3, 1e-6])
        w = w - 0.5 * np.linalg.solve(hess, x.T @ (p - labels) / len(x) + np.array([1e-3, 1e-3, 0]) * w)
        w[:2] = np.maximum(w[:2], 0)
    return w


# ---------------------------------------------------------------- fitting on a labelled sample


def units(words: Words) -> np.ndarray:
    """Whole word and stems of every token, as keys that tell the kinds apart; 0 for none."""
    core, _, stems = folded_words(words)
    whole = np.where(core != 0, core.astype(np.int64) + (1 << 40), 0)
    return np.column_stack([whole, stems.astype(np.int64)])


def toxic_units(sample: DataFrame, precision: float = MIN_PRECISION, chance: float = SIGNIFICANCE) -> np.ndarray:
    """Words and stems that mark toxic documents of ``sample`` (doc_id, label, text), as sorted keys.

    Different surroundings of a unit are counted in toxic documents and in all. A unit qualifies
    if ``precision`` of its surroundings are in toxic documents, both kinds of document weighed by
    their tokens, and if so many of them would be there by chance, at the toxic documents' share
    of the tokens, with a probability below ``chance`` divided by the number of units tested
    (Chernoff's bound). How frequent other units are plays no part, and no unit is left out for
    their number; the sample bounds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = texts_of(batch), np.array(batch.column(1).to_pylist())
            for a, b in blocks(texts):
                words = Words(texts[a:b])
                f, found = features(words).astype(np.int64), units(words)
                around = np.repeat(f[:, 1] * (1 << CELL_BITS) + f[:, 2], found.shape[1])
                table = np.column_stack([found.ravel(), around, np.repeat(labels[a:b][words.doc], found.shape[1])])
                table = np.unique(table[table[:, 0] != 0], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(3)], ["unit", "around", "label"])

    seen = sample.select("doc_id", "label", "text").mapInArrow(run, "unit long, around long, label long")
    counts = seen.distinct().groupBy("unit").agg(F.sum("label").alias("in_bad"), F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("units"), F.sum("in_bad").alias("bad"), F.sum("n").alias("all")).first()
    if not total["units"] or not 0 < total["bad"] < total["all"]:
        return np.zeros(0, dtype=np.int64)
    base = total["bad"] / total["all"]  # share of the toxic documents in all surroundings
    share = F.col("in_bad") / F.col("n")
    weighed = share / base / (share / base + (1 - share) / (1 - base))
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    surprise = F.col("n") * (F.when(share > 0, share * F.log(share / base)).otherwise(0.0) + rest)
    found = counts.where((weighed >= precision) & (surprise >= float(np.log(total["units"] / chance)))).select("unit")
    return np.sort(found.toArrow().column(0).to_numpy().astype(np.int64))


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", limit: int = TRAIN_DOCS, tokens: int = FIT_TOKENS) -> Field:
    """Fit on labelled documents, whole ones always.

    Toxic words and the calibration come from at most ``limit`` toxic and ``limit`` other documents,
    the field from those of them, taken in the order of a hash, that fit ``tokens`` tokens of
    either kind; a document that is longer than that teaches no field.
    """
    ids = [labelled_sample(labels.where(F.col(column) == kind), column, limit) for kind in (1, 0)]
    both = ids[0].unionByName(ids[1].join(ids[0], "doc_id", "left_anti"))  # 2 * limit rows
    sample = stored_sample(docs, both, "toxicity-sample")
    lexicon = toxic_units(sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, labels_, texts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch), []
        for a, b in blocks(texts):
            words = Words(texts[a:b])
            bad = np.array(labels_[a:b])[words.doc] == 1
            gold = np.where(bad, np.where(np.isin(units(words), lexicon).any(axis=1), 1, -1), 0).astype(np.int8)
            cells = features(words)
            for i in range(b - a):
                span = slice(words.first[i], words.first[i + 1])
                rows.append((keys[a + i], cells[span].astype(np.uint32).tobytes(), gold[span].tobytes()))
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()),
                                           pa.array(columns[2], pa.binary())], ["doc_id", "cells", "gold"])

    chains = stored(map_batches(within_budget(sample, tokens, 5, by_label=True), run, "doc_id long, cells binary, gold binary"), "toxicity-chains")
    cells, gold, sizes = [np.zeros((0, len(KINDS)), np.uint32)], [np.zeros(0, np.int8)], []
    for piece in pieces(chains.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "gold", "cells").select("cells", "gold")):
        cells.append(np.frombuffer(b"".join(r["cells"] for r in piece), dtype=np.uint32).reshape(-1, len(KINDS)))
        gold.append(np.frombuffer(b"".join(r["gold"] for r in piece), dtype=np.int8))
        sizes += [min(SEGMENT, len(r["gold"]) - at) for r in piece for at in range(0, len(r["gold"]), SEGMENT)]
    field = fit_field(np.concatenate(cells), np.concatenate(gold), np.array(sizes, dtype=int))
    del cells, gold
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = texts_of(batch), []
        for a, b in blocks(texts):
            words = Words(texts[a:b])
            out.append(aggregate(shared.value.token_marginals(words), words))
        both = np.concatenate(out) if out else np.zeros((0, 2))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both[:, 0]), pa.array(both[:, 1])],
                                          ["doc_id", "label", "top", "expected"])

    rows = map_batches(sample.select("doc_id", "label", "text"), read, "doc_id long, label int, top double, expected double").orderBy(
        F.xxhash64("doc_id", F.lit(5)), "doc_id", "top", "expected").limit(2 * limit).collect()
    prior_shift = _prior_shift(labels, column, [r["label"] for r in rows])
    field.calibration = calibrate(np.array([[r["top"], r["expected"]] for r in rows]).reshape(-1, 2),
                                  np.array([r["label"] for r in rows], dtype=float))
    field.calibration[2] += prior_shift
    return field


def _prior_shift(labels: DataFrame, column: str, sampled: list[int]) -> float:
    """Log-odds of toxic among all labelled rows against those of the sample."""
    row = labels.agg(F.sum(F.col(column)).alias("bad"), F.count(column).alias("n")).first()
    bad, n = float(row["bad"] or 0), float(row["n"] or 0)
    odds = lambda b, m: np.log((b + 1) / (m - b + 1))
    return float(odds(bad, n) - odds(sum(sampled), len(sampled)))


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score (0 to 1) and spans: array of (start, end, text, probability) in code points.

    A span is a run of tokens with a marginal of at least one half. Every row is scored over its
    whole text; a null or empty text has no tokens and the score of a text without any evidence.
    Rows without an id and repeated rows are rows like any other; other columns are not read; an
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # weights by cell, a fixed size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("probability", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, scores, spans = texts_of(batch), [], []
        field = shared.value
        for a, b in blocks(texts):
            words = Words(texts[a:b])
            prob = field.token_marginals(words)
            scores.append(field.scores(words, prob))
            found = [[] for _ in range(b - a)]
            hot = np.flatnonzero(prob >= 0.5)
            if len(hot):
                breaks = np.flatnonzero((np.diff(hot) != 1) | (np.diff(words.doc[hot]) != 0)) + 1
                for run_ in np.split(hot, breaks):
                    doc = words.doc[run_[0]]
                    s, e = int(words.start[run_[0]] - words.text_start[doc]), int(words.end[run_[-1]] - words.text_start[doc])
                    found[doc].append({"start": s, "end": e, "text": texts[a + doc][s:e], "probability": float(prob[run_].max())})
            spans += found
        merged = np.concatenate(scores) if scores else np.zeros(0)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(merged, pa.float64()), pa.array(spans, kind)],
                                          ["doc_id", "score", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), run,
                       "doc_id long, score double, "
                       "spans array<struct<start:long,end:long,text:string,probability:double>>")


def without_toxic(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below ``threshold``; texts are not shuffled.

    The same defined cases as in ``score``; columns of any name are carried along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = texts_of(batch), []
        for a, b in blocks(texts):
            keep += (shared.value.scores(Words(texts[a:b])) < threshold).tolist()
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(docs, run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
