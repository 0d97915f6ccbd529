"""Embedding whitening: leading principal components by spectrum slicing.

Sums and centred products of quantised vectors are exact integers, so the covariance is exact up
to its last rounding. Its leading eigenvalues are separated by counting: by Sylvester's law the
LDL^T factors of V - s have as many positive pivots as V has eigenvalues above s. Where an
interval holds exactly one, Rayleigh quotient iteration converges cubically to it, and two more
counts, right above and right below the result, certify which number it has. Eigenvalues that no
double can tell apart share one interval and get an orthonormal basis of their common space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.arrow import map_batches

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Width of the parts that integers are cut into, so that sums of products of parts stay exact in doubles.
LIMB = 20
CHUNK = 4096
ALPHA = (1 + 17**0.5) / 8


def fit_list(df: DataFrame, vector: str, scale: int = SCALE) -> Column:
    """Whether a row's vector takes part: not null, every scaled component finite and within 62 bits."""
    limit = float(2**62) / scale
    return F.col(vector).isNotNull() & F.coalesce(
        F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < limit)), F.lit(False))


def quantised(column: pa.Array, dims: int, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset as int64, one row per vector."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.floor(flat * scale).astype(np.int64) + offset


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """Parts p0, p1, ... of absolute value at most 2^19 with d = p0 + 2^20 p1 + ..., as doubles."""
    parts, half = [], 1 << (LIMB - 1)
    while not parts or d.any():
        low = ((d + half) & ((1 << LIMB) - 1)) - half
        parts.append(low.astype(np.float64))
        d = (d - low) >> LIMB
    return parts


def _summed(df: DataFrame, per_batch: Callable[[pa.RecordBatch], dict[tuple[int, int, int], int]]) -> dict[tuple[int, int, int], int]:
    """Exact totals of what batches give under (i, j, shift); a task adds up its batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            for key, value in per_batch(batch).items():
                total[key] += value
        keys = sorted(total)
        # 36 bits and the rest, so that sums over any number of tasks fit a decimal
        for low, lift in ((True, 0), (False, 36)):
            values = [(total[k] & ((1 << 36) - 1)) if low else total[k] >> 36 for k in keys]
            yield pa.RecordBatch.from_pydict({
                "i": pa.array([k[0] for k in keys], pa.int32()), "j": pa.array([k[1] for k in keys], pa.int32()),
                "shift": pa.array([k[2] + lift for k in keys], pa.int32()), "value": pa.array(values, pa.int64())})

    partial = df.mapInArrow(run, "i int, j int, shift int, value long")
    rows = partial.groupBy("i", "j", "shift").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    total: dict[tuple[int, int, int], int] = defaultdict(int)
    for r in rows:
        total[r["i"], r["j"], 0] += int(r["value"]) << r["shift"]
    return total


@dataclass(frozen=True)
class Moments:
    """Exact sums over the fit list: ``n`` vectors, ``sums`` per dimension, ``covariance`` rounded once."""

    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The integers next to the means."""
        return np.array([round(Fraction(s, self.n)) for s in self.sums], dtype=np.int64)


def moments(fit: DataFrame, vector: str, dims: int, scale: int = SCALE, offset: int = OFFSET) -> Moments:
    """Two passes: the sums, then products of what is left after the rounded mean is taken away."""

    def first(batch: pa.RecordBatch) -> dict:
        x = quantised(batch.column(0), dims, scale, 0)
        low, high = x & ((1 << 32) - 1), x >> 32
        found = {(0, 0, 0): len(x)}
        for j, (a, b) in enumerate(zip(low.sum(axis=0).tolist(), high.sum(axis=0).tolist())):
            found[1, j, 0], found[1, j, 32] = a, b
        return found

    one = fit.select(vector)
    total = _summed(one, _by_parts(first))
    n = total[0, 0, 0]
    sums = [total[1, j, 0] + n * offset for j in range(dims)]
    if not n:
        return Moments(0, sums, np.zeros((dims, dims)))
    centre = Moments(n, sums, np.zeros((0, 0))).centre

    def second(batch: pa.RecordBatch) -> dict:
        x = quantised(batch.column(0), dims, scale, offset)
        found: dict[tuple[int, int, int], int] = defaultdict(int)
        for at in range(0, len(x), CHUNK):
            parts = limbs(x[at:at + CHUNK] - centre)
            for a, left in enumerate(parts):
                for i, value in enumerate(left.sum(axis=0).tolist()):
                    found[-1, i, LIMB * a] += int(value)
                for b, right in enumerate(parts):
                    product = left.T @ right
                    for i in range(dims):
                        for j, value in enumerate(product[i, i:].tolist(), i):
                            found[i, j, LIMB * (a + b)] += int(value)
        return found

    total = _summed(one, _by_parts(second))
    rest = [total[-1, i, 0] for i in range(dims)]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            exact = Fraction(n * total[i, j, 0] - rest[i] * rest[j], n * n)
            covariance[i, j] = covariance[j, i] = float(exact)
    return Moments(n, sums, covariance)


def _by_parts(fn: Callable[[pa.RecordBatch], dict]) -> Callable[[pa.RecordBatch], dict]:
    """Nothing for an empty batch."""
    return lambda batch: fn(batch) if batch.num_rows else {}


def inertia(matrix: np.ndarray) -> tuple[int, int]:
    """(positive, negative) eigenvalues of a symmetric matrix, from the pivots of LDL^T.

    Pivots are chosen over the whole rest (Bunch and Parlett): the largest diagonal entry, or a
    block of two around the largest entry beside it, which has one eigenvalue of either sign.
    """
    a = matrix.copy()
    positive = negative = 0
    while len(a):
        size = np.abs(a)
        diagonal = np.diagonal(size)
        k = int(diagonal.argmax())
        beside = size - np.diag(diagonal)
        p, q = divmod(int(beside.argmax()), len(a))
        if diagonal[k] >= ALPHA * beside[p, q]:
            if diagonal[k] == 0:
                break
            positive, negative = positive + (a[k, k] > 0), negative + (a[k, k] < 0)
            chosen, solved = [k], a[[k]] / a[k, k]
        else:
            positive, negative = positive + 1, negative + 1
            chosen = [p, q]
            solved = np.linalg.solve(a[np.ix_(chosen, chosen)], a[chosen])
        stay = np.delete(np.arange(len(a)), chosen)
        a = a[np.ix_(stay, stay)] - a[np.ix_(stay, chosen)] @ solved[:, stay]
        a = (a + a.T) / 2
    return positive, negative


class Slices:
    """Counts of eigenvalues above a shift, each computed once."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.known = matrix, {}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = inertia(self.matrix - shift * np.eye(len(self.matrix)))[0]
        return self.known[shift]


def _rayleigh(matrix: np.ndarray, low: float, high: float, found: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of an interval with one eigenvalue."""
    n = len(matrix)
    v = rng.standard_normal(n)
    value, eye = (low + high) / 2, np.eye(n)
    for step in range(60):
        try:
            w = np.linalg.solve(matrix - value * eye, v)
        except np.linalg.LinAlgError:
            break
        w -= found @ (found.T @ w)
        w /= np.linalg.norm(w)
        new = float(w @ matrix @ w)
        still = abs(abs(float(w @ v)) - 1) < 1e-15 and abs(new - value) <= 1e-15 * abs(new)
        # the first steps keep the shift inside, so that the iteration stays with its eigenvalue
        value, v = new if step > 1 and low < new < high else value, w
        if still:
            break
    return float(v @ matrix @ v), v


def leading(matrix: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns): the leading positive part of the spectrum.

    Eigenvalues within rounding of zero (dimensions times the last digit of the largest one) count as zero
    and have no component. The largest entry of each vector is positive.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    slices, rng = Slices(matrix), np.random.default_rng(7)
    least = n * np.finfo(float).eps * scale
    narrow = 8 * np.finfo(float).eps * scale
    values, vectors = [], np.zeros((n, 0))
    wanted = min(count, slices.above(least))
    intervals = [(least, scale * (1 + 1e-12) + narrow)]
    while intervals and len(values) < wanted:
        low, high = intervals.pop()
        top, bottom = slices.above(high), slices.above(low)
        if bottom == top or top >= wanted:
            continue
        middle = (low + high) / 2
        if bottom - top == 1:
            value, v = _rayleigh(matrix, low, high, vectors, rng)
            near = narrow * n
            if low - near <= value <= high + near and slices.above(value + near) <= top < slices.above(value - near):
                values.append(value)
                vectors = np.column_stack([vectors, v])
                continue
        if high - low > narrow and low < middle < high:
            intervals += [(low, middle), (middle, high)]
            continue
        # no double lies between them: an orthonormal basis of what the interval holds
        block = rng.standard_normal((n, bottom - top))
        for _ in range(6):
            block = np.linalg.solve(matrix - (high + 4 * narrow) * np.eye(n), block)
            block -= vectors @ (vectors.T @ block)
            block = np.linalg.qr(block)[0]
        values += sorted((float(b @ matrix @ b) for b in block.T), reverse=True)
        vectors = np.column_stack([vectors, block])
    values, vectors = np.array(values[:wanted]), vectors[:, :wanted]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if len(values) else np.ones(0)
    return values, vectors * signs


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error per vector and component.

    Vectors that are null, that hold a null or non-finite component, one whose scaled value leaves
    62 bits, or fewer components than the longest vector, take no part. Repeated rows and keys
    and null keys are vectors like others. ``deviation`` is exact; where it leaves 64 bits the job
    fails rather than return another number. Only directions with variance are components: a table
    of equal vectors, of one vector or of none gives no rows. Eigenvalues that are equal get some
    orthonormal basis of their space. Other columns are ignored.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    fit = df.select(key, vector).where(fit_list(df, vector, scale))
    dims = fit.agg(F.max(F.size(vector))).collect()[0][0] or 0
    fit = fit.where(F.size(vector) == dims)
    found = moments(fit, vector, dims, scale, offset) if dims else Moments(0, [], np.zeros((0, 0)))
    values, vectors = leading(found.covariance, count)
    if not len(values):
        return df.sparkSession.createDataFrame([], schema + ", identity_error double")
    n, sums, centre = found.n, found.sums, found.centre
    explained = values / np.trace(found.covariance)
    matrix = vectors / np.sqrt(values)
    rest = np.array([float(Fraction(s, n) - int(c)) for s, c in zip(sums, centre)])
    # n x - S = n (x - centre) - over, all in integers
    over = np.array([s - n * int(c) for s, c in zip(sums, centre)], dtype=object)
    kept = len(values)

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return (quantised(batch.column(batch.schema.get_field_index(vector)), dims, scale, offset) - centre - rest) @ matrix

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        d = quantised(batch.column(batch.schema.get_field_index(vector)), dims, scale, offset) - centre
        most = n * int(np.abs(d).max()) + max(abs(int(o)) for o in over)
        if dims * most * most < 2**63:
            deviation = ((n * d - over.astype(np.int64)) ** 2).sum(axis=1)
        else:
            deviation = ((n * d.astype(object) - over) ** 2).sum(axis=1)
        whitened = project(batch)
        ids = batch.column(batch.schema.get_field_index(key)).take(pa.array(np.repeat(np.arange(len(d)), kept)))
        return pa.RecordBatch.from_arrays([
            ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(d))), pa.array(np.full(len(d) * kept, n)),
            pa.array(np.repeat(deviation, kept).tolist(), pa.int64()), pa.array(whitened.ravel()),
            pa.array(np.tile(explained, len(d)))], names=[key, "component", "n", "deviation", "whitened", "explained"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            w = project(batch)
            second += w.T @ w
            first += w.sum(axis=0)
        i, j = np.triu_indices(kept)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array([*i, *[-1] * kept], pa.int32()), "j": pa.array([*j, *range(kept)], pa.int32()),
            "value": pa.array([*second[i, j], *first])})

    sizes = fit.select(vector).mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    total = {(r["i"], r["j"]): r["value"] / n for r in sizes.collect()}
    error = max(abs(v - total[-1, i] * total[-1, j] - (i == j)) for (i, j), v in total.items() if i >= 0)
    return map_batches(fit, rows, schema).withColumn("identity_error", F.lit(float(error)))
