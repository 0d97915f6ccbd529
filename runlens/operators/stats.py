"""Statistics over passes: A/A bands, bootstrap intervals, seed noise, sign tests, parity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale
from runlens.functions.numbers import exact_round, fixed_digits, let

c = F.col
PAIR = ["source", "run_a", "run_b"]
DRAWS_PER_ROW = 65_536
#: Nodes of the quadrature behind the sign test.
NODES = 64


def pair_passes(task_passes: DataFrame) -> DataFrame:
    """Outcome table of every pair of passes over their common tasks.

    Columns: source, run_a < run_b, n11, n10, n01, n00 (first digit: run_a). Tasks with the same
    outcomes over all passes are counted first, so pairs are formed per outcome pattern, never
    per task.
    """
    pattern = F.array_sort(F.collect_set(F.struct(c("run_id").alias("run"), c("pass_hat_k").alias("ok"))))
    patterns = (
        task_passes.groupBy("source", "task_id")
        .agg(pattern.alias("_p"))
        .groupBy("source", "_p")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    pairs = F.flatten(
        F.transform(
            "_p",
            lambda a, i: F.transform(
                F.slice(c("_p"), i + 2, F.size("_p")),
                lambda b: F.struct(a["run"].alias("run_a"), b["run"].alias("run_b"), a["ok"].alias("a"), b["ok"].alias("b")),
            ),
        )
    )
    rows = patterns.select("source", "_n", F.explode(pairs).alias("_q")).select("source", "_n", "_q.*")

    def cell(a: bool, b: bool) -> Column:
        hit = (c("a") if a else ~c("a")) & (c("b") if b else ~c("b"))
        return F.coalesce(F.sum(F.when(hit, c("_n"))), F.lit(0)).alias(f"n{int(a)}{int(b)}")

    return rows.groupBy(*PAIR).agg(cell(True, True), cell(True, False), cell(False, True), cell(False, False))


def _tasks() -> Column:
    return c("n11") + c("n10") + c("n01") + c("n00")


def mixed(numbers: np.ndarray) -> np.ndarray:
    """32-bit counter hash of non-negative numbers: xor-shift and multiply rounds."""
    mask = np.uint64(0xFFFFFFFF)
    h = numbers & mask
    for shift, factor in ((15, 0x2C1B3C6D), (12, 0x297A2D39)):
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & mask
    return h ^ (h >> np.uint64(15))


def bootstrap_delta(cells: DataFrame, n: int = fixed.BOOTSTRAP_RESAMPLES, seed: int = 0,
                    draws_per_row: int = DRAWS_PER_ROW) -> DataFrame:
    """95% bootstrap interval, over tasks, of |mean(a) - mean(b)| in points, per pair of passes.

    A resampled task only matters by its outcome cell, so no task rows are read. Every draw is a
    seeded hash of its slot, taken modulo the task count, at every size: the slots of a resample
    are cut into runs, each run is a short numpy vector, and the runs are summed per resample with
    partial sums on the map side.
    """
    sized = cells.withColumn("_m", _tasks())
    low, high = int(0.025 * n), min(n - 1, int(0.975 * n))

    tag = F.concat_ws(":", F.lit(str(seed)), *PAIR, c("_rep").cast("string"))
    resamples = sized.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    runs = F.sequence(F.lit(0).cast("long"), F.floor((c("_m") - 1) / draws_per_row))
    resamples = resamples.where(c("_m") > 0).withColumn("_run", F.explode(runs))
    # a fixed number of tasks: these rows are few but expensive, so they must not be coalesced by size
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    resamples = resamples.repartition(tasks, *PAIR, "_rep", "_run")
    resamples = resamples.withColumn("_base", F.conv(F.substring(F.sha2(tag, 256), 1, 8), 16, 10).cast("bigint"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            moves = np.empty(len(pdf), dtype=np.int64)
            for i, (base, m, run, up, down) in enumerate(zip(pdf["_base"], pdf["_m"], pdf["_run"], pdf["n10"], pdf["n01"])):
                slots = np.arange(run * draws_per_row, min(m, (run + 1) * draws_per_row), dtype=np.uint64)
                pick = mixed(base + slots * np.uint64(2654435761)) % m
                moves[i] = 2 * np.count_nonzero(pick < up) - np.count_nonzero(pick < up + down)
            out = pdf[[*PAIR, "_m", "_rep"]].copy()
            out["_d"] = moves
            yield out

    deltas = resamples.select(*PAIR, "_m", "_rep", "_run", "_base", "n10", "n01").mapInPandas(
        draw, "source string, run_a string, run_b string, _m long, _rep int, _d long"
    ).groupBy(*PAIR, "_m", "_rep").agg(F.abs(F.sum("_d")).alias("_d"))
    w = Window.partitionBy(*PAIR).orderBy("_d", "_rep")
    point = c("_d") / c("_m") * 100
    return (
        deltas.withColumn("_rn", F.row_number().over(w) - 1)
        .where(c("_rn").isin(low, high))
        .groupBy(*PAIR)
        .agg(
            F.max(F.when(c("_rn") == low, point)).alias("ci_low"),
            F.max(F.when(c("_rn") == high, point)).alias("ci_high"),
        )
    )


def aa_band(task_passes: DataFrame, n: int = fixed.BOOTSTRAP_RESAMPLES, seed: int = 0) -> DataFrame:
    """Agreement, delta in points and its interval for every pair of passes of a source.

    Sources with more than two passes get a summary row (run_a and run_b NULL): mean agreement
    and delta over the pairs, lowest and highest bound. Like the printed rows, the summary works
    on agreements rounded to 4 and bounds rounded to 2 digits.
    """
    cells = pair_passes(task_passes)
    m = _tasks()
    pairs = cells.select(
        *PAIR, m.alias("tasks"), ((c("n11") + c("n00")) / m).alias("agreement"),
        (F.abs(c("n10") - c("n01")) / m * 100).alias("delta_points"),
    ).join(bootstrap_delta(cells, n, seed), PAIR)
    # every pair counts once for itself and once for its source, so nothing runs twice
    none = F.lit(None).cast("string")
    rows = pairs.withColumnsRenamed({"run_a": "_a", "run_b": "_b"})
    rows = rows.withColumn("_r", F.explode(F.array(
        F.struct(c("_a").alias("run_a"), c("_b").alias("run_b"), F.lit(False).alias("all")),
        F.struct(none.alias("run_a"), none.alias("run_b"), F.lit(True).alias("all")))))
    shown = lambda name, digits: F.when(c("_r.all"), exact_round(c(name), digits)).otherwise(c(name))
    return (
        rows.groupBy("source", "_r")
        .agg(F.count(F.lit(1)).alias("_n"), F.min_by("tasks", F.struct("_a", "_b")).alias("tasks"),
             F.avg(shown("agreement", 4)).alias("agreement"), F.avg("delta_points").alias("delta_points"),
             F.min(shown("ci_low", 2)).alias("ci_low"), F.max(shown("ci_high", 2)).alias("ci_high"))
        .where(~c("_r.all") | (c("_n") > 1))
        .select("source", "_r.run_a", "_r.run_b", "tasks", "agreement", "delta_points", "ci_low", "ci_high")
    )


def seed_noise(pass_rates: DataFrame) -> DataFrame:
    """Per source: mean and sample sd of the pass rates, and the |delta| of all pairs of passes
    (mean, nearest-rank p90 and p95). Fewer than two passes leave NULLs.

    Rows here are passes, i.e. whole runs over a split; the pairs of those are the statistic.
    """
    rates = pass_rates.where(c("rate").isNotNull()).select("source", "run_id", "rate")
    base = rates.groupBy("source").agg(
        F.count(F.lit(1)).alias("passes"), F.avg("rate").alias("_mean"), F.stddev_samp("rate").alias("_sd")
    )
    other = rates.select("source", c("run_id").alias("run_b"), c("rate").alias("rate_b"))
    deltas = rates.join(other, "source").where(c("run_id") < c("run_b")).select(
        "source", F.abs(c("rate") - c("rate_b")).alias("d")
    )
    spread = deltas.groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.avg("d").alias("abs_delta_mean"))
    pct = scale.exact_quantiles(
        deltas, ["source"], "d", {"abs_delta_p90": scale.nearest_rank(0.90), "abs_delta_p95": scale.nearest_rank(0.95)}
    )
    two = c("passes") >= 2
    return (
        base.join(spread, "source", "left")
        .join(pct, "source", "left")
        .select(
            "source", "passes", F.when(two, c("_mean")).alias("mean_rate"), F.when(two, c("_sd")).alias("sigma_seed"),
            "pairs", "abs_delta_mean", "abs_delta_p90", "abs_delta_p95",
        )
    )


def nearest_rank_pct(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "pct") -> DataFrame:
    """ordered[round(q * (n - 1))] per group, rounding half-even."""
    return scale.exact_quantiles(df, keys, value, {name: scale.nearest_rank(q)})


def _integral(log_height: Callable[[Column], Column], low: Column, high: Column) -> Column:
    """Integral of exp(log_height) between two bounds, by Gauss-Legendre quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(NODES)

    def between(bounds: Column) -> Column:
        def part(x: Column, w: Column) -> Column:
            return w * F.exp(log_height(bounds["low"] + (bounds["high"] - bounds["low"]) * (x + 1) / 2))

        parts = F.zip_with(F.lit(nodes.tolist()), F.lit(weights.tolist()), part)
        return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x) * (bounds["high"] - bounds["low"]) / 2

    return let(F.struct(low.alias("low"), high.alias("high")), between)


def sign_test_p(positive: Column, negative: Column) -> Column:
    """Two-sided binomial sign test on the non-tied pairs; NULL when there are none.

    Of m pairs k have the rarer sign. P(X <= k) is the share of [0, 1/2] in the integral of
    t^(m-k-1) (1-t)^k over [0, 1]. Both halves are taken at the distance u from 1/2 and relative
    to the height there, exp(k log(1 - 4 u^2) + (m - 2k - 1) log(1 -+ 2u)): the left one as far as
    it stays above exp(-40), the right one within ten standard deviations of its peak. The same
    quadrature serves every count, exact for the polynomials of few pairs.
    """

    def named(**values: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in values.items()])

    def height(x: Column, side: int) -> Callable[[Column], Column]:
        return lambda u: x["k"] * F.log1p(-4 * u * u) + x["lean"] * F.log1p(2 * side * u)

    def of_counts(x: Column) -> Column:
        steep = F.greatest(x["m"] - 1, F.lit(1.0))
        reach = 2 * x["lean"] + F.sqrt(4 * x["lean"] * x["lean"] + 320 * (x["m"] - 1))
        at = F.greatest(F.lit(0.0), F.least(F.lit(0.5), x["lean"] / steep / 2))
        bounds = named(reach=F.when(reach > 160, 80 / reach).otherwise(0.5), at=at, steep=steep)
        return let(bounds, lambda y: of_bounds(x, y))

    def of_bounds(x: Column, y: Column) -> Column:
        peak = F.when(y["at"] < 0.5, height(x, 1)(y["at"])).otherwise(x["lean"] * float(np.log(2.0)))
        width = 10 * F.sqrt((0.25 - y["at"] * y["at"] + 1 / y["steep"]) / y["steep"])
        left = _integral(height(x, -1), F.lit(0.0), y["reach"])
        return let(named(peak=peak, left=left, low=F.greatest(F.lit(0.0), y["at"] - width), high=F.least(F.lit(0.5), y["at"] + width)),
                   lambda z: share(x, z))

    def share(x: Column, z: Column) -> Column:
        right = _integral(lambda u: height(x, 1)(u) - z["peak"], z["low"], z["high"])
        return z["left"] / (z["left"] + right * F.exp(z["peak"]))

    m, k = (positive + negative).cast("double"), F.least(positive, negative).cast("double")
    counts = F.when(m > 0, named(m=m, k=k, lean=m - 2 * k - 1))
    return let(counts, lambda x: F.when(x.isNotNull(), F.least(F.lit(1.0), 2 * of_counts(x))))


def sign_test(effects: DataFrame, keys: Sequence[str], value: str = "diff") -> DataFrame:
    counts = effects.groupBy(*keys).agg(
        F.count_if(c(value) > 0).alias("positive"), F.count_if(c(value) < 0).alias("negative")
    )
    return counts.withColumn("p", sign_test_p(c("positive"), c("negative")))


def parity(scores: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Plausibility parity per group: mean paired difference within tolerance and no sign-test
    significance; reasons as text. Groups without scored pairs are not ok."""
    diff = (c("reference_score") - c("coherent_score")).cast("double")
    stats = scores.withColumn("_d", diff).groupBy(*keys).agg(
        F.count("_d").alias("n"),
        F.avg("_d").alias("mean_difference"),
        F.count_if(c("_d") > 0).alias("reference_higher"),
        F.count_if(c("_d") < 0).alias("coherent_higher"),
        F.count_if(c("_d") == 0).alias("ties"),
    )
    stats = stats.withColumn("sign_test_p", sign_test_p(c("reference_higher"), c("coherent_higher")))
    reasons = F.array_compact(
        F.array(
            F.when(c("n") == 0, "no scored pairs"),
            F.when(
                F.abs("mean_difference") > fixed.PARITY_TOLERANCE + fixed.EPS,
                F.concat(F.lit("mean difference "), fixed_digits(c("mean_difference"), 2, plus=True),
                         F.lit(f" outside +-{fixed.PARITY_TOLERANCE}")),
            ),
            F.when(
                c("sign_test_p") < fixed.PARITY_ALPHA,
                F.concat(F.lit("sign test p="), fixed_digits(c("sign_test_p"), 3), F.lit(f" < {fixed.PARITY_ALPHA:.1f}")),
            ),
        )
    )
    return stats.withColumn("reasons", F.concat_ws("; ", reasons)).withColumn("ok", c("reasons") == "")


def pooled_parity(scores: DataFrame) -> DataFrame:
    """Parity per (source, generation round): the first ok round is final, else the last one.

    Adds ``rounds`` (rounds up to the final one) and ``persistent_violation``.
    """
    by_round = parity(scores, ["source", "generation_seed"])
    final = by_round.groupBy("source").agg(
        F.coalesce(F.min(F.when(c("ok"), c("generation_seed"))), F.max("generation_seed")).alias("generation_seed")
    )
    kept = by_round.join(final.withColumnRenamed("generation_seed", "_final"), "source").where(
        c("generation_seed") <= c("_final")
    )
    rounds = kept.groupBy("source").agg(F.count(F.lit(1)).alias("rounds"))
    return (
        by_round.join(final, ["source", "generation_seed"])
        .join(rounds, "source")
        .withColumn("persistent_violation", ~c("ok"))
        .withColumnRenamed("generation_seed", "final_generation_seed")
    )


def sign_flip_p(effects: DataFrame, keys: Sequence[str], value: str = "effect", limit: int = 20) -> DataFrame:
    """Exact two-sided sign-flip permutation test on the mean of a group's effects.

    All 2^N sign vectors, N <= ``limit``; a larger group is an error, raised from the counts
    before anything is collected. A vector and its mirror image have the same |sum|, so the
    first sign is fixed and 2^(N-1) rows per group are spread over the cluster.
    """
    rows = effects.where(c(value).isNotNull())
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bad = F.raise_error(F.lit(f"exact enumeration is limited to n <= {limit} effects"))
    checked = sizes.withColumn("_n", F.when(c("_n") > limit, bad).otherwise(c("_n")))
    groups = (
        rows.join(checked.where(c("_n") <= limit), list(keys))
        .groupBy(*keys, "_n")
        .agg(F.array_sort(F.collect_list(c(value).cast("double"))).alias("_y"))
    )
    last = F.call_function("shiftleft", F.lit(1).cast("bigint"), (c("_n") - 1).cast("int")) - 1
    chunk = 4096
    chunks = groups.withColumn("_last", last).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / chunk))))
    # few rows that grow by a factor of 4096: spread by number, not by size
    tasks = int(effects.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunks.repartition(tasks, *keys, "_chunk")
    codes = spread.withColumn("_code", F.explode(
        F.sequence(c("_chunk") * chunk, F.least(c("_last"), c("_chunk") * chunk + (chunk - 1)))))
    bit = lambda i: F.call_function("shiftright", c("_code"), i) % 2
    signed = F.transform("_y", lambda y, i: F.when(bit(i) == 1, -y).otherwise(y))
    add = lambda acc, y: acc + y
    total = F.abs(F.aggregate(signed, F.lit(0.0), add))
    observed = F.abs(F.aggregate("_y", F.lit(0.0), add))
    hit = total >= observed - 1e-12
    return codes.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.avg(hit.cast("double")).alias("p")
    )
