"""Task sets: normalisation, selection, sampling and disjoint splits.

Seeded picks order rows by SHA-256 of ``seed:stratum:id``: deterministic, independent of input
order, and nested (the sample of m is part of the sample of m + j).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale

c = F.col


def _lookup(mapping: dict[str, str], key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def normalise_tasks(raw: DataFrame) -> DataFrame:
    """Adds source (canary, else id prefix), checked domain and the excluded flag.

    ``raw``: id, domain, canary. Unknown sources, a domain that disagrees with the source, and
    duplicate ids are errors.
    """
    def known(mapping, key):
        return F.when(key.isin(list(mapping)), F.try_element_at(
            F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key))

    source = F.coalesce(
        known(fixed.SOURCE_BY_CANARY, c("canary")),
        known(fixed.SOURCE_BY_PREFIX, F.substring_index(c("id"), "-", 1)),
        F.raise_error(F.concat(F.lit("cannot determine source of task "), c("id"))),
    )
    typed = raw.withColumn("source", source)
    expected = _lookup(fixed.DOMAIN_BY_SOURCE, c("source"))
    typed = typed.withColumn(
        "domain",
        F.when(c("domain") == expected, c("domain")).otherwise(
            F.raise_error(F.concat(F.lit("domain disagrees with source of task "), c("id")))
        ),
    ).withColumn("excluded", ~c("source").isin(fixed.RUNNABLE_SOURCES))
    repeats = raw.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        typed.join(repeats, "id")
        .withColumn("id", F.when(c("_n") == 1, c("id")).otherwise(
            F.raise_error(F.concat(F.lit("duplicate task id "), c("id")))))
        .drop("_n")
    )


def select_tasks(
    tasks: DataFrame,
    domains: Sequence[str] | None = None,
    sources: Sequence[str] | None = None,
    include_excluded: bool = False,
) -> DataFrame:
    out = tasks if include_excluded else tasks.where(~c("excluded"))
    if domains is not None:
        out = out.where(c("domain").isin(list(domains)))
    if sources is not None:
        out = out.where(c("source").isin(list(sources)))
    return out


def public_view(tasks: DataFrame, gold: Sequence[str] = ("evaluator", "raw")) -> DataFrame:
    """Tasks without the gold-bearing scorer block."""
    return tasks.drop(*gold)


def allocate(counts: DataFrame, n: int, stratum: str = "source", size: str = "n") -> DataFrame:
    """Largest-remainder quota per stratum (ties: larger fraction, then name).

    ``counts`` has one row per stratum, so its global order is a small sort.
    """
    if n < 0:
        raise ValueError("sample size must be non-negative")
    total = counts.agg(F.coalesce(F.sum(size), F.lit(0)).alias("t")).scalar()
    too_many = F.raise_error(F.lit(f"cannot sample {n} tasks: fewer are eligible"))
    quotas = (
        counts.withColumn("_total", total)
        .withColumn("_q", F.when(F.lit(n) > c("_total"), too_many).otherwise(F.lit(n) * c(size) / c("_total")))
        .withColumn("_floor", F.floor("_q"))
    )
    everyone = Window.partitionBy(F.lit(0))
    ranked = quotas.withColumn("_left", F.lit(n) - F.sum("_floor").over(everyone)).withColumn(
        "_rn", F.row_number().over(everyone.orderBy((c("_q") - c("_floor")).desc(), c(stratum)))
    )
    quota = c("_floor") + F.when(c("_rn") <= c("_left"), 1).otherwise(0)
    return ranked.select(stratum, size, quota.cast("bigint").alias("quota"))


def _eligible(tasks: DataFrame, seed: int, stratum: str) -> DataFrame:
    return tasks.where(~c("excluded")).withColumn("_h", scale.seeded_hash(seed, c(stratum), c("task_id")))


def stratified_sample(tasks: DataFrame, n: int, seed: int, stratum: str = "source") -> DataFrame:
    """``n`` non-excluded tasks, allocated over the strata by largest remainder."""
    eligible = _eligible(tasks, seed, stratum)
    quota = allocate(eligible.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), n, stratum)
    with_quota = eligible.join(quota.select(stratum, "quota"), stratum)
    return scale.hash_rank(with_quota, [stratum], "_h", ["task_id"], "_rn", "quota").drop("_h", "_rn", "quota")


def sample_per_source(tasks: DataFrame, per_source: int, seed: int, stratum: str = "source") -> DataFrame:
    """``per_source`` tasks of every stratum; a stratum that is too small is an error."""
    eligible = _eligible(tasks, seed, stratum)
    sizes = eligible.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    small = F.raise_error(F.concat(F.lit(f"cannot sample {per_source} tasks in "), c(stratum)))
    ranked = scale.hash_rank(eligible, [stratum], "_h", ["task_id"], "_rn", per_source)
    return (
        ranked.join(sizes, stratum)
        .where(F.when(c("_size") < per_source, small).otherwise(F.lit(True)))
        .drop("_h", "_rn", "_size")
    )


def build_splits(tasks: DataFrame, eval_dev: int, heldout: int, seed: int) -> DataFrame:
    """Long table (source, split, task_id): validation, eval_dev and heldout, disjoint.

    ``tasks`` carries ``split`` (validation or evaluation). The held-out sample is drawn from
    the evaluation tasks left after eval_dev.
    """
    keep = ["source", "task_id"]
    validation = tasks.where((c("split") == "validation") & ~c("excluded")).select(*keep)
    evaluation = tasks.where(c("split") == "evaluation")
    dev = sample_per_source(evaluation, eval_dev, seed)
    rest = evaluation.join(dev.select(*keep), keep, "left_anti")
    held = sample_per_source(rest, heldout, seed)
    out = validation.withColumn("split", F.lit("validation"))
    for part, name in ((dev, "eval_dev"), (held, "heldout")):
        out = out.unionByName(part.select(*keep).withColumn("split", F.lit(name)))
    return out.select("source", "split", "task_id")


def eval_rest(tasks: DataFrame, splits: DataFrame) -> DataFrame:
    """Usable evaluation tasks in none of the splits."""
    usable = tasks.where((c("split") == "evaluation") & ~c("excluded")).select("source", "task_id")
    return usable.join(splits.select("source", "task_id"), ["source", "task_id"], "left_anti")


def mining_pool(splits: DataFrame, with_rest: bool = False) -> DataFrame:
    names = ["validation", "eval_dev", *(["eval_rest"] if with_rest else [])]
    return splits.where(c("split").isin(names)).select("source", "task_id").distinct()


def all_tasks(validation: DataFrame, evaluation: DataFrame) -> DataFrame:
    return validation.unionByName(evaluation)


def split_overlaps(splits: DataFrame) -> DataFrame:
    """Task ids in more than one split of their source (none for valid splits)."""
    pairs = splits.select("source", "task_id", "split").distinct()
    return (
        pairs.groupBy("source", "task_id").agg(F.count(F.lit(1)).alias("splits")).where(c("splits") > 1)
    )


def split_sizes(splits: DataFrame) -> DataFrame:
    return splits.groupBy("source", "split").agg(F.count(F.lit(1)).alias("tasks"))


def common_tasks(task_passes: DataFrame, keys: Sequence[str] = ("source", "task_id")) -> DataFrame:
    """Tasks present in every pass of their source."""
    passes = task_passes.select("source", "run_id").distinct().groupBy("source").agg(
        F.count(F.lit(1)).alias("_passes")
    )
    seen = task_passes.select(*keys, "run_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_seen"))
    return seen.join(passes, "source").where(c("_seen") == c("_passes")).select(*keys)


def failure_subset(failures: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` failures with an equal quota per source; leftovers fill in (run, key) order.

    All failures when there are at most ``n``. ``failures``: source, run_id, failure_key.
    """
    cols = ["source", "run_id", "failure_key"]
    sizes = failures.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(F.struct(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("all"), F.greatest(F.lit(1), F.count(F.lit(1))).alias("sources")
    )).scalar()
    quota = F.when(totals["all"] <= n, totals["all"]).otherwise(F.floor(F.lit(n) / totals["sources"])).cast("bigint")
    taken = sizes.agg(F.coalesce(F.sum(F.least(c("_n"), quota)), F.lit(0))).scalar()
    rows = failures.select(*cols).withColumn("_h", scale.seeded_hash(seed, *[c(x) for x in cols])).withColumn("_quota", quota)
    first = scale.hash_rank(rows, ["source"], "_h", ["run_id", "failure_key"], "_rn", "_quota").select(*cols)
    order = ["run_id", "failure_key", "source"]
    rest = failures.select(*cols).join(first, cols, "left_anti").orderBy(*order).limit(n)
    fill = (
        rest.withColumn("_rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        .where(c("_rn") <= F.lit(n) - taken)
        .select(*cols)
    )
    return first.unionByName(fill)


def calibration_sample(records: DataFrame, n: int, seed: str = "b7") -> DataFrame:
    """Equal quota per source of scored, non-infrastructure artifacts, at most ``n`` in all."""
    usable = records.where(c("passed").isNotNull() & (c("error_family") != "infra"))
    key = [c("source"), c("run_id"), c("task_id"), c("replicate"), c("attempt")]
    sources = usable.select("source").distinct().agg(F.greatest(F.lit(1), F.count(F.lit(1)))).scalar()
    rows = usable.withColumn("_h", scale.seeded_hash(seed, *key)).withColumn(
        "_quota", F.greatest(F.lit(1), F.floor(F.lit(n) / sources)).cast("bigint")
    )
    ranked = scale.hash_rank(rows, ["source"], "_h", ["run_id", "task_id", "replicate", "attempt"], "_rn", "_quota")
    return ranked.orderBy("source", "_rn").limit(n).drop("_h", "_rn", "_quota")
