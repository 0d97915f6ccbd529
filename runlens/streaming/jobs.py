"""Structured Streaming forms: ledger totals per hour, the spend guard and trace gaps.

Results of every micro-batch go to their own folder of a table in the shared checkpoint folder,
overwritten on a retry, so a lost executor or a restarted query never doubles rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale
from runlens.operators.ledger import partial_columns, summed
from runlens.session import shared_dir

c = F.col

#: Numbers of a trace that are joined to spans together.
BLOCK = 4096


def run_available(stream: DataFrame, purpose: str, mode: str = "append",
                  work: Callable[[DataFrame, int, str], DataFrame] | None = None) -> DataFrame:
    """Processes what is there, then returns the rows of all micro-batches (with ``batch``).

    ``work`` (batch, its number, folder of the job) gives the rows to keep of a micro-batch; by
    default they are the batch itself.
    """
    spark = stream.sparkSession
    out = shared_dir(spark, purpose)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if work is None else work(batch, number, out)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


# ------------------------------------------------------------------ ledger


def hourly_partials(batch: DataFrame, hours: int = 1) -> DataFrame:
    """Totals of one micro-batch per run and tumbling window, money still as DECIMAL."""
    window = F.window("ts", f"{hours} hour").alias("window")
    totals = batch.groupBy(window, "run_id").agg(*partial_columns())
    return totals.select(c("window.start").alias("window_start"), "*").drop("window")


def stream_ledger_summary(ledger: DataFrame, hours: int = 1, purpose: str = "ledger") -> DataFrame:
    """Ledger totals per run and tumbling window of a stream.

    Every micro-batch adds its partial totals, exact ones, and the table is their sum. There is no
    state that could grow and no watermark that could drop a row: a row days late is one more
    partial total of its hour. Rows without ``ts`` belong to no window.
    """
    parts = run_available(ledger, purpose, work=lambda batch, number, out: hourly_partials(batch, hours))
    return summed(parts, ["window_start", "run_id"])


# ------------------------------------------------------------------ spend guard


def crossings(spend: DataFrame, before: DataFrame, cap: float, key: str, order: Sequence[str]) -> DataFrame:
    """(key, order columns, spent): the row of each stage with which its spend reaches the cap.

    ``before``: key, spent, reached. Running sums are taken in the order of the rows, the first
    order column a timestamp, and only for stages that can reach the cap at all: a stage's rows
    are cut into hours, so one that holds a third of all rows is no single task.
    """
    ups = spend.groupBy(key).agg(F.sum(F.greatest(c("usd"), F.lit(0))).alias("_up"))
    near = ups.join(before, key, "left").where(~F.coalesce(c("reached"), F.lit(False)) & (F.coalesce(c("spent"), F.lit(0)) + c("_up") >= cap))
    rows = spend.join(near.select(key, F.coalesce(c("spent"), F.lit(0)).alias("_spent")), key)
    hour = F.coalesce(F.floor(F.unix_timestamp(c(order[0])) / 3600), F.lit(-(2**40)))
    running = scale.bucketed_running_sum(rows, [key], hour, [c(x) for x in order], "usd", "_earlier")
    total = c("_spent") + c("_earlier") + c("usd")
    first = running.where(total >= cap).groupBy(key).agg(
        F.min(F.struct(*order, total.cast("decimal(38,6)").alias("spent"))).alias("_row"))
    return first.select(key, "_row.*")


def stream_spend_guard(ledger: DataFrame, cap: float, key: str = "run_id", order: Sequence[str] = ("ts", "event_id"),
                       purpose: str = "spend") -> DataFrame:
    """(key, order columns, spent, cap): for each stage the row with which its spend reached the cap, once.

    Spend counts in order of arrival: by micro-batch, and within one by ``order``. Between
    micro-batches one row per stage is kept (its spend, and whether the cap was reached), written
    anew under the number of the batch, so a batch that is run again starts from the same state.
    """

    def guard(batch: DataFrame, number: int, out: str) -> DataFrame:
        spark = batch.sparkSession
        spend = batch.where(c("event").isin(fixed.SPEND_EVENTS) & c(key).isNotNull()).select(
            key, *order, F.coalesce(c("usd"), F.lit(0)).cast("decimal(18,6)").alias("usd"))
        kinds = f"{key} {batch.schema[key].dataType.simpleString()}, spent decimal(38,6), reached boolean"
        before = spark.read.schema(kinds).parquet(f"{out}/spent/batch={number - 1}") if number else spark.createDataFrame([], kinds)
        crossed = crossings(spend, before, cap, key, order)
        new = spend.groupBy(key).agg(F.sum("usd").alias("_new"))
        after = before.join(new, key, "full").join(crossed.select(key, F.lit(True).alias("_now")), key, "left").select(
            key, (F.coalesce("spent", F.lit(0)) + F.coalesce("_new", F.lit(0))).cast("decimal(38,6)").alias("spent"),
            (F.coalesce("reached", F.lit(False)) | F.coalesce("_now", F.lit(False))).alias("reached"))
        after.write.mode("overwrite").parquet(f"{out}/spent/batch={number}")
        return crossed.withColumn("spent", c("spent").cast("double")).withColumn("cap", F.lit(float(cap)))

    return run_available(ledger, purpose, work=guard).drop("batch")


# ------------------------------------------------------------------ trace gaps

_LAST = "\U0010ffff"


def _rows_of(spans: Sequence[Sequence]) -> pd.DataFrame:
    """One row per number of the spans."""
    rows = [(n, *span[2:]) for span in spans for n in range(span[0], span[1] + 1)]
    return pd.DataFrame(rows, columns=["seq", "first_run", "last_run", "n", "old"])


def _spans_of(rows: pd.DataFrame) -> list[list]:
    """Stretches [low, high, first_run, last_run, n, old] of neighbouring numbers with equal values."""
    out: list[list] = []
    for seq, *values in rows.itertuples(index=False, name=None):
        if out and out[-1][1] == seq - 1 and out[-1][2:] == values:
            out[-1][1] = seq
        else:
            out.append([seq, seq, *values])
    return out


def merged(spans: Sequence[Sequence], batch: pd.DataFrame, version: int) -> list[list]:
    """The spans of one block with the rows (seq, run_id, schema_version) of a batch added: ``spans_of``, for rows at hand.

    Of the run ids of a number the smallest and the greatest are kept, of its rows whether there
    is more than one (n = 2), so that the block bounds the size.
    """
    runs = batch["run_id"]
    new = pd.DataFrame({
        "seq": batch["seq"], "first_run": runs.fillna(_LAST), "last_run": runs.fillna(""), "n": 1,
        "old": (batch["schema_version"].notna() & (batch["schema_version"] != version)).astype(int)})
    known = _rows_of(spans)
    known["first_run"], known["last_run"] = known["first_run"].fillna(_LAST), known["last_run"].fillna("")
    rows = pd.concat([known, new]) if len(known) else new
    rows = rows.groupby("seq", as_index=False).agg(
        first_run=("first_run", "min"), last_run=("last_run", "max"), n=("n", "sum"), old=("old", "max"))
    rows["n"] = rows["n"].clip(upper=2)
    nameless = rows["first_run"] == _LAST
    for name in ("first_run", "last_run"):
        rows[name] = rows[name].astype(object).where(~nameless, None)
    return [[int(low), int(high), first, last, int(n), int(old)] for low, high, first, last, n, old in _spans_of(rows)]


def stream_trace_gaps(trace: DataFrame, key: str = "file", version: int = fixed.TRACE_SCHEMA_VERSION, block: int = BLOCK) -> DataFrame:
    """The numbers of a trace stream as spans of one number each, in any order of arrival.

    (file, block, low, high, first_run, last_run, repeated, old). ``spans_of`` joins those of a
    micro-batch, ``standing`` reads them with or without it. The numbers of a file are cut into
    blocks, so one file that holds a third of all rows is many groups. There is no state that could
    grow: every micro-batch adds its spans. Rows without a number are left out. ``trace``: file,
    seq, run_id, schema_version.
    """
    seq = c("seq").cast("long")
    return trace.where(c("seq").isNotNull()).select(
        c(key).alias("file"), F.floor((seq - 1) / block).alias("block"), seq.alias("low"), seq.alias("high"),
        c("run_id").alias("first_run"), c("run_id").alias("last_run"), F.lit(False).alias("repeated"),
        F.coalesce(c("schema_version") != version, F.lit(False)).alias("old"))


def spans_of(spans: DataFrame) -> DataFrame:
    """The same numbers, each once, as the longest spans within a block that are alike in all columns.

    Of the run ids of a number the smallest and the greatest are kept; it is repeated if more than
    one span has it. Rows of one number meet in an aggregation, the numbers of a block, at most as many as it has, in a window.
    """
    each = spans.select("file", "block", F.explode(F.sequence("low", "high")).alias("seq"), "first_run", "last_run", "repeated", "old")
    numbers = each.groupBy("file", "block", "seq").agg(
        F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"),
        ((F.count(F.lit(1)) > 1) | F.bool_or("repeated")).alias("repeated"), F.bool_or("old").alias("old"))
    inside = Window.partitionBy("file", "block").orderBy("seq")
    alike = F.struct("first_run", "last_run", "repeated", "old")
    begins = ~(F.lag("seq").over(inside).eqNullSafe(c("seq") - 1) & F.lag(alike).over(inside).eqNullSafe(alike))
    counted = numbers.withColumn("_begins", begins.cast("int")).withColumn("_span", F.sum("_begins").over(inside))
    return counted.groupBy("file", "block", "_span").agg(
        F.min("seq").alias("low"), F.max("seq").alias("high"),
        *[F.first(x).alias(x) for x in ("first_run", "last_run", "repeated", "old")]).drop("_span")


def standing(spans: DataFrame) -> DataFrame:
    """The violations (file, seq, kind) that are open after all micro-batches, by the rules of the batch form.

    A span whose predecessor no span of the file ends with, be it of the same block or of the one
    before, follows a gap. The joined spans are written once, as several steps read them.
    """
    out = shared_dir(spans.sparkSession, "spans")
    joined = spans_of(spans)
    joined.write.mode("overwrite").parquet(out)
    now = spans.sparkSession.read.schema(joined.schema).parquet(out)
    ends = now.select(c("file").alias("_file"), (c("high") + 1).alias("_seq"))
    gaps = now.where(c("low") != 1).join(ends, c("file").eqNullSafe(c("_file")) & (c("low") == c("_seq")), "left_anti").select(
        "file", c("low").alias("seq"), F.lit("gap").alias("kind"))
    first = now.groupBy(c("file").alias("_file")).agg(F.min_by("first_run", "low").alias("_run"))
    rows = now.join(first, c("file").eqNullSafe(c("_file")))
    kinds = F.array_compact(F.array(
        F.when(c("repeated"), "duplicate"),
        F.when((c("first_run") != c("_run")) | (c("last_run") != c("_run")), "run_id"),
        F.when(c("old"), "schema_version"),
    ))
    found = rows.select("file", "low", "high", F.explode(kinds).alias("kind"))
    return gaps.unionByName(found.select("file", F.explode(F.sequence("low", "high")).alias("seq"), "kind"))


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder or a single file as a stream, with the schema of what is there now.

    The file source watches folders, so a single file is read through its folder by name.
    """
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema)
    if [f.rpartition("/")[2] for f in table.inputFiles()] == [name]:
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)
