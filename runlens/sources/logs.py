"""Rollout logs (text) and traces: typed events and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import fixed
from runlens.functions import scale

c = F.col


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, value); ``ord`` follows the lines of a file, also when the file was split."""
    lines = spark.read.text(path)
    order = F.struct(c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(c("_metadata.file_path").alias("file"), order.alias("ord"), "value")


def rollout_log_events(lines: DataFrame) -> DataFrame:
    """Typed events of log lines (file, ord, value); every event is flagged ``partial``.

    Columns: file, ord, sub, kind, step, name, command, exit_code, timed_out, seconds, elapsed,
    prompt_tokens, completion_tokens, total_tokens, error. Lines of no known form are ignored.
    """
    msg = c("msg")

    def group(pattern: str, i: int, type_: str | None = None) -> Column:
        out = F.regexp_extract(msg, pattern, i)
        return out.cast(type_) if type_ else out

    def event(sub: int, kind: str, step: Column, **fields: Column) -> Column:
        types = {
            "name": "string", "command": "string", "exit_code": "int", "timed_out": "boolean", "seconds": "double",
            "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long", "error": "string",
        }
        cols = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
        return F.struct(F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), step.cast("long").alias("step"), *cols)

    shell = F.lit(fixed.SHELL_TOOL)
    model, run, late = fixed.LOG_MODEL, fixed.LOG_SHELL, fixed.LOG_SHELL_TIMEOUT
    code = group(run, 2)
    exit_code = F.when(code.rlike(r"^-*\d+$"), F.expr("try_cast(regexp_extract(msg, '" + run.replace("\\", "\\\\") + "', 2) AS INT)"))
    events = (
        F.when(msg.rlike(model), F.array(event(
            0, "model_call", group(model, 1), seconds=group(model, 2), total_tokens=group(model, 3),
            prompt_tokens=group(model, 4), completion_tokens=group(model, 5))))
        .when(msg.rlike(run), F.array(
            event(0, "tool_call", group(run, 1), name=shell, command=group(run, 4)),
            event(1, "observation", group(run, 1), name=shell, exit_code=exit_code, timed_out=F.lit(False), seconds=group(run, 3))))
        .when(msg.rlike(late), F.array(
            event(0, "tool_call", group(late, 1), name=shell, command=group(late, 3)),
            event(1, "observation", group(late, 1), name=shell, timed_out=F.lit(True), seconds=group(late, 2))))
        .when(msg.rlike(fixed.LOG_FINISH), F.array(event(0, "tool_call", group(fixed.LOG_FINISH, 1), name=F.lit(fixed.FINISH_TOOL))))
        .when(msg.rlike(fixed.LOG_MODEL_ERROR), F.array(event(
            0, "model_call", group(fixed.LOG_MODEL_ERROR, 1), seconds=group(fixed.LOG_MODEL_ERROR, 2), error=group(fixed.LOG_MODEL_ERROR, 3))))
    )
    return (
        _messages(lines)
        .withColumn("_e", F.explode(events))
        .select("file", "ord", "_e.*", "elapsed", F.lit(True).alias("partial"))
    )


def _messages(lines: DataFrame) -> DataFrame:
    known = lines.where(c("value").rlike(fixed.LOG_LINE))
    return known.withColumn("msg", F.regexp_extract("value", fixed.LOG_LINE, 3)).withColumn(
        "elapsed", F.regexp_extract("value", fixed.LOG_LINE, 2).cast("double")
    )


def rollout_log_final(lines: DataFrame) -> DataFrame:
    """Per file: exit_reason, steps, duration_seconds and total_tokens as far as the log tells.

    The last end or model-error line decides the exit; a no-tool line only counts without one.
    """
    msg = c("msg")
    end = msg.rlike(fixed.LOG_END)
    part = lambda i, type_: F.regexp_extract(msg, fixed.LOG_END, i).cast(type_)
    rows = _messages(lines).select(
        "file", "ord",
        F.when(end, part(1, "string")).when(msg.rlike(fixed.LOG_MODEL_ERROR), "model_call_error").alias("_exit"),
        F.when(msg.rlike(fixed.LOG_NO_TOOL), "assistant_no_tool_call").alias("_quiet"),
        F.when(msg.rlike(fixed.LOG_MODEL), F.regexp_extract(msg, fixed.LOG_MODEL, 1).cast("long")).alias("_step"),
        F.when(end, F.struct(part(2, "long").alias("steps"), part(3, "double").alias("secs"), part(4, "long").alias("total"))).alias("_end"),
    )
    last_end = rows.where(c("_end").isNotNull()).groupBy("file").agg(
        F.max("ord").alias("_end_ord"), F.max_by("_end", "ord").alias("_last")
    )
    counted = rows.join(last_end.select("file", "_end_ord"), "file", "left")
    after = F.when(c("_end_ord").isNull() | (c("ord") > c("_end_ord")), c("_step"))
    per_file = counted.groupBy("file").agg(
        F.max_by("_exit", F.when(c("_exit").isNotNull(), c("ord"))).alias("_exit"),
        F.max("_quiet").alias("_quiet"),
        F.max(after).alias("_step"),
    )
    return per_file.join(last_end.drop("_end_ord"), "file", "left").select(
        "file", F.coalesce("_exit", "_quiet").alias("exit_reason"),
        F.greatest(F.coalesce(c("_last.steps"), F.lit(0)), F.coalesce(c("_step"), F.lit(0))).alias("steps"),
        c("_last.secs").alias("duration_seconds"), c("_last.total").alias("total_tokens"),
    )


def scan_rollout_log(spark: SparkSession, path: str) -> DataFrame:
    return rollout_log_events(read_log_lines(spark, path))


def validate_trace(events: DataFrame, version: int = fixed.TRACE_SCHEMA_VERSION, run_id: str | None = None) -> DataFrame:
    """Violations (file, seq, kind): ``seq`` must be contiguous from 1 and, where the events carry
    their ``line``, rise with it; one run id (``run_id`` if given), known version.

    A number without its predecessor is a gap, so contiguity is an anti join on (file, seq)
    rather than an ordered scan of a file; the number on the line before is looked up by blocks of
    lines.
    """
    keyed = events.groupBy("file", "seq").agg(
        F.count(F.lit(1)).alias("_n"), F.min("run_id").alias("_lo"), F.max("run_id").alias("_hi"),
        F.bool_or(c("schema_version") != version).alias("_old"),
    )
    before = keyed.select("file", (c("seq") + 1).alias("seq"))
    gaps = keyed.where(c("seq") != 1).join(before, ["file", "seq"], "left_anti").select("file", "seq", F.lit("gap").alias("kind"))
    run = F.min_by("_lo", "seq") if run_id is None else F.first(F.lit(run_id))
    first = keyed.groupBy("file").agg(run.alias("_run"))
    rows = keyed.join(first, "file")
    kinds = F.array_compact(
        F.array(
            F.when(c("_n") > 1, "duplicate"),
            F.when((c("_lo") != c("_run")) | (c("_hi") != c("_run")), "run_id"),
            F.when(c("_old"), "schema_version"),
        )
    )
    found = gaps.unionByName(rows.select("file", "seq", F.explode(kinds).alias("kind")))
    if "line" not in events.columns:
        return found
    lines = events.select("file", "line", "seq")
    marks = lines.withColumn("ord", c("line"))
    before = scale.prior_value(lines, marks, ["file"], "line", "ord", "seq")
    return found.unionByName(before.where(c("seq") < c("prior_seq")).select("file", "seq", F.lit("order").alias("kind")))
