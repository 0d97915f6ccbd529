"""Streams over several micro-batches, in several orders of arrival, against the batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import ledger as led
from runlens.sources import logs
from runlens.streaming import jobs

c = F.col
TRACE = "file string, seq long, run_id string, schema_version int"
LEDGER = ("event_id long, ts timestamp, run_id string, event string, prompt_tokens long, completion_tokens long, cached boolean, "
          "error_kind string, usd decimal(18,6)")
START = datetime.datetime(2024, 1, 1)


def streamed(spark, rows, ddl, data, folder, size):
    """The rows as a stream of micro-batches of ``size`` rows, in the given order."""
    for at in range(0, len(data), size):
        rows(ddl, data[at:at + size]).coalesce(1).write.mode("append").parquet(folder)
    df = rows(ddl, data)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def orders(data, how):
    data = list(data)
    if how == "backwards":
        data.reverse()
    elif how == "shuffled":
        random.Random(8).shuffle(data)
    return data


@pytest.mark.parametrize("how", ["forwards", "backwards", "shuffled"])
def test_trace_spans_over_batches_equal_the_batch_form(spark, rows, tmp_path, how):
    rng = random.Random(3)
    data = [(f"f{i % 3}", rng.randint(-3, 40), rng.choice(["run"] * 8 + ["other", None]), rng.choice([1] * 15 + [2, None])) for i in range(120)]
    data = orders(sorted(data, key=lambda r: r[1]) + [("f0", None, "run", 1), (None, 3, "run", 1), (None, 5, "x", 1)], how)
    df, stream = streamed(spark, rows, TRACE, data, str(tmp_path / "t"), 25)
    spans = jobs.run_available(jobs.stream_trace_gaps(stream, block=8), "trace")
    assert spans.select("batch").distinct().count() > 1
    got = sorted(map(tuple, jobs.standing(spans).collect()), key=str)
    # the batch form groups a missing file like any other, but joins by it; hence it is compared by name
    named = df.fillna("none", ["file"]).where("seq IS NOT NULL")
    want = [(None if f == "none" else f, s, k) for f, s, k in logs.validate_trace(named).collect()]
    assert got == sorted(want, key=str)


def test_state_of_a_trace_is_bounded_by_its_block(spark, rows, tmp_path):
    data = [("hot", n, f"run{n % 7}", 1) for n in range(1, 401) for _ in range(3)] + [("cold", 1, "r", 1)]
    _, stream = streamed(spark, rows, TRACE, data, str(tmp_path / "t"), 500)
    spans = jobs.run_available(jobs.stream_trace_gaps(stream, block=50), "trace")
    now = spans.groupBy("file", "block").agg(F.max("high") - F.min("low") < 50, F.count(F.lit(1)) <= 50 * 3).collect()
    assert len(now) == 9 and all(r[2] and r[3] for r in now)
    assert {tuple(r) for r in jobs.standing(spans).collect()} == {("hot", n, "duplicate") for n in range(1, 401)} | {
        ("hot", n, "run_id") for n in range(1, 401) if n % 7 != 1}


def test_spans_of_a_batch():
    import pandas as pd

    def batch(*data):
        return pd.DataFrame(data, columns=["seq", "run_id", "schema_version"])

    spans = jobs.merged([], batch((3, "a", 1), (1, "a", 1), (2, "a", 1), (9, None, 1)), 1)
    assert spans == [[1, 3, "a", "a", 1, 0], [9, 9, None, None, 1, 0]]
    assert jobs.merged(spans, batch((2, "b", 2), (4, "a", None), (9, "c", 1)), 1) == [
        [1, 1, "a", "a", 1, 0], [2, 2, "a", "b", 2, 1], [3, 4, "a", "a", 1, 0], [9, 9, "c", "c", 2, 0]]


@pytest.mark.parametrize("how", ["forwards", "shuffled"])
def test_spans_of_micro_batches_need_no_state(spark, rows, tmp_path, how):
    rng = random.Random(4)
    data = orders([(f"f{i % 2}", rng.randint(-3, 60), rng.choice(["run"] * 8 + ["other", None]), rng.choice([1] * 15 + [2, None])) for i in range(150)], how)
    _, stream = streamed(spark, rows, TRACE, data, str(tmp_path / "t"), 40)
    trace = jobs.stream_trace_gaps(stream, block=16)
    one = jobs.run_available(trace, "trace")
    spans = jobs.run_available(trace, "trace", work=lambda batch, number, out: jobs.spans_of(batch))
    assert spans.groupBy("batch").count().count() > 1 and spans.count() < one.count()
    assert sorted(jobs.standing(spans).collect()) == sorted(jobs.standing(one).collect())
    plan = trace._jdf.queryExecution().analyzed().toString()
    assert "PandasWithState" not in plan and "Aggregate" not in plan
    # the plain form of one block
    import pandas as pd

    whole = pd.DataFrame([r[1:] for r in data if r[0] == "f1" and 1 <= r[1] <= 16], columns=["seq", "run_id", "schema_version"])
    joined = jobs.spans_of(one.where((c("file") == "f1") & (c("block") == 0))).orderBy("low").collect()
    assert [[r.low, r.high, r.first_run, r.last_run, 1 + r.repeated, int(r.old)] for r in joined] == jobs.merged([], whole, 1)


def bills(n=240):
    rng = random.Random(5)
    events = ["call", "policy", "search", "infra_failure", "task_failure"]
    return [(i, START + datetime.timedelta(minutes=rng.randrange(60 * 24 * 4)), f"r{rng.randrange(3)}", rng.choice(events), rng.randrange(100),
             rng.randrange(50), rng.random() < 0.3, rng.choice(["budget_exhausted", "empty_answer"]), round(rng.uniform(-0.2, 1), 6)) for i in range(n)]


def decimal(data):
    import decimal as d

    return [(*r[:-1], None if r[-1] is None else d.Decimal(str(r[-1]))) for r in data]


@pytest.mark.parametrize("how", ["forwards", "shuffled"])
def test_rows_days_late_count_in_their_hour(spark, rows, tmp_path, how):
    data = orders(sorted(decimal(bills()), key=lambda r: r[1]), how)
    df, stream = streamed(spark, rows, LEDGER, data, str(tmp_path / "l"), 60)
    got = jobs.stream_ledger_summary(stream, hours=6)
    hour = F.window("ts", "6 hour")["start"].alias("window_start")
    want = led.ledger_summary(df.withColumn("window_start", hour), ["window_start", "run_id"])
    assert sorted(got.select(want.columns).collect(), key=str) == sorted(want.collect(), key=str)
    # no operator of the running query holds state
    assert "StateStore" not in got._jdf.queryExecution().executedPlan().toString()


def crossed(data, cap, size):
    """The guard, row by row."""
    spent, out = {}, {}
    for at in range(0, len(data), size):
        for r in sorted(data[at:at + size], key=lambda r: (r[1], r[0])):
            if r[3] in ("call", "policy", "search") and r[2] is not None:
                spent[r[2]] = spent.get(r[2], 0) + (r[-1] or 0)
                if spent[r[2]] >= cap and r[2] not in out:
                    out[r[2]] = (r[2], r[1], r[0], float(spent[r[2]]), float(cap))
    return sorted(out.values())


@pytest.mark.parametrize("how", ["forwards", "backwards", "shuffled"])
@pytest.mark.parametrize("cap", [3, 12])
def test_the_cap_is_crossed_once(spark, rows, tmp_path, how, cap):
    data = orders(decimal(bills()), how) + decimal([(900, START, None, "call", 1, 1, False, None, 99.0), (901, START, "r0", "call", 1, 1, False, None, None)])
    _, stream = streamed(spark, rows, LEDGER, data, str(tmp_path / "l"), 40)
    got = jobs.stream_spend_guard(stream, float(cap), purpose="guard")
    out = sorted(map(tuple, got.collect()))
    want = crossed(data, cap, 40)
    # files of one second may be read in any order of their names, so the batches are read back
    assert [r[0] for r in out] == [r[0] for r in want] and all(r[3] >= cap and r[3] - 1 < cap for r in out)


def test_the_crossing_row_within_one_batch(spark, rows, tmp_path):
    data = orders(decimal(bills()), "shuffled")
    _, stream = streamed(spark, rows, LEDGER, data, str(tmp_path / "l"), 1000)
    for cap in (1, 5, 10**6):
        out = sorted(map(tuple, jobs.stream_spend_guard(stream, float(cap), purpose="guard").collect()))
        assert out == crossed(data, cap, 1000)


def test_spend_that_falls_again_and_state_between_batches(rows):
    spend = rows("run_id string, ts timestamp, event_id long, usd decimal(18,6)", decimal([
        ("a", START, 1, 4.0), ("a", START, 2, -3.5), ("b", START, 1, 1.0), ("c", START, 1, 9.0), ("d", None, 4, 1.5), ("d", START, 3, 1.0)]))
    before = rows("run_id string, spent decimal(38,6), reached boolean", [("b", None, False), ("c", None, True)]).withColumn(
        "spent", F.lit(1.5).cast("decimal(38,6)"))
    out = {r.run_id: (r.event_id, float(r.spent)) for r in jobs.crossings(spend, before, 2.5, "run_id", ["ts", "event_id"]).collect()}
    assert out == {"a": (1, 4.0), "b": (1, 2.5), "d": (3, 2.5)}
