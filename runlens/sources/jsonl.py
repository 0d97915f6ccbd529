"""Strict JSON readers: a record that does not fit its schema is an error, never a NULL row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import text as tx

c = F.col


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def strict_record(value: Column, ddl: str, required: Sequence[str] = ()) -> Column:
    """The text parsed as one object of the schema; malformed text, non-objects, unknown keys and
    missing required keys raise. The checks guard the record itself, so column pruning cannot
    drop them."""
    schema = _schema(ddl)
    keys = F.json_object_keys(value)
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    record = F.from_json(value, schema, {"mode": "FAILFAST"})
    unknown = F.array_except(keys, names)
    missing = F.array_except(F.array(*[F.lit(r) for r in required]), keys) if required else None
    fail = lambda what: F.raise_error(F.concat(F.lit(what), F.substring(value, 1, 200)))
    out = F.when(keys.isNull() | ~tx.strip(value).startswith("{"), fail("not a JSON object: ")).when(
        F.size(unknown) > 0, fail("unknown field in record: ")
    )
    if missing is not None:
        out = out.when(F.size(missing) > 0, fail("missing field in record: "))
    return out.otherwise(record)


def parse_jsonl_strict(lines: DataFrame, ddl: str, required: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """JSON lines in column ``value`` -> typed rows; blank lines are skipped."""
    rows = lines.where(tx.strip(c("value")) != "").select(*keep, strict_record(c("value"), ddl, required).alias("_r"))
    return rows.select(*keep, "_r.*")


def scan_jsonl_strict(spark: SparkSession, path: str, ddl: str, required: Sequence[str] = ()) -> DataFrame:
    return parse_jsonl_strict(spark.read.text(path), ddl, required)


def _read_texts(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """(file, value): whole small files with their paths."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if name:
        reader = reader.option("pathGlobFilter", name)
    return reader.text(path, wholetext=True).select(c("_metadata.file_path").alias("file"), "value")


def parent(file: Column) -> Column:
    return F.regexp_replace(file, r"/[^/]*$", "")


def records_from_texts(done: DataFrame, scores: DataFrame, ddl: str, score_ddl: str) -> DataFrame:
    """One row per record file, with ``score`` of the sibling score file (NULL without one).

    ``done`` and ``scores``: file, value. Siblings share their parent folder.
    """
    records = done.select(parent(c("file")).alias("folder"), strict_record(c("value"), ddl).alias("_r")).select("folder", "_r.*")
    scored = scores.select(parent(c("file")).alias("folder"), strict_record(c("value"), score_ddl).alias("score"))
    return records.join(scored, "folder", "left")


def scan_json_records(spark: SparkSession, root: str, ddl: str, score_ddl: str) -> DataFrame:
    """All ``done.json`` below ``root`` with their ``score.json``, sorted by task, replicate, attempt."""
    done = _read_texts(spark, root, "done.json")
    scores = _read_texts(spark, root, "score.json")
    return records_from_texts(done, scores, ddl, score_ddl).orderBy("task_id", "replicate", "attempt")


def list_from_text(texts: DataFrame, ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of JSON arrays in column ``value``."""
    items = T.ArrayType(_schema(ddl))
    array = F.when(F.json_array_length("value").isNotNull(), F.from_json("value", items, {"mode": "FAILFAST"})).otherwise(
        F.raise_error(F.concat(F.lit("not a JSON list: "), F.substring("value", 1, 200))))
    return texts.select(*keep, F.explode(array).alias("_r")).select(*keep, "_r.*")


def scan_json_list(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A file holding a JSON array; a missing file is an empty table."""
    try:
        texts = _read_texts(spark, path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _schema(ddl))
    return list_from_text(texts, ddl)
