"""Run folders selected by their strict names, file trees hashed, report tables written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import scale

c = F.col


def parse_run_names(runs: DataFrame, prefix: str, name: str = "run_id") -> DataFrame:
    """Keeps names ``<prefix>-<block>-<source>-p<n>`` (``-ref`` marks reference runs) and adds
    block, source, pass and is_ref. Blocks hold no dash, sources may."""
    pattern = rf"^\Q{prefix}\E-([^-]+)-(.+)-p(\d+)(-ref)?$"
    part = lambda i: F.regexp_extract(name, pattern, i)
    return (
        runs.where(c(name).rlike(pattern))
        .withColumn("block", part(1))
        .withColumn("source", part(2))
        .withColumn("pass", part(3).cast("int"))
        .withColumn("is_ref", part(4) != "")
    )


def select_runs(runs: DataFrame, prefix: str, block: str, source: str, reference: bool = False) -> DataFrame:
    """Passes of one block and source in pass order; reference runs only on request."""
    parsed = parse_run_names(runs, prefix)
    return parsed.where((c("block") == block) & (c("source") == source) & (c("is_ref") == reference)).orderBy("pass")


def scan_runs(spark: SparkSession, root: str, prefix: str, block: str, source: str, reference: bool = False, marker: str = "manifest.json") -> DataFrame:
    """Run folders below ``root`` that hold the marker file."""
    files = (
        spark.read.format("binaryFile").load(f"{root}/*/{marker}").select(c("path").alias("file"))
    )
    names = files.select(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("run_id"), "file")
    return select_runs(names, prefix, block, source, reference)


def table_hash(files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, members, digest): content hash of the files of a group, independent of their order.

    ``files``: path, content (binary). Files sort by path parts; each contributes path, size and
    SHA-256 of its content to a two-level digest (``scale.member_digest``).
    """
    nul = F.lit("\u0000")
    text = F.concat(c("path"), nul, F.octet_length("content").cast("string"), nul, F.sha2("content", 256))
    rows = files.select(*keys, F.struct(F.split("path", "/").alias("k"), text.alias("text")).alias("item"))
    return scale.member_digest(
        rows, keys, "item", lambda items: F.sha2(F.concat_ws("", items), 256), lambda x: x["text"]
    )


def scan_table_hash(spark: SparkSession, root: str) -> DataFrame:
    """Hash of the file tree below ``root``, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}\E/", "")
    return table_hash(files.select(F.lit(root).alias("root"), relative.alias("path"), "content"), ["root"])


def report_line(columns: Sequence[str], df: DataFrame) -> Column:
    """One CSV line: NULL as empty text, quoting only where needed."""
    def field(name: str) -> Column:
        text = F.coalesce(c(name).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text)

    return F.concat_ws(",", *[field(x) for x in columns])


def write_report_csv(df: DataFrame, path: str, keys: Sequence[str], single_file: bool = False) -> None:
    """Header, LF line ends, NULL as empty text, rows ordered by ``keys``.

    Ordered part files; ``single_file`` puts a report table of few rows into one.
    """
    ordered = df.orderBy(*keys)
    if single_file:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").option("header", "true").option("lineSep", "\n").option("escape", '"').option("nullValue", "").option(
        "emptyValue", ""
    ).csv(path)
