"""Scalar text, JSON and number helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import fixed

ELLIPSIS = "…"


#: White space and line ends as Python's strip and splitlines see them (fixed values).
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def lines(text: Column) -> Column:
    """The lines of a text, at every kind of line end."""
    return F.split(text, LINE_END)


def collapse(text: Column) -> Column:
    """Whitespace runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(text, f"{WHITE}+", " "))


def head(text: Column, limit: int) -> Column:
    """Collapsed text, cut to ``limit`` characters with an ellipsis as the last one."""
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(
        F.concat(F.substring(flat, 1, limit - 1), F.lit(ELLIPSIS))
    )


def one_line(text: Column, limit: int = 100) -> Column:
    return head(text, limit)


def normalise_command(command: Column) -> Column:
    """Collapsed shell command without a trailing ``;`` or ``&& true``."""
    return F.regexp_replace(collapse(command), r"(\s*;\s*|\s*&&\s*true\s*)$", "")


def classify_shell(command: Column) -> Column:
    """Mutating pattern first, then opaque (interpreters and scripts), else read-only."""
    return (
        F.when(command.rlike("(?U)" + fixed.MUTATING_SHELL), F.lit("shell_mut"))
        .when(command.rlike("(?U)" + fixed.OPAQUE_SHELL), F.lit("shell_opaque"))
        .otherwise(F.lit("shell_ro"))
    )


def is_read_only_tool(name: Column) -> Column:
    return name.rlike(fixed.READ_ONLY_TOOL)


def failure_key(task: Column, replicate: Column, attempt: Column) -> Column:
    return F.concat_ws("/", task.cast("string"), replicate.cast("string"), attempt.cast("string"))


def split_failure_key(key: Column) -> tuple[Column, Column, Column]:
    """Task, replicate and attempt, split from the right: task ids may hold slashes."""
    pattern = r"^(.*)/([^/]*)/([^/]*)$"
    return (
        F.regexp_extract(key, pattern, 1),
        F.regexp_extract(key, pattern, 2),
        F.regexp_extract(key, pattern, 3).cast("int"),
    )


def json_string(text: Column) -> Column:
    """A canonical JSON string literal: short escapes, everything outside printable ASCII as \\uxxxx."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.when(text.rlike("[^ -~]"), _escape_units(text)).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _escape_units(text: Column) -> Column:
    """Escape UTF-16 code units one by one (surrogate pairs for the upper planes)."""
    quads = F.regexp_extract_all(
        F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit(r"([0-9a-f]{4})"), F.lit(1)
    )
    short = {34: '\\"', 92: "\\\\", 8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}

    def unit(q: Column) -> Column:
        out = F.when(q == F.lit("0022"), F.lit(short[34]))
        for number, escape in short.items():
            out = out.when(q == F.lit(f"{number:04x}"), F.lit(escape))
        plain = q.between("0020", "007e")
        return out.when(plain, F.char(F.conv(q, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), q))

    return F.concat_ws("", F.transform(quads, unit))


def json_list(items: Column) -> Column:
    """Canonical JSON list of an array of strings."""
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(items, json_string)), F.lit("]"))


def json_object_text(text: Column) -> Column:
    """The JSON object inside free text: code fence first, outermost braces as the fallback.

    NULL when no object can be parsed.
    """
    stripped = strip(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(stripped, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    whole = F.when(fenced != "", fenced).otherwise(stripped)
    braces = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)

    def parsed(candidate: Column) -> Column:
        ok = F.json_object_keys(candidate).isNotNull() & candidate.startswith("{")
        return F.when(ok, candidate)

    return F.coalesce(parsed(whole), parsed(braces))


def round6(value: Column) -> Column:
    return F.round(value.cast("double"), 6)
