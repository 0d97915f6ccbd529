"""Shell command lines as arrays of words, and the paths a command writes to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import fixed

#: Parts of a word: quoted literally, quoted with escapes, an escaped character, or plain characters.
LITERAL, ESCAPING, ESCAPED, PLAIN = r"'[^']*'", r'"(?:\\.|[^"\\])*"', r"\\.", r"""[^\s'"\\]+"""
PART = f"(?s)(?:{LITERAL}|{ESCAPING}|{ESCAPED}|{PLAIN})"


def words(command: Column) -> Column:
    """The words of a command after quote removal; split at blanks where quotes are not closed."""
    def unquoted(part: Column) -> Column:
        inner = F.substr(part, F.lit(2), F.length(part) - 2)
        return (
            F.when(part.startswith("'"), inner)
            .when(part.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1"))
            .when(part.startswith("\\"), F.substr(part, F.lit(2)))
            .otherwise(part)
        )

    quoted = F.regexp_extract_all(command, F.lit(f"{PART}+"), F.lit(0))
    plain = F.transform(quoted, lambda w: F.concat_ws("", F.transform(
        F.regexp_extract_all(w, F.lit(PART), F.lit(0)), unquoted)))
    closed = F.regexp_replace(command, rf"{PART}|\s", "") == ""
    return F.when(closed, plain).otherwise(F.filter(F.split(command, r"\s+"), lambda w: w != ""))


def write_targets(command: Column) -> Column:
    """Sorted distinct paths a mutating command writes to, comma-separated.

    Targets of redirections count; a copying command writes to its last argument, the last word of
    the line (where the line ends in an operator: its second argument); commands such as ``rm``
    or ``touch`` write to every argument up to the next operator that is no option.
    """
    all_words = words(command)
    last = F.element_at(all_words, -1)

    def of_word(word: Column, at: Column) -> Column:
        rest = F.slice(all_words, at + 2, F.greatest(F.lit(0), F.size(all_words) - at - 1))
        ends = F.filter(F.transform(rest, lambda w, i: F.when(w.isin(fixed.SHELL_OPERATORS), i)), lambda i: i.isNotNull())
        own = F.slice(rest, 1, F.coalesce(F.array_min(ends), F.size(rest)))
        copied = F.when(last.isin(fixed.CLOSING_OPERATORS), F.get(rest, F.lit(1))).otherwise(last)
        nothing = F.array().cast("array<string>")
        return (
            F.when(word.isin(fixed.LAST_ARGUMENT_COMMANDS) & (F.size(rest) >= 2), F.array(copied))
            .when(word.isin(fixed.EVERY_ARGUMENT_COMMANDS), F.filter(own, lambda w: ~w.startswith("-")))
            .otherwise(nothing)
        )

    redirected = F.regexp_extract_all(command, F.lit(fixed.REDIRECTION), F.lit(1))
    named = F.flatten(F.transform(all_words, of_word))
    return F.concat_ws(",", F.array_sort(F.array_union(redirected, named)))
