"""Small document tables for the operator tests, and where the given tables are."""

from __future__ import annotations

import os
import random

FOLDER = os.environ.get("RUNLENS_TEST_DATA", "/root/testdata/sf0.001")
DDL = ("doc_id long, text string, lang string, source string, n_chars long, fp string, score string, kept string, "
       "cls string, length string, rank string, units string, _units string, digest string, id string")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))

#: null id, null and empty texts, blanks only, a very long text, repeated rows, a repeated id.
EDGE_TEXTS = [
    (None, "a text without an id"), (None, None), (1, ""), (2, None), (3, " \t\n\x0b\x0c\r "), (4, LONG), (5, "same text here"),
    (5, "same text here"), (5, "another text of the same id"), (6, "same text here"), (7, "héllo wörld 日本語 \U0001f600 x"),
    (8, "idiot " * 40), (9, "one"), (10, "line one\nline one\n\nline two |### \nline one"),
]


def edge(spark, source="s1"):
    extra = ("x",) * 10
    rows = [(d, t, "en", None if i % 5 == 0 else source, None, *extra) for i, (d, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, DDL)


def empty(spark):
    return spark.createDataFrame([], DDL)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def prose(n, seed=0, words=400):
    """n texts of invented words."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdeginorstu") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 160))) for _ in range(n)]
