"""Periodic runs against a scan of every period, and the query against a plain restatement of it."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from runlens.llm import queries, runs
from runlens.llm.arrow import table
from tests.llm.tables import EDGE_TEXTS, FOLDER, edge, empty

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """All runs by scanning each period."""
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                best.setdefault((i, j - i + p), p)
            i = max(i + 1, j)
    return sorted((s, n, p) for (s, n), p in best.items())


def collapse(words, found):
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def sample(rng, n):
    k = rng.choice([1, 2, 3, 5, 30])
    words = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 10 else 0):
        a, p = rng.randrange(n), rng.randrange(1, 1 + max(1, n // 6))
        for i in range(a, min(n, a + rng.randrange(1, 8) * p + rng.randrange(p))):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_against_a_scan():
    rng = random.Random(1)
    for _ in range(250):
        texts = [sample(rng, rng.choice([0, 3, 6, 7, 20, 64, 65, 130, 300])) for _ in range(rng.randrange(1, 6))]
        got = runs.runs_of([np.array(t, dtype=np.int64) for t in texts])
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in brute(t)]


def test_extensions_against_a_scan():
    rng = random.Random(2)
    for size in [1, 2, 63, 64, 65, 128, 200, 900] * 6:
        ids = np.array(sample(rng, size), dtype=np.int32) + 1
        pairs = [(rng.randrange(size + 1), rng.randrange(size + 1)) for _ in range(200)]
        i, j = (np.array(x) for x in zip(*[(a, b) for a, b in pairs if a != b] or [(0, 1)]))
        want = []
        for a, b in zip(i.tolist(), j.tolist()):
            t = 0
            while max(a, b) + t < size and ids[a + t] == ids[b + t]:
                t += 1
            want.append(t)
        assert runs.Extensions(ids)(i, j).tolist() == want


def test_the_cover_meets_every_pair():
    residues, place, shift = runs._cover()
    assert shift.min() >= 0 and shift.max() < runs.COVER
    assert (np.diff(residues) > 0).all() and (place[residues] == np.arange(len(residues))).all()


def test_long_texts_and_many_pairs(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 1000)
    words = [i % 37 for i in range(30_000)] + list(range(100, 140)) + [7] * 5000
    assert runs.runs_of([np.array(words)]).tolist() == [[0, 0, 30_000, 37], [0, 30_040, 5000, 1]]


@pytest.mark.parametrize("words,found", [
    ("a a a a a", []), ("a a a a a a", [(0, 6, 1)]), ("a b a b a b a", []), ("x a b a b a b a b y", [(1, 8, 2)]),
    ("a b c a b c a b c a b c a b", [(0, 14, 3)]), ("a a a a a a b a a a a a a b a a a a a a b a a a a a a b",
     [(0, 6, 1), (0, 28, 7), (7, 6, 1), (14, 6, 1), (21, 6, 1)]),
])
def test_hand_values(words, found):
    assert brute(words.split()) == found
    text, short = runs._batch([words], True)
    assert [tuple(r.values()) for r in text[0]] == found and short == [collapse(words.split(), found)]


def test_defined_cases(spark):
    out = runs.find_runs(edge(spark), collapsed="length")
    assert out.columns == [c for c in edge(spark).columns if c not in ("text", "length")] + ["runs", "length"]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["length"]) for r in out.collect()))
    want = []
    for d, text in EDGE_TEXTS:
        words = WORDS.findall(text or "")
        found = brute(words) if len(words) < 1000 else [(0, 30_000, 977)]
        want.append((d is None, d or 0, found, collapse(words, found)))
    assert got == sorted(want)
    assert runs.find_runs(empty(spark)).count() == 0
    assert "collapsed" not in runs.find_runs(edge(spark), collapsed=None).columns


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_against_a_scan(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op11_periodic_runs"](spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    assert set(got) == set(texts) and len(got) == len(texts)
    seen = 0
    for d, text in texts.items():
        words = planted(d, WORDS.findall(text or ""))
        if len(words) > 4000:
            continue
        found, r = brute(words), got[d]
        seen += len(found)
        top = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapse(words, found).encode()).hexdigest()
    assert seen > 20


def test_query_without_texts_and_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (7, None), (8, ""), (20, "  ")], "doc_id long, text string")
    assert {r["text"] for r in queries.with_planted_repeats(docs).collect()} == {"a b", None, "", "  "}
