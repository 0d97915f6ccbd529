"""Near copies against all pairs."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import near_copies as nc
from runlens.llm.arrow import table
from runlens.llm.words import Words
from tests.llm.tables import EDGE_TEXTS, FOLDER, LONG, prose


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else set(zip(*[words[k:] for k in range(5)]))


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def near_texts(n, seed):
    """Texts, some of them with a few words changed, dropped or in capitals."""
    rng = random.Random(seed)
    out = []
    for text in prose(n, seed=seed):
        out.append(text)
        for _ in range(rng.choice([0, 0, 1, 3])):
            words = text.split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], ["changed"], [words[at].upper()], [words[at], "more"]])
            out.append(" ".join(words))
    return out


def test_shingles_against_sets():
    texts = ["", "one", "Two WORDS", "a b c d", "a b c d e", "a b a b a b a b a b", "\t x\u00a0y z \n", *prose(20), *(t or "" for _, t in EDGE_TEXTS), LONG]
    hashes, doc = nc.shingles(Words(texts))
    sets = [set(hashes[doc == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts] == np.bincount(doc, minlength=len(texts)).tolist()
    for i, j in combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(shingle_set(texts[i]) & shingle_set(texts[j]))


def test_signatures_against_single_bits():
    words = Words(prose(12, seed=4) + ["", "one two"])
    prints, keys = nc.signatures(words)
    hashes, doc = nc.shingles(words)
    assert keys.shape == (14, nc.SEGMENTS << nc.DOUBT) and (prints[12] == 0).all()
    for i in range(14):
        mine = hashes[doc == i]
        ones = [sum((int(h) >> b) & 1 for h in nc.mixed(mine)) * 2 > len(mine) for b in range(64)]
        assert int(prints[i][0]) == sum(1 << b for b, x in enumerate(ones) if x)
        segment = int(prints[i][0]) & ((1 << nc.SEGMENT_BITS) - 1)
        assert segment in keys[i][:1 << nc.DOUBT] and len(set(keys[i].tolist())) == nc.SEGMENTS << nc.DOUBT
        assert len({int(k) >> nc.SEGMENT_BITS for k in keys[i]}) == nc.SEGMENTS


def survivors(spark, texts, **how):
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"] for r in nc.one_of_each_group(df, **how).select("doc_id").collect()}


def test_groups_against_all_pairs(spark):
    texts = near_texts(120, 5)
    sets = [shingle_set(t) for t in texts]
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if alike(sets[i], sets[j])]
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        head[b] = a
    want, got = {find(i) for i in range(len(texts))}, survivors(spark, texts)
    assert want <= got and len(pairs) > 60  # nothing goes that all pairs would keep
    missed = sum(i in got and j in got for i, j in pairs)
    assert missed <= 0.1 * len(pairs)


@pytest.mark.parametrize("crowded", [1, 64])
def test_links_of_a_crowd_grow_with_its_members(spark, crowded):
    rng = random.Random(7)
    base = prose(1, seed=9)[0].split() * 2
    texts = []
    for _ in range(150):
        words = base[:]
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    prints, keys = nc.signatures(Words(texts))
    rows = [(i, *(int(x) for x in p.view(np.int64)), [int(k) for k in ks]) for i, (p, ks) in enumerate(zip(prints, keys))]
    pairs = nc.links(spark.createDataFrame(rows, "node long, p0 long, p1 long, p2 long, keys array<int>"), crowded=crowded)
    assert len(survivors(spark, texts)) <= 3
    if crowded == 1:
        assert 100 <= pairs.count() <= 150 * nc.NEAREST


def loose_crowd(n, seed):
    """Texts about as far from each other as copies of one text may be, each with a closer one."""
    rng = random.Random(seed)
    base, out = [f"b{k}" for k in range(120)], []
    for _ in range(n):
        words = base[:]
        for times in (3, 2):
            for at in rng.sample(range(len(words)), times):
                words[at] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("crowded", [1, 16])
def test_a_crowd_has_the_groups_of_all_pairs_that_meet(spark, crowded):
    texts = loose_crowd(150, 3)
    sets = [shingle_set(t) for t in texts]
    prints, keys = nc.signatures(Words(texts))
    keys = [set(k.tolist()) for k in keys]
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        apart = [(int(x) ^ int(y)).bit_count() for x, y in zip(prints[i], prints[j])]
        if alike(sets[i], sets[j]) and keys[i] & keys[j] and apart[0] <= nc.FIRST_DISTANCE and sum(apart) <= nc.DISTANCE:
            a, b = sorted((find(i), find(j)))
            head[b] = a
    want = {find(i) for i in range(len(texts))}
    assert 10 < len(want) < 290
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"] for r in nc.one_of_each_group(docs, crowded=crowded).collect()} == want


def test_a_crowd_is_joined_by_its_nodes(spark, monkeypatch):
    """Its nodes stand under many crowded keys; what a node is known by is looked up once for it, not for each key."""
    written, stored = {}, nc.stored

    def seen(df, purpose, *more):
        written[purpose] = stored(df, purpose, *more)
        return written[purpose]

    monkeypatch.setattr(nc, "stored", seen)
    survivors(spark, loose_crowd(60, 3), crowded=1)
    crowds, star = written["crowds"], written["met"].where(F.col("key").isNotNull())
    assert star.count() > 4 * crowds.count() > 0
    assert crowds.count() == star.select("b").distinct().count() == crowds.select("node").distinct().count()


def test_what_the_comparisons_read_many_times_is_written(spark, monkeypatch):
    plans, others = [], nc.others

    def seen(met, placed, *more):
        plans.append(placed._jdf.queryExecution().executedPlan().toString())
        return others(met, placed, *more)

    monkeypatch.setattr(nc, "others", seen)
    survivors(spark, loose_crowd(40, 5))
    assert plans and not any("Join" in p for p in plans)


def test_sketches_never_part_similar_texts():
    texts = [*near_texts(60, 6), *loose_crowd(30, 4), "", "a b"]
    words = Words(texts)
    bits = nc.sketches(words.n, *nc.shingles(words))
    sets = [shingle_set(t) for t in texts]
    parted = 0
    for i, j in combinations(range(len(texts)), 2):
        apart = sum((int(x) ^ int(y)).bit_count() for x, y in zip(bits[i], bits[j]))
        assert apart <= len(sets[i] ^ sets[j])
        parted += apart * 1.8 > 0.2 * (len(sets[i]) + len(sets[j])) + 1e-6
        assert not alike(sets[i], sets[j]) or apart * 1.8 <= 0.2 * (len(sets[i]) + len(sets[j])) + 1e-6
    assert parted > 1000


def test_recall_on_the_given_documents(spark):
    docs = table(spark, FOLDER.replace("sf0.001", "sf0.01"), "documents")
    rows = docs.select("doc_id", "text").collect()
    sets, ids = {}, {}
    for r in rows:
        key = frozenset(shingle_set(r["text"]))
        ids.setdefault(key, []).append(r["doc_id"])
    different = [s for s in ids if s]
    sizes = sorted(different, key=len)
    pairs = []
    for i, a in enumerate(sizes):
        for b in sizes[i + 1:]:
            if len(a) < 0.8 * len(b):
                break
            if alike(a, b):
                pairs.append((a, b))
    kept = {r["doc_id"] for r in nc.one_of_each_group(docs).select("doc_id").collect()}
    alive = {s for s in different if kept & set(ids[s])}
    assert sum(a in alive and b in alive for a, b in pairs) <= 0.1 * len(pairs) and pairs
    paired = {s for p in pairs for s in p}
    assert all(s in alive for s in different if s not in paired)  # what has no near copy stays


def test_one_row_of_each_group(spark):
    a, b, c = prose(3, seed=8)
    rows = [(1, a, "x"), (2, b, "x"), (2, c, "x"), (2, c, "y"), (3, a, "x"), (None, a, "x"), (None, "no id " + b[:40], "x"),
            (None, "no id " + b[:40], "x"), (None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = Counter((r["doc_id"], r["text"] or "", r["_row"]) for r in nc.one_of_each_group(docs).collect())
    assert kept == Counter([(1, a, "x"), (2, b, "x"), (2, c, "x"), (None, "no id " + b[:40], "x"), (None, "", "x")])
    import corpus_pipeline

    staged = Counter((r["doc_id"], r["text"] or "", r["_row"]) for r in corpus_pipeline.near_dedup_stage(spark, docs, FOLDER).collect())
    assert staged == kept


def test_the_first_similar_row_in_order_stays(spark):
    text = " ".join(prose(3))
    df = spark.createDataFrame([(7, text + " tail", "a"), (3, text, "b"), (9, text.upper(), "c"), (None, text, "d")], "doc_id long, text string, p0 string")
    assert [tuple(r) for r in nc.one_of_each_group(df).collect()] == [(3, text, "b")]
    assert nc.one_of_each_group(df, similarity=1.0).where(F.col("doc_id") == 7).count() == 1
