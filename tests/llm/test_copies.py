"""SimHash groups, shards, packing and token files against direct computations."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from runlens.llm import packing, sharding, simhash, token_files, tokens
from tests.llm.tables import FOLDER, edge, prose


def reach(values):
    """Smallest reachable id by brute force, {id: fingerprint} -> {id: smallest id}."""
    head = {d: d for d in values}

    def find(d):
        while head[d] != d:
            d = head[d]
        return d

    ids = sorted(values)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (values[a] ^ values[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                head[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprint_by_hand():
    import xxhash

    words = "The  QUICK\tbrown fox Jumps".encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint("The  QUICK\tbrown fox Jumps") == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("É one") == xxhash.xxh64_intdigest("É one".encode(), 42)


@pytest.mark.parametrize("crowded", [0, 256])
def test_components_equal_brute_force(spark, crowded):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    values = {r["doc_id"]: simhash.fingerprint(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(docs, crowded=crowded).collect()}
    assert got == {d: (values[d], c) for d, c in reach(values).items()}


@pytest.mark.parametrize("crowded", [0, 8, 256])
def test_links_of_crowded_halves(spark, crowded):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    values = {b ^ int(m) for b in base for m in [0, *(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), False)) for _ in range(25))]}
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
    got = {(r["a"], r["b"]) for r in simhash.links(df, crowded).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(values) for b in values[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_chains_and_stars_become_one_component(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(120, 500)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert roots == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, 500: 100}


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i}", "big" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(1001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleave(docs, shards=8).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    total, by = Counter(r[2] for r in rows), defaultdict(Counter)
    for r in got:
        by[r["source"]][r["shard"]] += 1
        assert r["size"] == len(f"t{r['doc_id']}") + 1 and r["text_crc32"] == zlib.crc32(f"t{r['doc_id']}".encode())
    assert all(abs(by[s][k] - n / 8) <= 2 for s, n in total.items() for k in range(8))
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k])) for k in range(8))


def test_packing_covers_every_token_once_with_little_padding(spark):
    texts = prose(300) + [" ".join(prose(40, seed=2)), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = tokens.public_path("byte_bpe_50k.json")
    got = packing.pack(docs, path).toPandas()
    tokenizer = tokens.load(path)
    for doc_id, rows in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for row in rows.sort_values("start").itertuples():
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(ids[at:at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all()
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() / (2048 * len(filled)) > 0.96


def test_plan_uses_the_histogram_exactly():
    rng = np.random.default_rng(1)
    for total in (8, 32, 64):
        histogram = {c: int(rng.integers(0, 500)) for c in range(1, total + 1)}
        used = Counter()
        for pieces, count in packing.plan(histogram, total):
            assert count > 0 and sum(c * k for c, k in pieces.items()) <= total
            for c, k in pieces.items():
                used[c] += k * count
        assert used == Counter({c: n for c, n in histogram.items() if n})
    assert packing.plan({}, 128) == []
    assert all(sum(c) == 12 and len(c) <= 3 for c in packing.combinations(12)) and len(packing.combinations(12)) == 19


def test_nnls_reaches_the_optimum():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and np.abs(gradient[x > 1e-8]).max(initial=0) < 1e-6


ODD = ["", "  ", "İstanbul ſ ΑΣ ὈΔΥΣΣΕΎΣ", "é ́x", "A\xa0B", "<|endoftext|> x", "it's don't I'LL x'! y-!", "x\x1cy z\x85w", "ß ẞ ŉ ǰ",
       "１２３ ½ ²", "a  b", "a \n b\n\n c", "don't  WE'LL 12 345", "word,word... (x) &&&$$$ wo-rd!!", "\x00 nul",
       "hello <|endoftext|> world", "<|startoftext|>a<|ENDOFTEXT|> b", "<|endoftext|>", "<|endoftext|> <|endoftext|>", "a <|endoftext", "Hi</w>"]
#: Texts that other implementations of the splitting pattern take long for or do not survive.
ENDLESS = ["a" + " " * 2_000_000 + "b", " " * 20_000, "\n \t" * 9_000 + "x", "z" * 50_000, "." * 50_000]


def noise(n):
    rng = random.Random(1)
    bits = [*"abc XYZ\n\t  .,!?'sé日本<|>123\x0b\x1c", "<|endoftext|>", "<|startoftext|>", "n't", "</w>"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_special_tokens_have_their_own_ids():
    assert tokens.byte_level(tokens.public_path("byte_bpe_50k.json"))(["hello <|endoftext|> world"])[0].tolist() == [31373, 220, 50256, 995]


def test_packing_endless_and_special_texts(spark):
    path = tokens.public_path("byte_bpe_50k.json")
    texts = [*ENDLESS, "hello <|endoftext|> world"]
    out = packing.pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), path, end_id=1).toPandas()
    tokenizer = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        mine = out[out.doc_id == i].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]] and mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()


@pytest.mark.parametrize("name, encoder", [("word_bpe_49k.json", tokens.split_by_words), ("byte_bpe_50k.json", tokens.byte_level)])
def test_encoders_agree_with_the_tokenizer(spark, name, encoder):
    path = tokens.public_path(name)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()
    texts = [r["text"] or "" for r in docs] + ODD + ENDLESS + noise(300)
    tokenizer = Tokenizer.from_file(path)  # as it is, without settings of ours
    for got, want in zip(encoder(path)(texts), tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(3)
    ids = np.unique(rng.integers(-(2**62), 2**62, 20_000))
    part = np.zeros(len(ids), dtype=np.int64)
    records = np.zeros(len(ids), dtype=token_files.RECORD)
    records["first"] = np.arange(len(ids))
    index = token_files.Index(b"".join(token_files.index_bytes(ids, part, records)))
    at = index.find(ids, part)
    assert sorted(at.tolist()) == list(range(len(ids)))
    assert (index.records["first"][at] == np.arange(len(ids))).all()
    assert (index.find(ids + 1, part)[~np.isin(ids + 1, ids)] == -1).mean() > 0.999
    assert (index.find(ids, part + 1) == -1).mean() > 0.999
    nothing = token_files.Index(b"".join(token_files.index_bytes(ids[:0], part[:0], records[:0])))
    assert nothing.find(ids, part).max() == -1


@pytest.mark.parametrize("width", [2, 4])
def test_token_files_round_trip(spark, width, tmp_path):
    path = tokens.public_path("word_bpe_49k.json")
    docs = edge(spark).select("doc_id", "text").unionByName(
        spark.createDataFrame([(2**60 + i, t) for i, t in enumerate(prose(50))], "doc_id long, text string"))
    folder = str(tmp_path / "files")
    parts = token_files.write(docs, folder, path, 2, width=width, shards=5, keys_per_part=7)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_back(docs, folder, parts).collect())
    tokenizer, want = Tokenizer.from_file(path), Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter(g[1:] for g in got) == want
    assert [g[0] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])])[:-1].tolist()
    ids = [g[1] for g in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    strangers = spark.createDataFrame([(999_999,), (7,)], "doc_id long")
    assert [r["doc_id"] for r in token_files.read_back(strangers, folder, parts).collect()] == [7]


def test_a_repeated_id_over_several_shards(spark, tmp_path):
    docs = spark.createDataFrame([(5, f"text {i}") for i in range(400)] + [(1, "a"), (9, "b")], "doc_id long, text string")
    folder = str(tmp_path / "files")
    parts = token_files.write(docs, folder, tokens.public_path("word_bpe_49k.json"), 2, shards=6)
    whole = token_files.read_back(docs, folder, parts).collect()
    assert Counter(r["doc_id"] for r in whole) == Counter({5: 400, 1: 1, 9: 1})
    assert sorted(token_files.read_back(docs, folder, parts, span=7).collect(), key=str) == sorted(whole, key=str)


def test_the_number_of_shards_follows_the_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 100)
    docs = spark.createDataFrame([(i, "word " * 20) for i in range(30)], "doc_id long, text string")
    folder = str(tmp_path / "files")
    parts = token_files.write(docs, folder, tokens.public_path("word_bpe_49k.json"), 2)
    sizes = token_files.shard_sizes(spark, folder).collect()
    assert len(sizes) >= 20 and sum(r["docs"] for r in sizes) == 30
    assert len(token_files.read_back(docs, folder, parts).collect()) == 30
