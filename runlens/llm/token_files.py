"""Token-id files with keyed access through a minimal perfect hash index.

Files of one output folder:

* ``tokens-NNNNN.bin``, one per shard, shards and documents in ascending key order: the raw ids
  (unsigned, little endian, ``width`` bytes each), then documents + 1 token offsets (u64), then
  the footer (documents u64, tokens u64, width u32, magic u32).
* ``index-NNNNN.mph``, one per part of the keys: a minimal perfect hash (a cascade of bit arrays:
  a key belongs to the first level where no other remaining key shares its bit, its slot is the
  number of set bits before it) and, by slot, a 32-bit fingerprint, shard, first document of the
  key in the shard, and number of its documents there.

A lookup hashes the key to its part, walks the levels (1.6 on average), compares the fingerprint
and reads the ids at the offset: the cost does not depend on the number of documents.
Files are written under a name of the attempt and then moved, so a repeated task replaces its
own file with the same content.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm import tokens
from runlens.llm.arrow import stored, texts_of
from runlens.llm.words import blocks, mixed
from runlens.session import shared_dir

MAGIC = 0x524C544B
FOOTER = np.dtype([("docs", "<u8"), ("tokens", "<u8"), ("width", "<u4"), ("magic", "<u4")])
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("docs", "<u4"), ("more", "<u4")])
KEYS_PER_PART = 250_000
#: Text of a shard, and documents that are read together.
SHARD_BYTES = 256 << 20
READ_DOCS = 65_536
ROOM = 1.5
READ_BYTES = 8 << 20
Encoder = Callable[[str], Callable[[Sequence[str]], list[np.ndarray]]]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _publish(uri: str, name: str, parts: Iterator[bytes]) -> None:
    system, folder = _open(uri)
    system.create_dir(folder, recursive=True)
    draft = posixpath.join(folder, f".{name}.{TaskContext.get().taskAttemptId()}")
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, posixpath.join(folder, name))


# ---------------------------------------------------------------- minimal perfect hash


def key_hashes(ids: np.ndarray, part: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of (id, part); for part 0 different ids never collide."""
    with np.errstate(over="ignore"):
        spread = part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt) * np.uint64(0xD6E8FEB86659FD93)
        return mixed(ids.astype(np.int64).view(np.uint64) ^ mixed(spread + np.uint64(1)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Bit-array cascade over distinct 64-bit hashes."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])
        self.keys = int(self.before[-1])

    @staticmethod
    def positions(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(hashes + np.uint64(level) * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("keys of a perfect hash must differ")
        sizes, bits, left = [], [], hashes
        while len(left):
            size = -(-int(len(left) * ROOM + 1) // 64) * 64
            at = cls.positions(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        packed = np.concatenate(bits).view("<u8") if bits else np.zeros(0, "<u8")
        return cls(np.array(sizes, dtype=np.int64), packed)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for what no level holds (a stranger may also get a slot)."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            bit = self.base[level] + self.positions(hashes[open_], level, size)
            word, within = bit >> 6, (bit & 63).astype(np.uint64)
            values = self.words[word]
            hit = (values >> within) & np.uint64(1) == 1
            below = values & ((np.uint64(1) << within) - np.uint64(1))
            slot = self.before[word] + np.bitwise_count(below).astype(np.int64)
            out[open_[hit]] = slot[hit]
            open_ = open_[~hit]
        return out


def index_bytes(ids: np.ndarray, part: np.ndarray, records: np.ndarray) -> Iterator[bytes]:
    """An index part: salt, number of levels, level sizes, bits, records by slot."""
    salt = 0
    while len(np.unique(hashes := key_hashes(ids, part, salt))) != len(hashes):
        salt += 1
    table = PerfectHash.build(hashes)
    ordered = np.zeros(len(ids), dtype=RECORD)
    records["print"] = fingerprints(hashes)
    ordered[table.slots(hashes)] = records
    yield np.array([salt, len(table.sizes)], dtype="<u8").tobytes()
    yield table.sizes.astype("<u8").tobytes()
    yield table.words.astype("<u8").tobytes()
    yield ordered.tobytes()


class Index:
    """Reader of one index part."""

    def __init__(self, data: bytes) -> None:
        self.salt, levels = (int(x) for x in np.frombuffer(data, "<u8", 2))
        sizes = np.frombuffer(data, "<u8", levels, 16).astype(np.int64)
        words = np.frombuffer(data, "<u8", int(sizes.sum()) // 64, 16 + 8 * levels)
        self.table = PerfectHash(sizes, words)
        self.records = np.frombuffer(data, RECORD, self.table.keys, 16 + 8 * levels + words.nbytes)

    def find(self, ids: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Record number of each key, -1 where the key is absent (but for 1 in 2^32)."""
        hashes = key_hashes(ids, part, self.salt)
        slot = self.table.slots(hashes)
        if not len(self.records):
            return slot
        return np.where((slot >= 0) & (self.records["print"][slot] == fingerprints(hashes)), slot, -1)


# ---------------------------------------------------------------- writing


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int, encoder: Encoder = tokens.split_by_words,
          width: int = 2, shards: int | None = None, keys_per_part: int = KEYS_PER_PART) -> int:
    """Write the shards and the index of ``docs`` (doc_id, text); returns the number of index parts.

    Documents go to shards in ascending doc_id (null first), equal ids ordered by text, so a
    repeated id may fill several shards. Their number follows the bytes of the texts, so that a
    shard, which one task writes, stays at about ``SHARD_BYTES`` of text. ``width`` is 2 or 4 bytes an id.
    """
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // SHARD_BYTES))
    kind = {2: "<u2", 4: "<u4"}[width]
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
            .withColumn("tie", F.xxhash64("text"))
            .repartitionByRange(shards, F.asc_nulls_first("doc_id"), "tie")
            .sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "text").drop("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, keys, lengths = TaskContext.get().partitionId(), encoder(vocabulary), [], []

        def parts() -> Iterator[bytes]:
            for batch in batches:
                keys.append(batch.column(0))
                texts = texts_of(batch)
                for a, b in blocks(texts):
                    found = encode(texts[a:b])
                    lengths.append(np.array([len(ids) + 1 for ids in found], dtype=np.int64))
                    end = np.array([end_id])
                    yield np.concatenate([x for ids in found for x in (ids, end)]).astype(kind).tobytes()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths) if lengths else [])]).astype("<u8")
            yield offsets.tobytes()
            yield np.array([(len(offsets) - 1, int(offsets[-1]), width, MAGIC)], dtype=FOOTER).tobytes()

        _publish(folder, f"tokens-{shard:05d}.bin", parts())
        ids = pa.chunked_array(keys, pa.int64()) if keys else pa.chunked_array([], pa.int64())
        sizes = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        for at in range(0, len(ids), 65_536):
            part = ids.slice(at, 65_536).combine_chunks()
            part = part if isinstance(part, pa.Array) else pa.concat_arrays(part.chunks)
            yield pa.RecordBatch.from_arrays(
                [part, pa.array(np.full(len(part), shard), pa.int32()),
                 pa.array(np.arange(at, at + len(part)), pa.int64()),
                 pa.array(sizes[at:at + len(part)])], ["doc_id", "shard", "local", "n"])

    entries = stored(rows.mapInArrow(run, "doc_id long, shard int, local long, n long"), "token-entries")
    runs = entries.groupBy(*_identity(F.col("doc_id")), "shard").agg(
        F.min("local").alias("first"), F.count(F.lit(1)).alias("docs"))
    parts = max(1, -(-runs.count() // keys_per_part))
    by_shard = Window.partitionBy("id", "missing").orderBy("shard")
    keyed = runs.withColumn("part", F.row_number().over(by_shard) - 1).withColumn(
        "more", F.lead("shard").over(by_shard).isNotNull().cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, part = _keys(pdf, pdf["part"].to_numpy())
        records = np.zeros(len(pdf), dtype=RECORD)
        for name in ("shard", "first", "docs", "more"):
            records[name] = pdf[name].to_numpy()
        _publish(folder, f"index-{int(pdf['p'].iloc[0]):05d}.mph", index_bytes(ids, part, records))
        return pd.DataFrame({"p": pdf["p"].iloc[:1], "keys": [len(pdf)]})

    (keyed.withColumn("p", _part_of(parts)).groupBy("p").applyInPandas(build, "p int, keys long")
     .agg(F.sum("keys")).collect())
    return parts


def _identity(doc_id: Column) -> tuple[Column, Column]:
    """An id that is never null, and whether it stands for the null id (pandas has no null longs)."""
    return F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("missing")


def _part_of(parts: int) -> Column:
    """Index part of a key; a null id has a part like any other."""
    return F.pmod(F.xxhash64("id", "missing"), F.lit(parts)).cast("int")


def _keys(pdf: pd.DataFrame, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and parts as hashed: the null id is told apart by a high bit of the part."""
    return pdf["id"].to_numpy(), part.astype(np.int64) + (pdf["missing"].to_numpy().astype(np.int64) << 40)


# ---------------------------------------------------------------- reading


def locate(keys: DataFrame, folder: str, parts: int) -> DataFrame:
    """(id, missing, shard, first, docs) of every key of ``keys`` through the index.

    A key whose documents fill several shards has one row for each; absent keys have none.
    """

    def look_up(pdf: pd.DataFrame) -> pd.DataFrame:
        system, path = _open(folder)
        with system.open_input_stream(posixpath.join(path, f"index-{int(pdf['p'].iloc[0]):05d}.mph")) as file:
            index = Index(file.read())
        frames, left, step = [], pdf[["id", "missing"]], 0
        while len(left):
            at = index.find(*_keys(left, np.full(len(left), step)))
            left, hit = left[at >= 0], index.records[at[at >= 0]]
            frames.append(left.assign(shard=hit["shard"].astype(np.int32), first=hit["first"].astype(np.int64),
                                      docs=hit["docs"].astype(np.int64)))
            left, step = left[hit["more"] == 1], step + 1
        return pd.concat(frames)

    distinct = keys.select(*_identity(F.col("doc_id").cast("long"))).distinct().withColumn("p", _part_of(parts))
    return distinct.groupBy("p").applyInPandas(look_up, "id long, missing boolean, shard int, first long, docs long")


def _footer(file) -> np.void:
    footer = np.frombuffer(file.read_at(FOOTER.itemsize, file.size() - FOOTER.itemsize), FOOTER)[0]
    if footer["magic"] != MAGIC:
        raise ValueError("not a token file")
    return footer


def shard_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, docs, tokens, base): footers of all shards; ``base`` is the tokens of earlier shards.

    The driver lists names, tasks read the footers; the running sum is over one row per shard.
    """
    system, path = _open(folder)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith("tokens-")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            system, path = _open(folder)
            rows = []
            for name in frame["name"]:
                with system.open_input_file(posixpath.join(path, name)) as file:
                    footer = _footer(file)
                rows.append((int(name[7:-4]), int(footer["docs"]), int(footer["tokens"])))
            yield pd.DataFrame(rows, columns=["shard", "docs", "tokens"])

    listed = spark.createDataFrame([(n,) for n in sorted(names)], "name string").repartition(max(1, len(names) // 64), "name")
    sizes = listed.mapInPandas(read, "shard int, docs long, tokens long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shard(folder: str, shard: int, first: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(request, token offset in the shard, ids) of each document of each request, in file order.

    Of the offsets only those between the first and the last document asked for are read.
    """
    if not len(first):
        return
    system, path = _open(folder)
    with system.open_input_file(posixpath.join(path, f"tokens-{shard:05d}.bin")) as file:
        footer = _footer(file)
        width, low, high = int(footer["width"]), int(first.min()), int((first + docs).max())
        table = file.read_at(8 * (high - low + 1), int(footer["tokens"]) * width + 8 * low)
        offsets = np.frombuffer(table, "<u8").astype(np.int64)
        order = np.argsort(first, kind="stable")
        request = np.repeat(order, docs[order])
        number = np.concatenate([np.arange(f, f + d) for f, d in zip(first[order], docs[order])] or [np.zeros(0, int)]) - low
        at = 0
        while at < len(number):
            start = offsets[number[at]]
            size = (offsets[number[at:] + 1] - start) * width
            upto = at + max(1, int(np.searchsorted(size, READ_BYTES, side="right")))
            block = file.read_at(int(size[upto - at - 1]), int(start) * width)
            ids = np.frombuffer(block, {2: "<u2", 4: "<u4"}[width])
            for i in range(at, upto):
                a, b = offsets[number[i]], offsets[number[i] + 1]
                yield int(request[i]), int(a), ids[a - start:b - start]
            at = upto


def read_back(keys: DataFrame, folder: str, parts: int, span: int = READ_DOCS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document whose id is in ``keys``, from the files.

    What is read together are the documents of one range of a shard, ``span`` of them; a repeated
    id's documents are cut at the borders of the ranges.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base, rows = int(pdf["base"].iloc[0]), []
        for request, start, values in read_shard(folder, int(pdf["shard"].iloc[0]), pdf["first"].to_numpy(),
                                                 pdf["docs"].to_numpy()):
            rows.append((request, base + start, len(values), zlib.crc32(values.astype("<u4").tobytes())))
        out = pd.DataFrame(rows, columns=["at", "start", "n_tokens", "ids_crc32"], dtype="int64")
        return pdf[["id", "missing"]].iloc[out["at"]].reset_index(drop=True).join(out.drop(columns="at"))

    found = locate(keys, folder, parts).join(shard_sizes(keys.sparkSession, folder).select("shard", "base"), "shard")
    last = F.col("first") + F.col("docs")
    cut = found.withColumn("span", F.explode(F.sequence(F.floor(F.col("first") / span), F.floor((last - 1) / span)))).select(
        "id", "missing", "shard", "base", "span", F.greatest("first", F.col("span") * span).alias("first"),
        (F.least(last, (F.col("span") + 1) * span) - F.greatest("first", F.col("span") * span)).alias("docs"))
    rows = cut.groupBy("shard", "span").applyInPandas(
        run, "id long, missing boolean, start long, n_tokens long, ids_crc32 long")
    return rows.select(F.when(~F.col("missing"), F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, encoder: Encoder = tokens.split_by_words,
               width: int = 2) -> DataFrame:
    """Write all documents to a fresh shared folder and read every one back by its key.

    A null text counts as empty and so has the end id alone. A null doc_id is a key like any
    other and sorts first. Rows that share an id, or are equal, are documents of their own. Other
    columns are ignored. An empty table writes shards without documents and gives no rows.
    """
    folder = shared_dir(docs.sparkSession, "token-files")
    parts = write(docs, folder, vocabulary, end_id, encoder, width)
    return read_back(docs, folder, parts)
