"""The registered query of every operator, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import chat, mixing, packing, pii, quality_mil, quality_rules, runs, sharding, simhash, token_files, tokens, topk, toxicity, whitening
from runlens.llm.arrow import bucket_of, table
from runlens.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op2_llr_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality_rules.score(table(spark, folder, "documents"), trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "llr_micro", "n_grams")


def op3_nnls_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokens.public_path("byte_bpe_50k.json"), end_id=1)


def op4_attention_mil_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learn = labels.where(bucket_of(F.col("doc_id"), 3) != 1)
    scored = quality_mil.score(documents, quality_mil.train(documents, learn, "quality"))
    return _judged(scored, bucket_of(F.col("doc_id"), 3) == 1)


def _judged(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_feistel_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(documents, report="found").withColumn("n_found", F.size("found"))


def op6_crf_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    learn = labels.where(bucket_of(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(documents, toxicity.train(documents, learn))
    return _judged(scored, bucket_of(F.col("doc_id"), 5) == 0)


def op7_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.interleave(table(spark, folder, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return token_files.round_trip(documents, tokens.public_path("word_bpe_49k.json"), end_id=2)


def op9_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("component_docs")


#: Shares of all tokens that the mixture aims at, by what the labels call a document.
TARGETS = {"good": 0.9, "poor": 0.07, "toxic": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the labelled rows."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op10_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rated, _, _ = mixing.mix(documents, label_domains(labels), TARGETS)
    shares = [(F.get("units", F.lit(k)) / float(mixing.GRID)).alias(f"p_{d}") for k, d in enumerate(TARGETS)]
    return rated.select("doc_id", "n_tokens", *shares, "rate", "copies", "residual")


def with_planted_repeats(documents: DataFrame) -> DataFrame:
    """Documents whose id's crc32 ends in 0 repeat a stretch of their words from some word on.

    With h that crc32, g = h // 10 and n words: words from a = g % n on are original words a, ...,
    a + p - 1 over and over, p = 1 + (n - a) // (3 + g % 8). Texts without words and without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        source = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(source, lambda i: F.get(words, i)), " "))

    # the words are bound once, by the one element of an outer list, and not found anew for each of them
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return documents.withColumn("text", F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(planted, "text")).otherwise(F.col("text")))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = with_planted_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    found = runs.find_runs(documents)
    # greatest length / period: fractions are compared by their cross products; the first of equal ones stays
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


#: A conversation whose texts look like the marks of common templates.
ODD_CONVERSATION, ODD_TEXT = -7, "\\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(ODD_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    chats = chat.format_chats(chat.records_of_rows(rows.unionByName(odd), "conv_id"), "conv_id")
    read = chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                        F.array_join(chat.read_loss(F.col("pieces")), "").alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


_QUERIES: list[Query] = [
    op1_exact_topk, op2_llr_quality_rules, op3_nnls_packing, op4_attention_mil_quality, op5_feistel_pseudonyms,
    op6_crf_toxicity, op7_stratified_shards, op8_token_files, op9_simhash_dedup, op10_soft_mixing,
    op11_periodic_runs, op12_embedding_whitening, op13_chat_formatting,
]


def queries() -> dict[str, Query]:
    def bind(query: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return query(spark, folder)

        return run

    return {query.__name__: bind(query) for query in _QUERIES}


#: crc32 of a text's UTF-8 bytes; the table of 256 entries follows from the polynomial.
_CRC = """
        t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_table),
        b AS (SELECT doc_id, source, coalesce(text, '') AS body, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
            list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x:
                (strpos('0123456789ABCDEF', x[1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2]) - 1) AS bytes
            FROM documents),
        d AS (SELECT doc_id, source, size, xor(list_reduce(bytes, lambda c, x:
                xor(c >> 8, crc_table[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
            FROM b, t)"""

_ORACLES = {
    "op2_llr_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
        b AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words,
                list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
        w AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM b),
        h AS (SELECT *, list_reduce(list_transform(string_split(word, ''), lambda c: CAST(unicode(c) AS BIGINT)),
                lambda a, c: (a * 31 + c) & 4294967295, CAST(0 AS BIGINT)) AS h FROM w),
        n AS (SELECT *, lead(word) OVER o AS word2, lead(word, 2) OVER o AS word3, lead(h) OVER o AS h2
            FROM h WINDOW o AS (PARTITION BY rid ORDER BY i)),
        g AS (SELECT rid, CAST(((CAST(x AS UBIGINT) * 2654435761) & 4294967295) >> 16 AS BIGINT) AS cell FROM (
            SELECT rid, h AS x FROM n UNION ALL
            SELECT rid, (CAST(h AS UBIGINT) * 2246822507 + CAST(h2 AS UBIGINT)) & 4294967295 FROM n WHERE h2 IS NOT NULL)),
        t AS (SELECT rid FROM d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
        c AS (SELECT cell, count(*) AS raw, count(*) FILTER (rid IN (SELECT rid FROM t)) AS target FROM g GROUP BY cell),
        z AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM c),
        k AS (SELECT cell, CAST(round(1000000 * (ln((target + 1.0::DOUBLE) / (targets + 65536.0::DOUBLE))
            - ln((raw + 1.0::DOUBLE) / (raws + 65536.0::DOUBLE)))) AS BIGINT) AS weight FROM c, z),
        l AS (SELECT rid, CAST(sum(weight) AS BIGINT) AS llr_micro, count(*) AS n_grams FROM g JOIN k USING (cell) GROUP BY rid),
        r AS (SELECT rid, i FROM n WHERE word3 IS NOT NULL
            QUALIFY count(*) OVER (PARTITION BY rid, word, word2, word3) > 1),
        p AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY rid),
        f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(llr_micro, 0) AS llr_micro,
                coalesce(n_grams, 0) AS n_grams
            FROM b LEFT JOIN p USING (rid) LEFT JOIN l USING (rid))
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
            NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND llr_micro >= -100000 * n_grams AS kept FROM f""",
    "op7_stratified_shards": f"""
        WITH {_CRC},
        r AS (SELECT *, coalesce('s' || source, 'n') AS stratum,
                sha256(concat_ws(':', '20240', doc_id, text_crc32, size)) AS digest FROM d),
        f AS (SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY digest, doc_id, text_crc32, size) - 1
                AS DOUBLE) / (2 * count(*) OVER (PARTITION BY stratum)) AS frac, count(*) OVER () AS total FROM r),
        p AS (SELECT *, row_number() OVER (ORDER BY frac, stratum) - 1 AS position FROM f),
        s AS (SELECT *, CAST(position * 8 // total AS INTEGER) AS shard FROM p)
        SELECT doc_id, size, text_crc32, 'rows' AS law, shard, position - (shard * total + 7) // 8 AS slot,
            CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op13_chat_formatting": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (
            SELECT *, length(replace(role, chr(10), '\n')) + length(text) + 15
                + length(role || text) - length(replace(role || text, '\', ''))
                + (length(role) - length(replace(role, '<turn>', ''))) // 6 + (length(text) - length(replace(text, '<turn>', ''))) // 6
                + (length(role) - length(replace(role, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '</turn>', ''))) // 7
                AS chars FROM r),
        g AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS listed,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                CAST(sum(chars) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(listed) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
            sha256(loss) AS loss_sha256, formatted_chars FROM g""",
    "op1_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
        r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)
