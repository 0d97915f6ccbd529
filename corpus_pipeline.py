"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, folder of the tables) and returns documents with their columns;
the last one returns the packed sequences. Between stages the documents are written to the shared
folder and read back, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import mixing, near_copies, packing, pii, tokens, toxicity
from runlens.llm.arrow import bucket_of, stored, table
from runlens.llm.queries import label_domains
from runlens.session import prepare

#: Shares of all tokens in the packed corpus; toxic documents are gone by then.
TARGETS = {"good": 0.93, "poor": 0.07}


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of one half or more go.

    Null and empty texts have the score of a text without any evidence and stay unless toxic documents are the
    rule; repeated rows and null ids are judged like others; without labels nothing goes; columns
    of any name are carried along, an empty table stays empty.
    """
    prepare(spark)
    learn = table(spark, sf_dir, "labels").where(bucket_of(F.col("doc_id"), 5) != 0)
    return toxicity.without_toxic(docs, toxicity.train(docs, learn))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, the one with the smallest id.

    Near copies share five-word shingles with a similarity of 0.8 or more. Repeated rows are copies
    of each other, null and empty texts are one group, unrelated texts of one id are groups of
    their own, and a row without an id stays only where its group has none with one. Empty tables
    stay empty.
    """
    prepare(spark)
    return near_copies.one_of_each_group(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms; n_chars follows the text.

    Every row stays. A null text stays null and has a null n_chars, an empty one stays empty.
    """
    prepare(spark)
    done = pii.pseudonymise(docs)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else done


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are kept, repeated or left out by rates that bring the domains to their targets.

    A rate is at most ``mixing.MOST_COPIES``. Null and empty texts move no total and have the rate of
    their posterior; repeated rows draw alike; without labels rates stay 1 as far as the targets
    allow; an empty table stays empty.
    """
    prepare(spark)
    return mixing.apply(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048.

    Every row is there with all of its tokens; a null or empty text has its end mark alone. An empty
    table gives no sequences.
    """
    prepare(spark)
    return packing.pack(docs, tokens.public_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers cannot be expressed in SQL; tests/llm checks the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
