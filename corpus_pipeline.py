"""From raw documents to encoded training text.

Five stages, each calling one operator of ``ledgerlake.llm`` on everything
that its predecessor kept.  ``run`` writes each stage's rows as Parquet into
the shared folder and reads them again for the next one, so that a lost
executor never costs more than the stage at work.

Defined results: as of the operators; each filtering stage returns the columns
of the documents it was given, rows in no particular order, and an empty table
passes through as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import bpe, decontaminate, exact_dedup, simhash_dedup, toxicity
from ledgerlake.llm.common import named, table
from ledgerlake.session import checkpoint_dir

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHINGLE_WORDS = 3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled documents, does not reject."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked fingerprints."""
    return simhash_dedup.one_of_each(docs, k=SHINGLE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids (32 bits each, little-endian) of every document, with digests of the ids and of their decoded text."""
    encoded, col = bpe.encode(docs, VOCABULARY)
    ids, text = named(col).getField("ids"), named(col).getField("decoded")
    return encoded.select("doc_id", "lang", "source", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
                          ids.alias("ids"), F.sha2(ids, 256).alias("ids_sha256"),
                          F.sha2(text, 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", to_tokens),
]

# The model's verdicts and the linked classes have no SQL form: tests/llm
# hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
