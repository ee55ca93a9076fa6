"""A training corpus from raw documents: toxicity, near duplicates, personal data, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomart.llm import bpe, minhash, mixing, pii, toxicity
from chronomart.llm._shared import written

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the number of characters that the text has now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENTS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents predicted toxic go.

    Each row is judged by its text, null ones as empty, so repeated rows go or stay together. Columns that are no column of documents go, here
    and in every stage; an empty table stays empty; without labelled toxic documents nothing is predicted toxic.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(toxicity.toxicity(docs.select(*DOCUMENTS), labels).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each class stays, the one with the smallest id (a null one first).

    Documents without words are no duplicates of each other and all stay; different texts that share an id, or have none, are different
    documents; an empty table stays empty.
    """
    return _documents(minhash.drop_near_duplicates(docs.select(*DOCUMENTS)))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: kept spans are replaced by their kind. Every row stays; null texts stay null; repeated rows give equal texts; an empty table stays empty."""
    docs = docs.select(*DOCUMENTS)
    _, weights = pii.fit(written(pii.find_candidates(docs), "spans"))
    return _documents(pii.redact(docs, weights))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document comes as often as the mix takes it, never or up to three times.

    Documents without words go, as the mix takes nothing of them; a null source is a source of its own; repeated rows are documents of
    their own and come as often as the one of them that is taken most; an empty table stays empty.
    """
    docs = docs.select(*DOCUMENTS)
    return _documents(mixing.apply_mix(docs, mixing.mix_sources(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids of each text and the digest of what they decode to. A row for each row; null texts are empty; an empty table stays empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mix", mix),
    ("bpe", encode),
]

#: SQL can express neither the classifiers nor the sampled signatures; a test holds every stage, row by row, against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
