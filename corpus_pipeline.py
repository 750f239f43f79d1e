"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm import bpe, langid, lines, minhash, mixing
from strandmill.storage import new_path, remove


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is not recognised, with those whose text is null, empty or without a letter.

    Repeated rows are judged alike. A null lang teaches nothing; if all are null, every text with a letter stays. An
    empty table stays empty; a very long text is read whole. All columns stay, whatever they are called.
    """
    return langid.accepted(docs, langid.train(docs))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines of recurring templates out of the texts; no document goes. n_chars follows the text.

    A null text stays null with its n_chars; a text that loses all lines is empty. Rows of equal texts are treated alike,
    and ties for the smallest doc_id keep their lines. Rows without a doc_id, very long texts, empty tables and other
    columns are as in ``lines.drop_lines``.
    """
    out = lines.drop_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, that of the smallest doc_id, once if its rows repeat.

    Rows with a null doc_id or a null text are in no class with others and stay. Texts without words are one class for
    each text. An empty table stays empty; very long texts are compared whole. All columns stay, whatever they are called.
    """
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source comes near its target.

    A null source is a source of its own, a null or empty text has no words, and a row without a doc_id is chosen by its
    text. Ties in the hash go by size and doc_id. An empty table stays empty; a very long text counts whole. All columns
    stay, whatever they are called.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids of each text, and the digests of ids and decoded text.

    A null or empty text has no ids. Repeated rows are encoded each, a very long text is encoded whole, in parts, and an
    empty table stays empty. A column of the input that has the name of a new one gives way to it.
    """
    new = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    out = bpe.with_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(*[F.col("document").getField(c).alias(c) for c in docs.columns if c.lower() not in new], *new)


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_recurring_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: Language identification is a trained model, which SQL can't express.
ORACLE_SQL = None
