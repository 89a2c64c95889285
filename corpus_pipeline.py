"""The training-data pipeline over `documents`: languages, near-duplicates, repeated spans, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import bpe, language, mixing, neardup, spans
from quillstack.llm.common import written
from quillstack.llm.queries import prepared
from quillstack.session import load_table

#: A document whose main language has a smaller share has no language to train on.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without letters, and mixtures without a majority, go."""
    prepared(spark)
    profiles = language.learn(docs.filter(~language.held_out()))
    judged = language.predict(docs, profiles)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the smallest id; documents without an id stay."""
    prepared(spark)
    gone = neardup.classes(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans of 20 words and more that occur earlier; n_chars follows the text."""
    prepared(spark)
    left = spans.remove_spans(docs, spans.repeated_spans(docs))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, written by shard and in each file in random order."""
    prepared(spark)
    mixed = mixing.mix_documents(docs)
    # The local shuffle: a hash deals a shard's rows to files, their random places order them.
    dealt = mixed.repartition("shard", F.pmod(F.col("place"), F.lit(8))).sortWithinPartitions("shard", "place")
    return dealt.select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of the text they decode to."""
    prepared(spark)
    coded = bpe.encode(docs.select("doc_id", "source", "text"), decoded="decoded")
    return coded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates), ("repeated_spans", drop_repeated_spans),
    ("mixing", mix_sources), ("bpe", encode_texts),
]

#: No stage can be stated in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = load_table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
