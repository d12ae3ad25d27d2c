"""A corpus pipeline of five stages: language ID, near-duplicate join, substring dedup, source mix, encoding.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigraph.llm import langid, mix, near, pieces, substrings
from verdigraph.plans.lineage import cut, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text or no letter) go. A document without a ``lang`` gets the language that was found."""
    model = langid.train(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model)
    lang = F.coalesce("lang", "lang_pred").alias("lang")
    return found.filter(F.col("lang_pred") != langid.UNDETERMINED).select(*[lang if c == "lang" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id."""
    return near.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; a document of which no word is left goes. n_chars follows the text."""
    left = substrings.dedup_substrings(docs).filter((F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The blocks of the mix in the order of its slots: one row for each document's part of a block, with that part as its text. n_chars follows it.

    A document comes in parts of up to 256 words, as often as its source is taken. A row without words goes, as no slot can hold it.
    """
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return mix.mixed_blocks(docs).select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the check that they decode to it."""
    return pieces.encoded_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("substrings", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("pieces", encode_pieces),
]

#: Trained models, MinHash and a tokenizer aren't expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", outlive=True)
    return STAGES[-1][1](spark, docs, sf_dir)
