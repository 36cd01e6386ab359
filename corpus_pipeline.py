"""Documents made ready for training: stages in order, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all documents that the one before kept, and takes effect: toxic documents go, repeated lines go,
one document of each group of near duplicates stays, documents with passages of the benchmark go, and the
rest is encoded.  All stages but the last return the columns of their input.  Null texts and ids, empty tables,
repeated rows and clashing column names are treated as the operators' own descriptions say.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import bpe, decontaminate, lines, simhash, toxicity
from assayline.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the labels of held-out documents are not learnt from."""
    labels = table(spark, sf_dir, "labels")
    scorer = toxicity.train(docs, labels.where(~toxicity.held_out()), "text", "doc_id", "toxic")
    return toxicity.accepted(docs, scorer, "text")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur before, with ``n_chars`` counted anew."""
    cleaned = lines.LineJoin(docs, "text", "doc_id").cleaned()
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints (three-word shingles) that differ in at most three bits from one to the next."""
    return simhash.deduplicated(docs, "text", "doc_id")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), "text", unnamed=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, and digests of them and of what they decode to."""
    tokenizer = bpe.read_tokenizer(tokenizer_path("byte_bpe_50k.json"))
    return bpe.round_trip(docs, tokenizer, "text", keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: Toxicity is a trained model and the tokens follow a priority queue; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
