"""From raw documents to packed training sequences, in stages that each apply one corpus operator.

``python corpus_pipeline.py SF_DIR OUT`` writes the packed pieces. Each stage reads what the one before
it wrote. NULL and empty texts, rows that repeat and columns of any name pass every stage without an
error; what becomes of them is said at each operator.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.scratch import discard, materialize
from zonalis.llm import decontaminate, langid, lines, minhash, packing
from zonalis.llm.names import fresh
from zonalis.llm.queries import vocabulary

#: Mean probability below which a document's language counts as unknown.
MIN_SCORE = 0.5
WORD = r"[^\x20\x09-\x0D]"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network knows; NULL, letterless and doubtful texts go."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    into = fresh(docs, "language")
    known = langid.identify(docs, model, into=into)
    return known.where((F.col(f"{into}.lang_pred") != langid.UNKNOWN) & (F.col(f"{into}.score") >= MIN_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that earlier ones hold; one left without a word by that goes."""
    into = fresh(docs, "dedup")
    left = lines.dedupe_lines(docs, into=into)
    spent = (F.size(f"{into}.removed") > 0) & ~F.col("text").rlike(WORD)
    return left.where(~F.coalesce(spent, F.lit(False))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike to 80 percent."""
    return minhash.without_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return packing.harmonic_pack(docs, vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


if __name__ == "__main__":
    run(SparkSession.builder.appName("corpus_pipeline").getOrCreate(), sys.argv[1]).write.parquet(sys.argv[2])
