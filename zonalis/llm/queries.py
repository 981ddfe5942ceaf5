"""The registered corpus queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm import (
    decontaminate, langid, lines, minhash, oracles, packing, paragraphs, periods, pieces, pii, quality, secrets, suffixes, variants,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op10_secret_ownership", secrets.SQL)
def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are the repositories and sources the owners of what they hold."""
    found = secrets.secret_scan(documents(spark, sf_dir), repo="doc_id", owner="source")
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_shared"
    )


@query("op4_robust_quality")
def op4_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_harmonic_packing")
def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.harmonic_pack(documents(spark, sf_dir), vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op7_byte_cnn_language")
def op7_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~fold))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", fold.alias("held_out"), "language.lang_pred", "language.score"
    )


@query("op9_min_max_near_dedup", oracles.NEAR_DUPLICATES)
def op9_min_max_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=2)


@query("op8_prefix_doubling_dedup", oracles.REPEATS)
def op8_prefix_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir), threshold=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op6_paragraph_minhash")
def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of lines of eight words or more, whole lines too, and shorter lines beside other repeated ones."""
    return paragraphs.duplicate_paragraphs(documents(spark, sf_dir), min_line_words=1, lone_words=paragraphs.MIN_WORDS)


@query("op5_patience_line_dedup")
def op5_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedupe_lines(documents(spark, sf_dir)).select(
        "doc_id", "dedup.n_lines", F.size("dedup.removed").alias("n_removed"),
        F.concat_ws(",", F.col("dedup.removed").cast("array<string>")).alias("lines_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op3_pigeonhole_decontamination")
def op3_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places where documents hold a benchmark item; clean documents have no row."""
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


@query("op1_surrogate_pii")
def op1_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.replace_entities(docs, key="corpus-surrogates").select("doc_id", "n_entities", "text")


@query("op11_internal_pattern_runs")
def op11_internal_pattern_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words, in texts of which every tenth is given a periodic tail."""
    found = periods.find_runs(periods.repeat_words(documents(spark, sf_dir)))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    return found.withColumn("best", periods.best_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def merge_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op12_agenda_sentencepiece")
def op12_agenda_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, and whether the library gives the same."""
    encoded = pieces.encode_pieces(documents(spark, sf_dir), merge_pieces())
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )


@query("op13_composed_spelling_variants")
def op13_composed_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that are one edit from a word at least five times as frequent, in texts with a few misspelled words."""
    words = variants.count_words(documents(spark, sf_dir), misspell=199)
    return variants.spelling_variants(words.where("n >= 5"))
