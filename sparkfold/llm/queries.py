"""One query for each corpus operator, over whole tables, with the SQL that DuckDB can check it by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, line_dedup, mixing, ngram_join, pieces, quality, secrets, token_files, toxicity, vector_graph
from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int) -> Column:
    """A document's fold of n by the CRC-32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return toxicity.score(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted", "n_hits")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_vectors(table(spark, sf_dir, "embeddings")).drop("recall")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    samples = langid.learn(docs, fold(3) != 1)
    return langid.identify(docs.select("doc_id", "text"), samples).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_ids(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
