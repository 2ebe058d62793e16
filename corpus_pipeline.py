"""A corpus pipeline over documents: quality rules, line dedup, near duplicates, source mix, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkfold.llm import line_dedup, mixing, ngram_join, pieces, quality
from sparkfold.llm.common import cut, table
from sparkfold.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules of op 8 keep."""
    return quality.keep_good(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal, or are within two edits of, an earlier one; those that lose all their words go."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram join, that of the smallest doc_id, stays."""
    return ngram_join.without_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and round that takes words of it."""
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their pieces, and whether the pieces give the text back."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), check=True)


STAGES = [("quality", quality_rules), ("line_dedup", repeated_lines), ("ngram_join", near_duplicates), ("mixing", source_mix), ("pieces", piece_ids)]

#: The edit-distance join, and pieces, have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's result is cut in the shared checkpoint folder, the last one's isn't."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
