"""From raw documents to packed sequences: quality, near copies, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.common import Run, drop, spill, table
from sieveline.llm.decontamination import remove_leaks
from sieveline.llm.near_dedup import keep_one
from sieveline.llm.packing import pack, token_pieces
from sieveline.llm.quality_rules import keep_good
from sieveline.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of 50 words that earlier documents have."""
    return remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces in sequences of 2048 tokens."""
    import public_tokenizers

    pieces = spill(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: Each stage reads what the one before it wrote. run() deletes a stage's scratch tables, and its input, when its result is written.
STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("packing", packing),
]

#: Sketches, alignment and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with Run(spark) as own:
            written = spill(stage(spark, docs, sf_dir), f"stage-{k}")
            own.keep(written)
        drop(docs)
        docs = written
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads only the pieces it has written
    drop(docs)
    return out
