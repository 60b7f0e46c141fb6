"""From raw documents to packed sequences: five stages, each an operator of depscope.llm.

Every stage works on all rows that the one before it kept, and on the columns of documents;
further columns of its input are left out, whatever their names. All but the last return the
columns of documents; the last returns the pieces with their sequences. Nulls, empty texts,
repeated rows and empty tables fare as the operators' docstrings say: an empty or null text
fails the quality rules, repeated rows end as one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depscope import scratch
from depscope.llm import linededup, mixing, packing, quality, similar
from depscope.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 1024

#: Blocks per cycle by source; a source that isn't named has one.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return quality.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks they share with earlier ones; one that is nothing else goes."""
    left = linededup.dedup_lines(docs.select(*COLUMNS)).where("n_removed < n_lines OR n_lines = 0")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of 5-word shingles at least: SimHash's links and those
    that it misses, every pair verified."""
    return similar.one_of_each(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule."""
    return mixing.in_order(mixing.mix(docs.select(*COLUMNS), WEIGHTS)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset; sequences follow the schedule's order."""
    return packing.packed_documents(docs.select("doc_id", "text"), TOKENIZER, CAPACITY, ordered=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SQL has no patience alignment and no sum-of-squares rule; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table documents, each one's rows written before the next. What a stage wrote for
    itself goes when its rows are written, and they go when the next one's are."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    before = set(scratch.written())
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.materialise(docs, f"pipeline-{k}")
            own = [path for path in scratch.written() if path not in before]
            scratch.release(own[:-1])  # the last one is this stage's rows
    return docs
