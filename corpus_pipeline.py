"""The corpus pipeline: five stages over documents, each of which applies one operator to all that the one before kept.

Every stage takes rows with null ids, texts or other columns, empty and very long texts, repeated rows and an empty table: null and empty texts have no lines, shingles or items and
are packed as their end id alone; near-duplicate removal keeps one of all equal texts; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import remove, save, scratch_tables
from colloquy.llm.decontamination import decontaminate
from colloquy.llm.line_dedup import dedup_lines
from colloquy.llm.packing import pack_documents
from colloquy.llm.queries import TOXIC_CHAIN, table, tokenizer_file
from colloquy.llm.simhash import near_dedup
from colloquy.llm.toxicity import fit_chain, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under a half."""
    chain = fit_chain(docs, table(spark, sf_dir, "labels"), TOXIC_CHAIN)
    return score_toxicity(docs, chain, keep=tuple(docs.columns)).filter("p_toxic < 0.5").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that came before, exactly or nearly; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by id, of each group of near copies: five-word shingles, similarity 0.8.

    SimHash fingerprints meet on the grid of segment counts, and shingle sets decide; an exact search by rare shingles adds the links beyond 2 bits.
    """
    return near_dedup(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the trained model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result but the last is written and read again.

    Once it is written, the scratch tables of its stage and the result before it go; tables of other work stay.
    """
    docs = table(spark, sf_dir, "documents")
    before = set(scratch_tables(spark))
    for name, stage in STAGES[:-1]:
        docs, path = save(stage(spark, docs, sf_dir), name)
        remove(spark, *[p for p in scratch_tables(spark) if p not in before and p != path])
    return STAGES[-1][1](spark, docs, sf_dir)
