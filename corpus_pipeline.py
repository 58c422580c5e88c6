"""The corpus pipeline: documents in, token ids of clean documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderglass.llm import stages
from cinderglass.llm.shared import stash, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("minhash_near_dedup", stages.drop_near_copies),
    ("substring_dedup", stages.cut_repeats),
    ("decontamination", stages.drop_contaminated),
    ("bpe", stages.tokenize),
]

#: SQL expresses neither the trained model nor the tokenizer; the tests hold each
#: stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
