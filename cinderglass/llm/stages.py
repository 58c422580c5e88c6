"""Pipeline stages: each takes documents and returns what it keeps of them.

All but the last return the columns of their input, whatever these are named: columns
beside ``doc_id`` and ``text`` travel packed, so that none can clash with what an
operator adds.  An empty table gives an empty table; null and empty texts are kept by
the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.llm.bpe import bpe_round_trip
from cinderglass.llm.decontaminate import decontaminate
from cinderglass.llm.minhash_dedup import BROADCAST_IDS, near_duplicates
from cinderglass.llm.shared import count_of, stash, table
from cinderglass.llm.substring_dedup import substring_dedup
from cinderglass.llm.toxicity import toxicity


def _packed(docs: DataFrame) -> DataFrame:
    others = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*others) if others else F.lit(None).cast("int")).alias("others"))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    return packed.select(*(F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    scored = toxicity(_packed(docs), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return _unpacked(scored.where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One doc_id of each group of near-duplicates (five-word shingles, 80 % or more), with all its rows.

    Rows without doc_id or without words stay.
    """
    rejected = stash(near_duplicates(docs.select("doc_id", "text")).where("n_shingles > 0 and not kept and doc_id is not null").select("doc_id").distinct(), "rejected")
    return docs.join(F.broadcast(rejected) if count_of(rejected) <= BROADCAST_IDS else rejected, "doc_id", "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words and more that occur earlier; others unchanged.

    ``n_chars``, where there is one, follows a cut text.
    """
    cut = substring_dedup(_packed(docs))
    changed = F.col("n_removed") > 0

    def column(name: str):
        if name == "text":
            return F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
        own = F.col(name) if name == "doc_id" else F.col("others").getField(name)
        return F.when(changed, F.length("kept_text").cast(docs.schema[name].dataType)).otherwise(own) if name == "n_chars" else own

    return cut.select(*(column(c).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark text."""
    return _unpacked(decontaminate(_packed(docs), table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digest of what they decode to."""
    made = bpe_round_trip(docs.select("doc_id", "text"))
    return made.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
