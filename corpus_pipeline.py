"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, byte-level BPE.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's docs.  All but the
last return the columns of ``documents``: the first three drop rows, the fourth masks live-looking secrets within texts, the
last returns the digest of each document's token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import bpe, decontaminate, near_dup, secrets, toxicity
from panelyard.llm.shared import kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose toxicity reaches 0.5.  Null and empty texts score 0 and stay, repeated rows stay or go together, and
    without usable labels every row stays."""
    return toxicity.clean_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five words, 0.75).  Texts without words, null ones too,
    are in no group; exactly repeated rows stay or go together."""
    return near_dup.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold ten consecutive words of a benchmark item, or a whole shorter one.  Null and empty texts have no
    words and stay, and with an empty benchmark every row does."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with live-looking secrets of few owners replaced by a mask, and n_chars counted again where one was.  Null and
    empty texts stay as they are, repeated rows are masked alike; a null source or language counts as an empty one."""
    masked = secrets.mask_live(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.when(F.contains(F.col("text"), F.lit(secrets.MASK)), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null and empty texts have no ids."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", token_ids),
]

#: A fitted model, sketches and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept(docs, f"pipeline-{name}")
    return docs
