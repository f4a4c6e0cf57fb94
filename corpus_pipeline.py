"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and
read again as the next stage's ``docs``. All but the last keep the columns of ``documents``.

Rows are judged by their texts, whatever their ids: rows whose ``doc_id`` is null or stands several times are filtered as
all others are, and of near copies the row of the least id stays, a null id last. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loxodrome.llm import op03_minhash, op04_decontamination, op07_byte_bpe, op08_toxicity
from loxodrome.llm.workspace import Workspace

TOXIC_AT = 0.7
NEAR_WORDS, NEAR_PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go."""
    model = op08_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op08_toxicity.keep_clean(docs, model, threshold=TOXIC_AT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of the least id stays."""
    return op03_minhash.keep_first(docs, k=NEAR_WORDS, threshold=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in windows of benchmark items go."""
    return op04_decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, one_in=20)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, counted and digested, and what they decode to."""
    return op07_byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Learnt scores, BPE merges and connected components aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
