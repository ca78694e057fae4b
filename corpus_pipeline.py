"""The corpus pipeline: documents -> packed training sequences.

Each stage gets the rows its predecessor kept, is written as Parquet and read
again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm.exact_dedup import drop_copies
from vitalgrid.llm.language import UNDETERMINED, identify
from vitalgrid.llm.mixing import mix, repeat
from vitalgrid.llm.packing import pack
from vitalgrid.llm.queries import tokenizer_file
from vitalgrid.llm.simhash import drop_near_copies
from vitalgrid.session import materialize

#: A document is rejected when no language reaches this share of the models' belief.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or that no language claims, go."""
    told = identify(docs, tokenizer_file("piece_bpe_32k.model"), keep_columns=True)
    return told.filter((F.col("_lang") != UNDETERMINED) & (F.col("_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays."""
    return drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of linked documents the one with the smallest doc_id stays."""
    return drop_near_copies(docs, width=4, max_bits=4, seed=42)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as many times as the mix takes it."""
    return repeat(mix(docs, max_epochs=3, period=3, seed=42, keep=docs.columns), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left into sequences of 4096 tokens."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [("language", language), ("exact_dedup", exact), ("simhash", near), ("mixing", mixture), ("packing", packing)]

#: Tokenizers, language models and XXH64 have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
