"""A corpus from documents to tokens, in stages; each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import credentials, mixing, quality, shingles, tokens
from factorloom.llm.common import shared_dir, table
from factorloom.llm.queries import BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays. SimHash partitions name candidates; texts are near if their sets of shingles of five words have a Jaccard similarity of 0.8 or more."""
    return shingles.deduplicate(docs, shingle=5, least=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found becomes a mark; documents stay."""
    return credentials.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them."""
    return mixing.materialise(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, their number, and whether decoding gives the text's bytes back."""
    import public_tokenizers

    path, pattern = public_tokenizers.path(BPE), public_tokenizers.PATTERN
    out = tokens.decode(tokens.encode(docs, path, pattern), path, pattern, "token_ids")
    same = F.col("token_bytes") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select("doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("secret scan", secret_scan), ("mixing", mix_sources), ("byte-level bpe", tokenize)]

#: SQL cannot express the fingerprints and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
