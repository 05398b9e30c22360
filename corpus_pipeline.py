"""Corpus pipeline: quality filter, near-dedup, secret redaction, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of ``documents``. A
stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamdex.llm import minhash, mixing, packing, quality, secret_scan
from loamdex.session import discard, stored

#: Documents below this quality go.
LEAST_QUALITY = 0.3
#: Shares of all tokens by domain.
TARGETS = {"clean": 0.96, "noisy": 0.02, "toxic": 0.02}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line field scores below LEAST_QUALITY. Null and empty texts are one blank line."""
    field = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", modulus=5, held_out=0)
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))  # no column of the documents can clash with the score
    return quality.score(rows, field, ["row"]).where(F.col("score") >= LEAST_QUALITY).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates over 5-word shingles.

    Links are SimHash fingerprints within 3 bits, found by multi-index hashing, and beyond those an exact Jaccard similarity
    of 0.8 or more, whose candidates are the same tables' entries, completed by MinHash bands, which reach down to 0.8.
    """
    return minhash.one_of_each(docs, words=5, least=0.8, seed=42, bits=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark of its kind; no document goes."""
    return secret_scan.redact(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin domains to their target shares of what is kept; no document is repeated, so a domain that is short of its share stays whole."""
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.thin(docs, labelled, TARGETS, "clean")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", redact_secrets),
    ("mixing to target weights", mix_domains),
    ("harmonic packing", pack_sequences),
]

#: Learned models and tokenizers cannot be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again before the next; a stage's table goes when the next one is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
