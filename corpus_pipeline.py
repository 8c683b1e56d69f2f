"""Documents from raw to tokens: five stages, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir); docs has the columns of documents, and
so has every stage's result but the last, which has one row of token counts and
digests for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korvid.llm import bpe, decontaminate, exact, near, quality
from korvid.llm.common import discard, scope, staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality score rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 of five-word shingles the smallest doc_id stays."""
    return near.drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    import public_tokenizers

    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: A trained score, a byte-pair encoder and edit distances have no SQL form; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of ``sf_dir``, written and read again between stages.

    What a stage has staged goes once its result is written, and that result
    once the next one is; ``release()`` of the last one deletes the rest.
    """
    with scope(spark) as kept:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for k, (_, stage) in enumerate(STAGES):
            with scope(spark) as own:
                out = stage(spark, docs, sf_dir)
            if k == len(STAGES) - 1:
                kept.folders += own.folders
                break
            before, docs = docs, staged(out, f"pipeline-{k}")
            own.delete()
            if k:
                discard(before)
    out.release = kept.delete
    return out
