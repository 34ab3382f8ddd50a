"""From raw documents to token ids: quality rules, near duplicates, repeated passages, benchmark leaks, byte-level BPE.

Every stage works on all rows that the one before kept and reads them from a written table. All but the last
return the columns of ``documents``; the last returns ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit) and the
digests of ids and decoded bytes. Null texts fail the quality rules; a row without an id is treated as a document of its own; further
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilscan.llm import byte_bpe, decontaminate, jaccard_groups, quality_rules, repeated_bytes
from veilscan.llm.rows import count_chars
from veilscan.llm.shared import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are reachable by n-gram Jaccard links, the one with the smallest id."""
    return jaccard_groups.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has."""
    return count_chars(repeated_bytes.without_repeats(docs)).select(docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    import public_tokenizers

    coded = byte_bpe.encode(docs, public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    return byte_bpe.digest(coded, keep=("ids",))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", keep_clean),
    ("byte-level BPE", to_tokens),
]
#: Alignment of tiles, merged transforms and BPE have no SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name.replace(" ", "-"))
    return docs
