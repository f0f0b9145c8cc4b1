"""The corpus pipeline: five stages, each an operator of ``chromaloom.llm`` whose decisions take effect.

1. ``quality``: documents that the factorisation machine rejects go.
2. ``line_dedup``: boilerplate lines of a source go from its documents.
3. ``near_dedup``: of each component of near copies (SimHash on five-word shingles, a similarity of 0.8) the document
   with the least id stays.
4. ``decontamination``: passages of the benchmark go; documents that consist of them go.
5. ``encoding``: byte-level BPE ids of what is left, and the digest of what they decode to.

All stages but the last return the columns of ``documents``; ``n_chars`` follows
a text that a stage has shortened.  Null and empty texts pass every stage that
does not reject them, very long ones are taken whole, an empty table gives an
empty one, rows that repeat id and text are one document to ``near_dedup`` and
several to the others, and columns of any name and
type are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm import bpe_transducer, decontamination, line_dedup, quality, simhash_sets
from chromaloom.llm.common import delete_path, scratch, shared_path, table

#: No SQL: the classifier, near copies and BPE are tested against brute force instead.
ORACLE_SQL = None


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they now are, where the table has that column."""
    if "n_chars" not in like.columns:
        return docs
    kind = like.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return _recounted(line_dedup.drop_boilerplate(docs), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, by shingles of five words and a similarity of 0.8."""
    return simhash_sets.drop_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that the benchmark has too."""
    return _recounted(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded documents, after a decoding that must give the text back."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):  # what the operators of a stage have written goes when the stage is done
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before is not None:
            delete_path(spark, before)
        before = path
    return docs
