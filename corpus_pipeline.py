"""From raw documents to training data: five stages, each applied to all that the one before has kept.

``run`` applies the stages one after another; the check tool writes the result of each and reads it again. All stages but
the last return the columns of ``documents``.
"""
from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, decontaminate, jaccard_join, quality, suffix_dedup
from cohortloom.llm.components import settled
from cohortloom.llm.queries import tokenizer_path

#: Bytes of rows that go to a Python worker at once: texts differ in length, so a bound on rows alone is none on memory.
BATCH_BYTES = 4 << 20

#: SQL can't train a classifier, sort suffixes or merge byte pairs.
ORACLE_SQL = None


def bounded(stage):
    """The stage with batches for Python workers bounded by bytes, from here on in this session."""

    @wraps(stage)
    def bounded_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded_stage


@bounded
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; labels are learnt from rows that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(docs, labels).where(F.col("predicted") == 1).select(docs.columns)


@bounded
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: a similarity of 0.8 or more by five-word shingles."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


@bounded
def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that stand earlier too; n_chars follows the text."""
    cut = suffix_dedup.dedup(docs).withColumn("text", suffix_dedup.as_text("kept"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@bounded
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


@bounded
def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and a digest of the text they decode to."""
    coded = bpe.round_trip(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("suffix-array dedup", without_repeated_strings),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for all documents: doc_id, n_tokens, ids, decoded_sha256.

    Null texts count as empty in every stage; repeated rows are near copies of each other, so the second stage keeps one;
    extra columns pass through and clash with none; an empty table gives no rows. Each stage's result is written before the
    next one reads it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settled(docs)
    return docs
