"""A corpus pipeline of five operators: toxicity, language, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusatlas.llm import decontaminate, language, packing, simhash, toxicity
from corpusatlas.llm.common import table
from corpusatlas.storage import delete, fresh_dir, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model accepts go."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others go the passages of benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def bounded(stage):
    """The stage with smaller Arrow batches: 10,000 whole texts, Spark's default, take much of a worker's memory."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("simhash", drop_near_duplicates), ("decontamination", drop_benchmark), ("packing", pack)]
STAGES = [(name, bounded(stage)) for name, stage in STAGES]

#: The toxicity and language models, the sketches and the tokenizer are beyond SQL; a test holds run() against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
