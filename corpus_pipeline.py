"""A corpus from documents to training sequences: five stages, each stored and read again before the next.

Quality rules drop documents, line dedup takes boilerplate lines out of texts, the Jaccard join keeps one
document of each group of near copies, decontamination drops documents that hold benchmark items, and packing
gives the pieces of training sequences. Tokens can't be made in SQL, so there is no ORACLE_SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from panelforge.session import stored


def _bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts by bytes, not by 10,000 rows: they are held on both sides, in each core of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the strict policy; none is changed."""
    _bounded_batches(spark)
    return quality_rules.apply_policy(docs, quality_rules.STRICT)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, boilerplate lines of their source taken out; n_chars is that of the new text, NULL for NULL.

    Near copies count as one page, else the lines of an article with many of them would go from all, also from
    the one that the next stage keeps.
    """
    return line_dedup.drop_boilerplate(docs, line_dedup.SHARE, line_dedup.PAGES, near=True).withColumn("n_chars", F.length("text").cast("bigint"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; documents without words stay."""
    _bounded_batches(spark)
    return jaccard_join.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage within the error budget of a benchmark item."""
    _bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with their ids."""
    _bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_documents), ("line_dedup", without_boilerplate), ("jaccard_join", without_copies),
    ("decontaminate", without_benchmarks), ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
