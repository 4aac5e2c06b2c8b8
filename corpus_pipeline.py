"""From raw documents to training sequences: quality, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage works on all rows that its predecessor kept, written as Parquet in the shared folder and read again, so a lost
executor or driver costs one stage at most.  No stage caps or samples its rows; the classifier alone is fitted on a
bounded sample of labelled rows (``nbsvm.fit(max_rows=...)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm import chosen_path, decontam, line_dedup, nbsvm, packing
from hourglass.llm.common import stage, table
from hourglass.llm.queries import bpe_path, packing_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.3) go; it learns from the labels of those that are there."""
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return nbsvm.keep_accepted(docs, model)


def boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of their source's pages go; ``n_chars`` follows the text."""
    clean = line_dedup.drop_boilerplate(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the smallest id."""
    return chosen_path.drop_near_duplicates(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing_digest(packing.pack(docs, bpe_path()))


STAGES = [("quality", quality), ("line dedup", boilerplate), ("near duplicates", near_duplicates),
          ("decontamination", leaks), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline{k}")
    return docs


# The classifier and the packing are no SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None
