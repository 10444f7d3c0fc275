"""A training-corpus pipeline: five stages, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, likelihood, near_copies, packing, site_lines
from barloom.llm.shared import stored


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and reach the likelihood-ratio threshold."""
    return likelihood.kept_rows(likelihood.quality_rules(docs, _labels(spark, sf_dir)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that many sites share but for their first occurrence."""
    cut = site_lines.drop_boilerplate(docs, sites=10, min_words=3)
    body = F.col("kept_text")
    new = {"text": body, "n_chars": F.length(body).cast("bigint")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts with a five-word shingle similarity of 0.8 or more."""
    return near_copies.keep_one(docs, shingle=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage similar to a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_leaks(docs, items, shingle=5, least=0.8).where(F.size("leaks") == 0).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the rows in sequences of 4096 tokens."""
    # beside the other stages' memory a smaller cache of words
    return packing.pack(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end=1, words=150_000)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: SimHash, fitted ratios and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
