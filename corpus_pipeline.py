"""A corpus pipeline: quality rules, near duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
`documents`. Each row is decided for itself, whatever its id: an id may be missing or come again with another
text.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.llm import bm25, hilbert, jaccard, outliers, weak
from tidings.shared import new_path

#: The duplicates stage: shingles of five words, similarity of 80 / 100.
SHINGLE_WORDS, SIMILAR = 5, (80, 100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source. Texts that are null or
    empty fail; rows that repeat are judged each."""
    return outliers.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id; one without an id stays only
    where no other has one. Rows without words are nobody's duplicates; of equal rows one stays."""
    return jaccard.one_of_each(docs, SHINGLE_WORDS, *SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Rows without a text stay."""
    return bm25.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; `n_chars` follows the text. A null text stays
    null; rows that repeat are treated each."""
    clean = weak.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids along the curve, as pieces of documents. A null text is an empty one, of one id;
    rows that repeat are packed each."""
    return hilbert.pack_along_curve(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Robust estimates, components and token ids are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
