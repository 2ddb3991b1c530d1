"""The operators over the test tables, with production parameters and whole tables."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidings.llm import (
    attention, bitsliced, bm25, hilbert, jaccard, lattice, lengths, line_dedup, outliers, resampling,
    segments, token_files, weak,
)
from tidings.llm.sql import SQL  # noqa: F401  (read by the driver's entry)
from tidings.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, remainder: int) -> Column:
    """Whether a document's checksum has this remainder. A row without an id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


@query
def op1_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


@query
def op2_token_files(spark, sf_dir):
    path = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=2)
    return token_files.digest(spark, path)


@query
def op4_weak_supervision(spark, sf_dir):
    return weak.personal_data(table(spark, sf_dir, "documents"))


#: Score from which a document is predicted to have label 1.
LIKELY = 0.3


@query
def op3_attention_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = attention.fit(docs, table(spark, sf_dir, "labels"), ~fold(5, 0))
    return attention.quality_scores(docs, model).select(
        "doc_id", fold(5, 0).alias("held_out"), "score",
        (F.col("score") >= LIKELY).cast("int").alias("predicted"), "n_passages", "most_attention")


@query
def op5_robust_outliers(spark, sf_dir):
    return outliers.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


@query
def op6_hilbert_packing(spark, sf_dir):
    return hilbert.pack_along_curve(table(spark, sf_dir, "documents"), VOCABULARY, end_id=0)


@query
def op7_benchmark_bm25(spark, sf_dir):
    return bm25.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_subword_lattice(spark, sf_dir):
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), fold(7, 2), PIECES)


@query
def op9_length_histogram(spark, sf_dir):
    return lengths.context_totals(
        lengths.length_histogram(table(spark, sf_dir, "documents"), VOCABULARY, "source"))


@query
def op10_toxic_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = segments.fit(docs, table(spark, sf_dir, "labels"), ~fold(4, 2))
    return segments.toxicity_scores(docs, model).select(
        "doc_id", fold(4, 2).alias("held_out"), "score",
        (F.col("score") >= LIKELY).cast("int").alias("predicted"))


@query
def op11_bitsliced_search(spark, sf_dir):
    path = new_path(spark, "bitsliced")
    bitsliced.build_index(table(spark, sf_dir, "documents"), path)
    return bitsliced.search(spark, path, table(spark, sf_dir, "benchmark"), k=50)


@query
def op12_crc_resampling(spark, sf_dir):
    return resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25)


@query
def op13_line_bitmaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
