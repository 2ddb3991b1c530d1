"""Exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidings.llm.encode import encoder


def _count(vocabulary: str, added: int):
    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            text = batch.column(1)
            for low in range(0, len(batch), 512):
                n = [len(enc.ids(t)) // enc.width + added for t in text[low:low + 512].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:low + 512], pa.array(np.array(n, np.int64))],
                    names=["scope", "n_tokens"])
    return run


def length_histogram(docs: DataFrame, vocabulary: str, scope_col: str, added: int = 1,
                     text_col: str = "text") -> DataFrame:
    """(scope, n_tokens, documents): documents of every encoded length, in each scope and, as scope
    null and `whole` true, in all.

    A null text is an empty one; `added` ids are counted for each document (an end id). Documents
    whose scope is null form a scope of their own. Counts are combined before they are shuffled, so a
    scope or a length that most documents have is one row per task. No documents, no rows.
    """
    lengths = docs.select(F.col(scope_col).cast("string").alias("scope"),
                          F.col(text_col).alias("text")).mapInArrow(
        _count(vocabulary, added), "scope string, n_tokens bigint")
    counted = lengths.groupBy("scope", "n_tokens").agg(F.count("*").alias("documents"))
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("whole")
    return (counted.select("scope", "n_tokens", "documents", both)
            .groupBy("whole", F.when(~F.col("whole"), F.col("scope")).alias("scope"), "n_tokens")
            .agg(F.sum("documents").alias("documents")))


def context_totals(histogram: DataFrame) -> DataFrame:
    """What each context limit keeps, for every length at which an answer changes.

    For the limit `n_tokens`: `longer` documents exceed it, `tokens_up_to` is the total of those that
    don't, `truncated_total` is the total if each is cut at the limit, `rank` counts documents of at
    most that length and `quantile` is their share. Between two rows the first four are linear in the
    limit, so `total_at` answers any limit exactly.
    """
    n, docs = F.col("n_tokens"), F.col("documents")
    up_to = Window.partitionBy("whole", "scope").orderBy("n_tokens").rowsBetween(
        Window.unboundedPreceding, 0)
    beyond = Window.partitionBy("whole", "scope").orderBy("n_tokens").rowsBetween(
        1, Window.unboundedFollowing)
    zero = F.lit(0).cast("bigint")
    summed = histogram.withColumns({
        "rank": F.sum(docs).over(up_to),
        "tokens_up_to": F.sum(docs * n).over(up_to),
        "longer": F.coalesce(F.sum(docs).over(beyond), zero),
        "tokens_beyond": F.coalesce(F.sum(docs * n).over(beyond), zero)})
    return summed.select(
        "whole", "scope", "n_tokens", "documents", "rank",
        (F.col("rank") / (F.col("rank") + F.col("longer"))).alias("quantile"),
        "longer", "tokens_up_to",
        (F.col("tokens_up_to") + F.col("tokens_beyond")).alias("tokens_total"),
        (F.col("tokens_up_to") + F.col("longer") * n).alias("truncated_total"))


def total_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(whole, scope, limit, truncated_total, documents_cut) for chosen limits, from the histogram."""
    limit = F.explode(F.array(*[F.lit(x).cast("bigint") for x in limits])).alias("limit")
    rows = histogram.select("whole", "scope", "n_tokens", "documents", limit)
    return rows.groupBy("whole", "scope", "limit").agg(
        F.sum(F.col("documents") * F.least("n_tokens", "limit")).alias("truncated_total"),
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("documents")).otherwise(0))
        .alias("documents_cut"))
