"""A bounded sample of labelled documents to fit a classifier on."""

from pyspark.sql import Column, DataFrame, functions as F

from tidings.shared import materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, bound: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled documents, chosen by the hash of their id.

    `learn` is a condition over `labels`. Labels other than 0 and 1 don't count; an id that has both
    doesn't either. Because the sample has at most `bound` ids, it is sent to every task, and the
    texts of other documents never move.
    """
    key = F.col(id_col).cast("bigint").alias("doc_id")
    chosen = (labels.where(learn).where(F.col(label_col).isin(0, 1))
              .groupBy(key).agg(F.min(label_col).cast("int").alias("label"),
                                F.max(label_col).cast("int").alias("most"))
              .where("label = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
              .select("doc_id", "label"))
    texts = docs.select(key, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "doc_id"), "labelled", compression="zstd")
