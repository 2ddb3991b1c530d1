"""Token ids in Parquet files: list columns with chosen encodings, row groups and page indexes."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidings.llm.encode import encoder

FILE_COLUMNS = "doc_id bigint, part int, at bigint, n_tokens bigint, tokens array<int>"
OUTPUT = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()),
                    ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

#: Written with the second page format: ids by dictionary (16 bits each here), and the numbers, which
#: rise along a file, as deltas. Page indexes let a reader skip pages by doc_id; row groups of this
#: size are the unit of a selective read of one column.
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
}


def _encode(vocabulary: str, end_id: int | None):
    def run(batches):
        enc, at, part = encoder(vocabulary), 0, TaskContext.get().partitionId()
        end = np.array([end_id], np.int32) if end_id is not None else np.empty(0, np.int32)
        for batch in batches:
            text = batch.column(1)
            for low in range(0, len(batch), 512):        # the ids of some rows at a time
                rows = [np.frombuffer(enc.ids(t), enc.type) for t in text[low:low + 512].to_pylist()]
                parts = [x for ids in rows for x in (ids, end)]
                counts = np.array([len(ids) + len(end) for ids in rows], np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                tokens = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:low + 512], pa.array(np.full(len(rows), part, np.int32)),
                     pa.array(at + bounds[:-1]), pa.array(counts), tokens], schema=OUTPUT)
                at += int(bounds[-1])
    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write (doc_id, part, at, n_tokens, tokens) in ascending order of id.

    File order is id order: the rows are range-sorted, `part` is the range and `at` counts the ids
    before the document in its range. A null text is an empty one and has only the end id (no ids if
    there is none). Rows without an id come first; rows with the same id stand side by side, ordered
    by text. Other columns of `docs` are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    (rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_encode(vocabulary, end_id), FILE_COLUMNS)
     .write.options(**WRITE_OPTIONS).parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) from the number columns alone; `start` counts all ids before."""
    rows = spark.read.schema(FILE_COLUMNS).parquet(path)
    return with_start(rows.select("doc_id", "part", "at", "n_tokens"))


def with_start(rows: DataFrame) -> DataFrame:
    """Replace (part, at) by the position in the whole corpus: one sum per range, added up."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part")).select(
        "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    return rows.join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"),
        *[c for c in rows.columns if c not in ("doc_id", "part", "at")])


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The documents' ids. A condition on doc_id reaches the row groups and page indexes."""
    rows = spark.read.schema(FILE_COLUMNS).parquet(path)
    return (rows.where(where) if where is not None else rows).select("doc_id", "n_tokens", "tokens")


def _checksum(batches):
    for batch in batches:
        tokens = batch.column(3)
        bounds = tokens.offsets.to_numpy()
        data = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(3)], pa.array(np.diff(bounds).astype(np.int64)),
             pa.array(np.array(sums, np.int64))],
            names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all of it read back from the files' ids."""
    rows = spark.read.schema(FILE_COLUMNS).parquet(path).select("doc_id", "part", "at", "tokens")
    sums = rows.mapInArrow(
        _checksum, "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint")
    totals = spark.read.schema(FILE_COLUMNS).parquet(path).groupBy("part").agg(
        F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("before"))
    return sums.join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
