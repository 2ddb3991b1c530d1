"""Importance resampling towards a target: hashed word features, weights and a draw without replacement.

A feature is a word or two words with a space between. Its bucket is a checksum of its bytes. The checksums of a
run of texts are computed together: distinct features of equal length form the rows of a matrix of bytes, all
checksums of the matrix advance by one column at a time, and the results are scattered back to every place
where the feature stands.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidings.llm.words import NOT_ALNUM, Words, runs, windows
from tidings.shared import materialize

BUCKETS = 10_000
#: Features longer than this are rare and long; a matrix of one row would gain nothing over the library.
LONG = 4096
#: Bytes of a matrix at a time.
MATRIX = 1 << 20


def _crc_table() -> np.ndarray:
    """What a byte adds to the checksum (reflected polynomial of CRC-32)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC_TABLE = _crc_table()
#: Bytes with A-Z in lower case.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def crc32_of_rows(matrix: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each row of bytes."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32_of_ranges(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of many ranges of `data`, those of equal length together."""
    out = np.empty(len(begin), np.uint32)
    order = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        n = int(length[order[low]])
        if n > LONG:
            for i in order[low:high]:
                out[i] = zlib.crc32(data[begin[i]:begin[i] + n])
            continue
        step = max(MATRIX // max(n, 1), 1)
        for at in range(low, high, step):
            rows = order[at:min(at + step, high)]
            out[rows] = crc32_of_rows(data[begin[rows][:, None] + np.arange(n)])
    return out


def features(data: np.ndarray, bounds: np.ndarray, buckets: int):
    """Words of a run of texts, and bucket and row of every feature: of the words, then of the pairs.

    Distinct features are told apart by 64-bit hashes.
    """
    words = Words(data, bounds, lower=True, between=NOT_ALNUM)
    pair_hash, pair_first, per_row = windows(words, 2)
    size = words.end - words.start
    # All words in a row with a space after each: a pair is then a range, as a word is.
    after = np.cumsum(size + 1)
    begin = after - size - 1
    clean = np.full(int(after[-1]) if len(after) else 0, 32, np.uint8)
    place = np.arange(len(clean)) - np.repeat(begin, size + 1) + np.repeat(words.start, size + 1)
    inside = np.ones(len(clean), bool)
    inside[after - 1] = False
    clean[inside] = LOWERED[data[place[inside]]]
    hashed = np.concatenate([words.hash, pair_hash])
    starts = np.concatenate([begin, begin[pair_first]])
    lengths = np.concatenate([size, size[pair_first] + 1 + size[np.minimum(pair_first + 1, len(size) - 1)]]
                             ) if len(size) else starts
    _, first, back = np.unique(hashed, return_index=True, return_inverse=True)
    crc = crc32_of_ranges(clean, starts[first], lengths[first])
    row = np.concatenate([words.doc, words.doc[pair_first]])
    return words, (crc % np.uint32(buckets)).astype(np.int64)[back], row, per_row


def _count(buckets: int):
    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in runs(batch.column(0)):
                counts += np.bincount(features(data, bounds, buckets)[1], minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])
    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket. A task sends one row per bucket."""
    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(_count(buckets), "bucket bigint, n bigint")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())       # at most `buckets` rows
    counts = np.zeros(buckets, np.int64)
    for row in rows:
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of a bucket's share in the target to that in the raw texts, with one feature
    added to every bucket, rounded down."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([
        math.floor(1000 * math.log(((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n))))
        for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gains: np.ndarray):
    def run(batches):
        for batch in batches:
            for low, high, data, bounds in runs(batch.column(1)):
                words, bucket, row, per_row = features(data, bounds, len(gains))
                n = words.count + per_row
                order = np.argsort(row, kind="stable")
                total = np.concatenate([[0], np.cumsum(gains[bucket[order]])])
                after = np.cumsum(n)
                summed = total[after] - total[after - n]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(words.count.astype(np.int64)),
                     pa.array(n.astype(np.int64)), pa.array(summed // np.maximum(n, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"])
    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate made of the id's hash, rounded down. A missing id counts as an empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def _places(batches):
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = len(batch)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))],
            names=[*batch.schema.names, "part", "at"])
        at += n


def resample(docs: DataFrame, target: DataFrame, percent: int, least_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text",
             target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all documents; the drawn ones have a rank, from 1 on.

    `weight` is the mean gain of a document's features, `score` the weight and a Gumbel variate of its id, and
    of the documents with at least `least_words` words the `percent` hundredths of highest score are drawn, ties
    by the smaller id (a missing id last). Null and empty texts have no features and weight 0. Rows that
    repeat are drawn each for itself. An empty target gives every bucket a target count of 0; no documents, no
    rows. Other columns are ignored.

    All counts come from all texts. The rank is a place in a range sort of narrow rows, with one sum per range;
    rows that tie are spread over ranges by a further key, so equal ids do not gather in one task.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(rows, buckets), bucket_counts(target, buckets, target_text))
    weighed = rows.mapInArrow(
        _weigh(gains), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = materialize(weighed.select(
        "doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
        (F.col("n_words") >= least_words).alias("long_enough"),
        F.monotonically_increasing_id().alias("row")), "scored", compression="zstd")
    key = [F.col("long_enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    fields = "doc_id bigint, n_features bigint, weight bigint, score bigint, long_enough boolean"
    placed = materialize(
        scored.repartitionByRange(*key).sortWithinPartitions(*key)
        .select("doc_id", "n_features", "weight", "score", "long_enough")
        .mapInArrow(_places, f"{fields}, part int, at bigint"), "placed", compression="zstd")
    counted = placed.groupBy("part").agg(F.count("*").alias("rows"), F.count_if("long_enough").alias("able"))
    parts = counted.select(        # one row a range
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"),
        F.floor(F.sum("able").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    place = F.col("before") + F.col("at")
    return placed.join(parts, "part").select(
        "doc_id", "n_features", "weight", "score",
        F.when(F.col("long_enough") & (place <= F.col("drawn")), place).alias("rank"))
