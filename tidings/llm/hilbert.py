"""Packing along a space-filling curve: documents that are near in content share sequences."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidings.llm.encode import encoder
from tidings.llm.words import mix
from tidings.shared import materialize

DIMENSIONS, BITS = 4, 15


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of points with whole coordinates below 2^bits (one row each)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    d = len(x)
    for bit in range(bits - 1, 0, -1):
        q, below = 1 << bit, (1 << bit) - 1
        for i in range(d):
            here = (x[i] & q) != 0
            swap = np.where(here, 0, (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(here, below, swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (((x[i] ^ turn) >> bit) & 1)
    return key


def token_directions(n: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A hashed direction for each id. Later merges are rarer and say more: the weight grows."""
    h = mix(np.arange(1, n + 1, dtype=np.uint64))
    signs = [((h >> np.uint64(7 * i)) & np.uint64(127)).astype(np.float32) / 63.5 - 1
             for i in range(dimensions)]
    return np.stack(signs, 1) * np.log1p(np.arange(n, dtype=np.float32))[:, None]


def curve_keys(ids: np.ndarray, bounds: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each document, from the mean direction of its ids. No ids: the middle."""
    n = np.diff(bounds)
    means = np.zeros((len(n), directions.shape[1]))
    full = np.flatnonzero(n)
    for i in range(directions.shape[1]) if len(full) else ():
        means[full, i] = np.add.reduceat(directions[ids, i], bounds[full]) / np.sqrt(n[full])
    cells = (0.5 + 0.5 * np.tanh(means / 8)) * ((1 << BITS) - 1)
    return hilbert_key(cells.astype(np.int64))


def _encode(vocabulary: str, end_id: int):
    def run(batches):
        enc = encoder(vocabulary)
        directions = token_directions(max(enc.tokenizer.get_vocab_size(), end_id + 1))
        end = np.array([end_id], enc.type).tobytes()
        for batch in batches:
            for low in range(0, len(batch), 512):
                rows = [enc.ids(t) for t in batch.column(1)[low:low + 512].to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) // enc.width for x in rows])])
                keys = curve_keys(np.frombuffer(b"".join(rows), enc.type), bounds, directions)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:low + 512], pa.array(keys),
                     pa.array(np.diff(bounds) + 1),
                     pa.array(np.full(len(rows), enc.width, np.int32)),
                     pa.array([x + end for x in rows], pa.binary())],
                    names=["doc_id", "curve", "n_tokens", "width", "ids"])
    return run


def _positions(batches):
    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.column(1).to_numpy()
        after = at + np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(after - n),
             pa.array(np.full(len(batch), part, np.int32))],
            names=["row", "n_tokens", "at", "part"])
        at = int(after[-1]) if len(after) else at


def tail_bounds(total: int, size: int) -> list[int]:
    """Where sequences end after the last full one: the rest as falling powers of two, no padding."""
    at, bounds = total - total % size, []
    for bit in range(size.bit_length() - 1, -1, -1):
        if total % size & (1 << bit):
            at += 1 << bit
            bounds.append(at)
    return bounds


def _cut(size: int):
    def run(batches):
        for batch in batches:
            out = []
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for doc, start, width, ids, total in zip(*columns, strict=True):
                data = np.frombuffer(ids, "<u2" if width == 2 else "<u4").astype("<u4")
                full, tail = total - total % size, None
                at = 0
                while at < len(data):
                    place = start + at
                    if place < full:
                        sequence, offset = divmod(place, size)
                        room = size - offset
                    else:
                        tail = tail or tail_bounds(total, size)
                        k = int(np.searchsorted(tail, place, "right"))
                        begin = tail[k - 1] if k else full
                        sequence, offset, room = full // size + k, place - begin, tail[k] - place
                    piece = data[at:at + room]
                    out.append((doc, at, len(piece), zlib.crc32(piece), len(data), sequence, offset))
                    at += len(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 7)],
                names=PIECE_COLUMNS)
    return run


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_along_curve(docs: DataFrame, vocabulary: str, end_id: int, size: int = 1024,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of `size` ids; one row per piece of a document.

    Each document is its ids and `end_id`. A hashed direction per id gives the document a vector of
    four dimensions; documents are range-sorted by the vector's Hilbert key (ties by id, then by
    row), laid end to end in that order and cut every `size` ids. What remains after the last full
    sequence becomes sequences of falling powers of two, so nothing is padded. `size` has to be a
    power of two. A null text is an empty one, of one id. Rows are packed each for itself, also if
    they repeat; an id may be null. No documents, no pieces. Other columns are ignored.

    Only (key, id, row, length) is range-sorted; the ids meet their position by a join on a unique
    row number, so neither a frequent text nor a frequent key gathers in one task.
    """
    if size & (size - 1):
        raise ValueError("size has to be a power of two")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = materialize(
        rows.mapInArrow(_encode(vocabulary, end_id),
                        "doc_id bigint, curve bigint, n_tokens bigint, width int, ids binary")
        .withColumn("row", F.monotonically_increasing_id()), "packing", compression="zstd")
    order = materialize(
        encoded.select("row", "n_tokens", "curve", "doc_id")
        .repartitionByRange("curve", "doc_id", "row")
        .sortWithinPartitions("curve", "doc_id", "row").select("row", "n_tokens")
        .mapInArrow(_positions, "row bigint, n_tokens bigint, at bigint, part int"), "order")
    parts = order.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    ranges = parts.select(
        "part", F.sum("in_part").over(Window.partitionBy()).alias("total"),
        (F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).alias("before"))
    placed = order.join(ranges, "part").select(
        "row", (F.col("before") + F.col("at")).alias("start"), "total")
    return (encoded.select("row", "doc_id", "width", "ids").join(placed, "row")
            .select("doc_id", "start", "width", "ids", "total")
            .mapInArrow(_cut(size), ", ".join(f"{c} bigint" for c in PIECE_COLUMNS)))
