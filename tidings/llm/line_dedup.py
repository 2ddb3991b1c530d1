"""Lines that come again in several documents, removed by a range sort of line hashes.

Every line of some length is hashed (128 bits). The hashes are range-partitioned together with document
and position, and each range is sorted and streamed once: the first document of a hash in that order keeps its
lines, later ones lose theirs as soon as enough documents have been seen. What leaves the stream is a bitmap
of kept lines per document, not text.

A line that a third of all documents hold spans many ranges. A range decides the hashes that lie wholly
within it; rows of the hash that it begins or ends with, at most two a range, are decided by a join with the
counts of just those hashes.
"""

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidings.shared import materialize

#: Characters that don't count at either end of a line: space and 0x09 to 0x0D.
EDGES = b" \t\n\x0b\x0c\r"
#: Rows of lines that leave a task at a time.
ROWS = 1 << 16

LINES = "high bigint, low bigint, doc bigint, version bigint, pos int"
STREAMED = LINES + ", kind int"
#: What a row says that leaves the stream: lose this line; decide it later; this document has the hash.
LOSE, LATER, WITNESS = 0, 1, 2

#: Stands for a missing id: below all others.
NO_ID = -(1 << 63)


def _version(text: Column, doc_id: Column) -> Column:
    """Tells rows apart that share an id. Equal rows stay equal and are decided alike."""
    return F.xxhash64(text, doc_id.isNull())


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, text), null texts as empty ones."""
    doc_id, text = F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"),
                       _version(text, doc_id).alias("version"), text.alias("text"))


def line_key(line: bytes, least: int) -> bytes | None:
    """The line stripped and with A-Z in lower case, or None if it has under `least` code points."""
    key = line.strip(EDGES)
    if len(key) < least or not key.isascii() and len(key.decode()) < least:
        return None
    return key.lower()      # of bytes: A-Z only


def _lines(least: int):
    def run(batches):
        digests, docs, versions, places = [], [], [], []

        def rows():
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()),
                 pa.array(versions, pa.int64()), pa.array(places, pa.int32())],
                names=["high", "low", "doc", "version", "pos"])
            for kept in (digests, docs, versions, places):
                kept.clear()
            return batch

        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for i, (doc, version) in enumerate(zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                for pos, line in enumerate(texts[i].as_py().split(b"\n")):
                    key = line_key(line, least)
                    if key is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        versions.append(version)
                        places.append(pos)
                        if len(docs) == ROWS:
                            yield rows()
        yield rows()
    return run


class _Stream:
    """Decides sorted rows (high, low, doc descending, version, pos), one call per batch.

    Between two calls it keeps the unfinished hash only: how many documents had it, and the rows that can't be
    decided yet, which are those of its first `copies` - 1 documents at most.
    """

    def __init__(self, copies: int):
        self.copies = copies
        self.rows = np.empty((0, 5), np.int64)     # open rows of the unfinished hash
        self.seen = 0                              # documents of it whose rows are no longer open
        self.last = None                           # (high, low, doc) of the last row
        self.first_hash = None
        self.witnesses = np.empty((0, 5), np.int64)

    def feed(self, fresh: np.ndarray):
        """Rows lost and rows to be decided later, as two arrays."""
        if not len(fresh):
            return fresh, fresh
        if self.first_hash is None:
            self.first_hash = tuple(fresh[0, :2])
        rows = np.concatenate([self.rows, fresh])
        new_hash = np.ones(len(rows), bool)
        new_hash[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        new_doc = new_hash.copy()
        new_doc[1:] |= rows[1:, 2] != rows[:-1, 2]
        offset = 0
        if self.seen:       # the hash goes on without open rows: its documents were counted before
            same = tuple(rows[0, :2]) == self.last[:2]
            new_doc[0] = not (same and rows[0, 2] == self.last[2])
            offset = self.seen if same else 0
        run = np.cumsum(new_hash) - 1
        starts = np.flatnonzero(new_hash)
        nth = np.cumsum(new_doc)                   # documents up to here
        before = nth[starts] - new_doc[starts]
        nth = nth - before[run]                    # 1 for the first document of the hash
        nth[run == 0] += offset
        ends = np.append(starts[1:], len(rows)) - 1
        enough = nth[ends][run] >= self.copies
        first = (run == 0) & (tuple(rows[0, :2]) == self.first_hash)
        ending = run == run[-1]
        lost = enough & (nth > 1) & ~first
        opened = ending & ~enough & ~first
        begin = starts[-1]
        if not first[-1] and enough[-1]:
            if nth[begin] <= 1:     # the hash began in this call: remember who has it
                within = np.flatnonzero(ending & new_doc)[:self.copies]
                self.witnesses = rows[within]
            self.seen = int(nth[-1])
        elif first[-1]:
            self.seen = int(nth[-1])
        else:
            self.seen = 0
        self.last = tuple(rows[-1, :3])
        self.rows = rows[opened]
        return rows[lost], rows[first]

    def end(self):
        """Rows to be decided later, and witnesses of the last hash if its lines are being lost."""
        of_last = len(self.witnesses) and self.last[:2] == tuple(self.witnesses[0, :2])
        return self.rows, self.witnesses if of_last else self.witnesses[:0]


def _decide(copies: int):
    def batch_of(rows, kind):
        columns = [pa.array(rows[:, i]) for i in range(4)]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(rows[:, 4].astype(np.int32)),
             pa.array(np.full(len(rows), kind, np.int32))],
            names=["high", "low", "doc", "version", "pos", "kind"])

    def run(batches):
        stream = _Stream(copies)
        for batch in batches:
            lost, later = stream.feed(np.stack(
                [batch.column(i).to_numpy().astype(np.int64) for i in range(5)], 1))
            yield batch_of(lost, LOSE)
            yield batch_of(later, LATER)
        later, witnesses = stream.end()
        yield batch_of(later, LATER)
        yield batch_of(witnesses, WITNESS)
    return run


def _bitmap(batches):
    for batch in batches:
        maps = []
        for places in batch.column(2).to_pylist():
            keep = np.ones((max(places) // 8 + 1) * 8, np.uint8)       # whole bytes
            keep[places] = 0
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(maps, pa.binary())],
            names=["doc", "version", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 20, copies: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc, version, keep) of the documents that lose a line: `keep` has a bit per line (compressed, low bits
    first; lines after the last bit stay).

    A line whose key (`line_key`) has at least `least` code points and is found in at least `copies` documents
    is lost in all of them but the one with the largest id. Documents are told apart by id: rows that share an
    id count once and, if it is the largest, all keep their lines; rows without an id count together as the
    smallest one. Several equal lines of a document are kept or lost together. Null and empty texts have one
    empty line, which is never lost. No documents, no rows; other columns are ignored.
    """
    lines = materialize(_keyed(docs, id_col, text_col).mapInArrow(_lines(least), LINES), "lines",
                        compression="zstd")
    # The written table is what the bounds of the ranges are sampled from.
    key = ["high", "low", F.col("doc").desc(), "version", "pos"]
    streamed = materialize(
        lines.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_decide(copies), STREAMED),
        "line-decisions", compression="zstd")
    # At most two hashes a range, so this is as many rows as there are ranges, twice.
    edges = (streamed.where(F.col("kind") != LOSE).groupBy("high", "low")
             .agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("largest"))
             .where(F.col("docs") >= copies).select("high", "low", "largest"))
    later = (streamed.where(F.col("kind") == LATER).join(F.broadcast(edges), ["high", "low"])
             .where("doc < largest"))
    lost = streamed.where(F.col("kind") == LOSE).select("doc", "version", "pos").unionByName(
        later.select("doc", "version", "pos"))
    return (lost.groupBy("doc", "version").agg(F.collect_set("pos").alias("places"))
            .mapInArrow(_bitmap, "doc bigint, version bigint, keep binary"))


def _apply(batches):
    for batch in batches:
        texts, maps = batch.column(1).cast(pa.large_binary()), batch.column(2)
        n_lines, n_lost, kept = [], [], []
        for i in range(len(batch)):
            text, keep = texts[i].as_py(), maps[i].as_py()
            if keep is None:
                n_lines.append(text.count(b"\n") + 1)
                n_lost.append(0)
            else:
                lines = text.split(b"\n")
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
                bits = np.concatenate([bits[:len(lines)], np.ones(max(len(lines) - len(bits), 0), np.uint8)])
                text = b"\n".join([x for x, stays in zip(lines, bits.tolist(), strict=True) if stays])
                n_lines.append(len(lines))
                n_lost.append(len(lines) - int(bits.sum()))
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_lost, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "text"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): each row of `docs` with the lines its bitmap keeps, joined by line
    feeds. Rows without a bitmap stay as they are; null texts become empty ones. Rows that repeat share a
    bitmap."""
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumns({"doc": F.coalesce("doc_id", F.lit(NO_ID)),
                               "version": _version(F.col("text"), F.col("doc_id"))})
    return (keyed.join(bitmaps, ["doc", "version"], "left").select("doc_id", "text", "keep")
            .mapInArrow(_apply, "doc_id bigint, n_lines bigint, n_dropped bigint, text string"))
