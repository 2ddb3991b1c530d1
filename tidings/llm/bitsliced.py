"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of similar size form a block. A block holds a Bloom signature of each of its documents, stored by
slice: slice j is a bitmap over the documents, and the documents that may hold a term are those in all of the
term's slices. A term that occurs several times is entered again for every level of `LEVELS` it reaches, so the
bitmaps also bound how often it occurs. Bitmaps only ever say too much; sums of term weights over them, level
by level, are therefore upper bounds of scores. Within a block, documents are rescored exactly in the order of
their bounds until no bound reaches the score of the worst document kept; the others are excluded by proof.

The exact counts that a rescoring needs lie beside the slices in the same row, so the search of a block neither
shuffles nor looks anything up. The index depends on no query and is written once.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidings.llm.words import NOT_ALNUM, Words, mix, runs
from tidings.shared import materialize, new_path

#: A block closes at so many documents, or at so many (term, level) entries by its size class.
BLOCK_DOCS, BLOCK_ENTRIES = 1024, 1 << 16
#: Slices per entry of the largest document of a block, and slices set by an entry.
SLICES_PER_ENTRY, SLICES_SET = 8, 3
#: The smallest size class of documents, in entries; classes double.
LEAST_CLASS = 16
#: Every so many blocks of a task, beginning with its first, are searched before the others. What they give
#: sets the score that the search of the others starts from; it changes no result.
AHEAD = 16
#: A set of items that is searched in one pass: items, and terms of all of them.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 2000, 400_000

#: Counts at which a term reaches the next level: 1, 2, 3, 5, 9, ...
LEVELS = np.array([1, *[(1 << i) + 1 for i in range(0, 40)]], np.int64)

INDEX = ("ahead boolean, n_docs int, n_terms bigint, most int, slices int, ids array<bigint>, "
         "lengths array<bigint>, bits binary, bounds array<int>, terms array<bigint>, counts array<int>")
#: A row of the index may take a megabyte, so few of them form a row group.
WRITE_OPTIONS = {"compression": "zstd", "parquet.block.row.count.limit": "16"}

STEP = np.uint64(0x9E3779B97F4A7C15)


def entry_slices(terms: np.ndarray, level: np.ndarray | int, slices: int) -> list[np.ndarray]:
    """The slices that an entry of a term at a level sets."""
    hashed = mix(terms + STEP * np.asarray(level + 1, np.uint64))
    out = []
    for _ in range(SLICES_SET):
        out.append((hashed % np.uint64(slices)).astype(np.int64))
        hashed = mix(hashed + STEP)
    return out


class _Block:
    """Documents of one size class that wait for their block to fill."""

    def __init__(self, size: int):
        self.slices = size * SLICES_PER_ENTRY
        self.room = max(1, min(BLOCK_DOCS, BLOCK_ENTRIES // size))
        self.docs = []

    def add(self, doc_id, length: int, terms: np.ndarray, counts: np.ndarray) -> bool:
        self.docs.append((doc_id, length, terms, counts))
        return len(self.docs) == self.room

    def row(self, ahead: bool) -> dict:
        ids, lengths, terms, counts = zip(*self.docs, strict=True)
        sizes = np.array([len(x) for x in terms])
        terms, counts = np.concatenate(terms), np.concatenate(counts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        matrix = np.zeros((self.slices, len(sizes)), np.uint8)
        for level, least in enumerate(LEVELS[:levels_up_to(int(counts.max()))].tolist()):
            held = np.flatnonzero(counts >= least)
            for at in entry_slices(terms[held], level, self.slices):
                matrix[at, doc[held]] = 1
        self.docs = []
        return {"ahead": ahead, "n_docs": len(ids), "n_terms": sum(lengths), "most": int(counts.max()),
                "slices": self.slices, "ids": list(ids), "lengths": list(lengths),
                "bits": np.packbits(matrix, axis=1).tobytes(),
                "bounds": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
                "terms": terms.view(np.int64), "counts": counts.astype(np.int32)}


def levels_up_to(most: int) -> int:
    """How many levels a term that occurs `most` times reaches."""
    return int(np.searchsorted(LEVELS, most, "right"))


ARROW = pa.schema([
    ("ahead", pa.bool_()), ("n_docs", pa.int32()), ("n_terms", pa.int64()), ("most", pa.int32()),
    ("slices", pa.int32()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ("bits", pa.binary()), ("bounds", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int32()))])


def _index(batches):
    waiting: dict[int, _Block] = {}
    written = 0

    def out(block):
        nonlocal written
        row = block.row(written % AHEAD == 0)
        written += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([row[f.name]], f.type) for f in ARROW], schema=ARROW)

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for low, _, data, bounds in runs(batch.column(1)):
            words = Words(data, bounds, lower=True, between=NOT_ALNUM)
            for row in np.flatnonzero(words.count):
                terms, counts = np.unique(
                    words.hash[words.first[row]:words.first[row + 1]], return_counts=True)
                entries = int(np.searchsorted(LEVELS, counts, "right").sum())
                size = max(LEAST_CLASS, 1 << (entries - 1).bit_length())
                block = waiting.setdefault(size, _Block(size))
                if block.add(ids[low + row], int(words.count[row]), terms, counts):
                    yield out(block)
    for block in waiting.values():
        if block.docs:
            yield out(block)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of all documents that have a term, one block of documents a row.

    Terms are maximal runs of ASCII letters, ASCII digits and characters beyond ASCII, with A-Z in lower case,
    and are told apart by 64-bit hashes. Texts are indexed whole, each row for itself, whether or not its id
    is null or comes again; null texts have no terms. A task keeps the documents of its unfinished blocks,
    one block per size class.
    """
    (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
     .mapInArrow(_index, INDEX).write.options(**WRITE_OPTIONS).partitionBy("ahead").parquet(path))


# --- items ------------------------------------------------------------------------------------------

def _item_terms(batches):
    for batch in batches:
        for low, high, data, bounds in runs(batch.column(1)):
            words = Words(data, bounds, lower=True, between=NOT_ALNUM)
            terms = [np.unique(words.hash[a:b]).view(np.int64)
                     for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[low:high], pa.array(terms, pa.list_(pa.int64()))],
                names=["item_id", "terms"])


def item_sets(items: DataFrame, id_col: str, text_col: str):
    """Lists of (item_id, distinct terms), each small enough to be sent to all tasks. Items without terms find
    nothing and are left out."""
    rows = (items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
            .mapInArrow(_item_terms, f"item_id {items.schema[id_col].dataType.simpleString()}, "
                                     "terms array<bigint>").where("size(terms) > 0"))
    some, size = [], 0
    for row in rows.toLocalIterator():
        terms = np.array(row["terms"], np.int64).view(np.uint64)
        if some and (len(some) == ITEMS_AT_ONCE or size + len(terms) > TERMS_AT_ONCE):
            yield some
            some, size = [], 0
        some.append((row["item_id"], terms))
        size += len(terms)
    if some:
        yield some


def _frequencies(wanted: np.ndarray):
    def run(batches):
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            terms = batch.column(0).flatten().to_numpy().view(np.uint64)     # once per document
            at = np.minimum(np.searchsorted(wanted, terms), len(wanted) - 1)
            found += np.bincount(at[wanted[at] == terms], minlength=len(wanted))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["at", "n"])
    return run


def term_weight(n: int, df: int) -> int:
    """The weight of a term that `df` of `n` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Query:
    """A set of items, their terms' weights, and the figures of the corpus; sent to every task."""

    def __init__(self, some: list, index: DataFrame, docs: int, words: int):
        self.n, self.total = docs, words
        terms = np.unique(np.concatenate([t for _, t in some]))
        df = np.zeros(len(terms), np.int64)
        for row in (index.select("terms").mapInArrow(_frequencies(terms), "at bigint, n bigint")
                    .groupBy("at").agg(F.sum("n").alias("n")).collect()):     # at most TERMS_AT_ONCE rows
            df[row["at"]] = row["n"]
        self.terms = terms[df > 0]
        self.weights = np.array([term_weight(docs, x) for x in df[df > 0].tolist()], np.int64)
        place = np.cumsum(df > 0) - 1
        self.items = []
        for _, t in some:
            at = np.searchsorted(terms, t)
            self.items.append(place[at[df[at] > 0]])

    def document_part(self, length: np.ndarray) -> np.ndarray:
        """What a document's length adds to the divisor."""
        return 50 + (50 * length * self.n) // self.total


def gain(count, part):
    """What a term adds for each unit of its weight, in whole numbers."""
    return (1_000_000_000 * count) // (1000 * count + 20 * part)


# --- the search of a block --------------------------------------------------------------------------

class _Documents:
    """A row of the index."""

    def __init__(self, ids, missing, lengths, bits, slices, most, bounds, terms, counts, query):
        self.ids, self.missing, self.n = ids, missing, len(ids)
        self.bits = np.frombuffer(bits, np.uint8).reshape(slices, -1)
        self.part = query.document_part(lengths)
        self.most = most
        doc = np.repeat(np.arange(self.n, dtype=np.uint64), np.diff(bounds))
        self.terms, self.counts = terms, counts
        self.keys = (doc << np.uint64(52)) | (terms >> np.uint64(12))      # ascending

    def bounds_of_scores(self, query: Query) -> np.ndarray:
        """For each item and document, a number that its score does not exceed."""
        out = np.zeros((len(query.items), self.n), np.float32)
        possible = np.arange(len(query.terms))
        held = None
        levels = levels_up_to(self.most)
        for level in range(levels):
            at = entry_slices(query.terms[possible], level, len(self.bits))
            maps = self.bits[at[0]]
            for more in at[1:]:
                maps = maps & self.bits[more]
            if held is not None:        # who holds a term so often also holds it less often
                maps &= held
            some = maps.any(1)
            possible, held = possible[some], maps[some]
            if not len(possible):
                break
            place = np.full(len(query.terms), -1)
            place[possible] = np.arange(len(possible))
            upto = min(int(LEVELS[level + 1]) - 1, self.most)
            step = (gain(np.int64(upto), self.part)
                    - gain(LEVELS[level] - 1, self.part)).astype(np.float32)
            weights = query.weights[possible].astype(np.float32)
            for i, terms in enumerate(query.items):
                rows = place[terms]
                rows = rows[rows >= 0]
                if len(rows):
                    present = np.unpackbits(held[rows], axis=1, count=self.n)
                    out[i] += step * (weights[rows] @ present.astype(np.float32))
        # More than what a sum of so many numbers may lose in single precision.
        slack = [1 + 1e-6 * (len(terms) + 100) for terms in query.items]
        return out * np.array(slack, np.float32)[:, None]

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The scores of some documents."""
        wanted = (docs.astype(np.uint64)[:, None] << np.uint64(52)) | (terms >> np.uint64(12))
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = (self.keys[at] == wanted) & (self.terms[at] == terms)
        count = np.where(found, self.counts[at], 0).astype(np.int64)
        return (weights * gain(count, self.part[docs][:, None])).sum(1)


class _Best:
    """The k best documents of an item so far: by score, then by smaller id, a missing one last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)       # a score of 0 is no hit
        self.kept = []
        self.n = 0

    def add(self, score, ids, missing):
        good = score >= self.least
        if good.any():
            self.kept.append((score[good], ids[good], missing[good]))
            self.n += int(good.sum())
            if self.n > 4 * self.k:
                self.cut()

    def cut(self):
        score, ids, missing = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        order = np.lexsort((ids, missing, -score))[:self.k]
        self.kept, self.n = [(score[order], ids[order], missing[order])], len(order)
        if len(order) == self.k:
            self.least = max(self.least, int(score[order[-1]]))


def _search(query: Query, k: int, floors: list[int]):
    def run(batches):
        best = [_Best(k, x) for x in floors]
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for row in range(len(batch)):
                def values(name, row=row, column=column):
                    return column[name][row].values
                ids = values("ids")
                block = _Documents(
                    ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False),
                    values("lengths").to_numpy(), column["bits"][row].as_buffer(),
                    column["slices"][row].as_py(), column["most"][row].as_py(),
                    values("bounds").to_numpy(), values("terms").to_numpy().view(np.uint64),
                    values("counts").to_numpy(), query)
                upper = block.bounds_of_scores(query)
                for i, mine in enumerate(best):
                    terms, weights = query.terms[query.items[i]], query.weights[query.items[i]]
                    open_ = np.flatnonzero(upper[i] >= mine.least)
                    open_ = open_[np.argsort(-upper[i][open_], kind="stable")]
                    size = k
                    while len(open_):       # the most promising ones first: they raise what others must reach
                        now, open_ = open_[:size], open_[size:]
                        mine.add(block.exact(now, terms, weights), block.ids[now], block.missing[now])
                        if mine.n > k:
                            mine.cut()
                        open_ = open_[upper[i][open_] >= mine.least]
                        size *= 2
        for i, mine in enumerate(best):
            if mine.n:
                mine.cut()
                score, ids, missing = mine.kept[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=missing), pa.array(score)],
                    names=["item", "doc_id", "score"])
    return run


HITS = "item int, doc_id bigint, score bigint"


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each item with their rank; a task passes at most k of an item on."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, items: DataFrame, k: int, id_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item in the index at `path`.

    An item's terms count once each. The score is that of BM25 with a weight per term, in whole numbers, and
    takes the counts of documents, words and terms from the whole index. Documents without a term of the item
    are no hits; equal scores go by the smaller id, a missing id last, and rows that share an id are ranked
    each for itself. Items that share an id have a ranking each; a null or empty item has none. An empty index
    or no items: no rows. Other columns are ignored.

    Items are searched in sets of bounded size, each in two passes over the index: some blocks first, whose
    k-th best score is the floor for all others.
    """
    index = spark.read.schema(INDEX).parquet(path)
    docs, words = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = new_path(spark, "ranked")
    item_type = items.schema[id_col].dataType
    empty = spark.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id bigint, "
                                      "score bigint")
    empty.write.parquet(out)
    for some in item_sets(items, id_col, text_col) if docs else ():
        query = Query(some, index, docs, words)
        first = materialize(index.where("ahead").drop("ahead").mapInArrow(
            _search(query, k, [1] * len(some)), HITS), "hits")
        floors = [1] * len(some)
        for row in _ranked(first, k).where(F.col("rank") == k).collect():      # one row an item
            floors[row["item"]] = row["score"]
        rest = index.where("NOT ahead").drop("ahead").mapInArrow(_search(query, k, floors), HITS)
        names = spark.createDataFrame(
            [(i, item_id) for i, (item_id, _) in enumerate(some)],
            f"item int, item_id {item_type.simpleString()}")
        (_ranked(first.unionByName(rest), k).join(F.broadcast(names), "item")      # at most ITEMS_AT_ONCE rows
         .select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out))
    return spark.read.schema(empty.schema).parquet(out)
