"""Benchmark decontamination: BM25 retrieval of test items for every passage, then an overlap check.

The test items are the index, every passage of the corpus is a query. Impacts are scaled by the score
that an item has with itself, so one threshold holds for all items. Items of like length stand in
blocks; bounds per term, and per term and block, rule out passages and blocks before any score is
computed, and rule out none that reaches the threshold.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidings.llm.words import NOT_ALNUM, Words, runs, signed
from tidings.shared import materialize

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage has to reach; shares of the word triples of the item's
#: question and answer that the document has to hold. Shorter items are held as pairs or single words.
RETRIEVED, QUESTION, ANSWER = 0.4, 0.6, 0.6
#: Share of the word triples of the whole item that is enough without regard to its parts, so that an
#: edited item, or one without its answer, is found.
WHOLE = 0.45
#: Items of one index, which goes to every task; more items make more indexes.
INDEX_ITEMS = 5_000
BLOCK_ITEMS = 16
#: Postings that are scored at once.
GROUP_ENTRIES = 1 << 19
#: Part of an item's words, from its end, that counts as its answer.
ANSWER_PART = 1 / 3


@dataclass
class Index:
    """Postings of each term, in item order, with scaled impacts; bounds; word triples of the items."""

    terms: np.ndarray                 # sorted hashes
    begin: np.ndarray                 # of a term's postings
    item: np.ndarray
    impact: np.ndarray
    bound: np.ndarray                 # of a term, over all items
    block_bound: np.ndarray           # of a term and block
    ids: list
    question: list[np.ndarray]
    answer: list[np.ndarray]
    size: list[int]                   # words of one hash of the item's parts
    passage: int                      # words of a passage


def grams(words: Words, first: int, after: int, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words, one to three, within words first..after."""
    h = words.hash[first:after]
    if len(h) < size:
        return np.empty(0, np.uint64)
    if size == 1:
        return np.unique(h)
    if size == 2:
        return np.unique(h[:-1] * np.uint64(3) + h[1:] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15)
                     + h[2:] * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Corpus:
    """What all items have in common where they are split over indexes; `df` is by sorted `terms`."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def build_index(rows: list[tuple], corpus: Corpus | None = None) -> Index | None:
    """From (item_id, text). Items without words can't be found and are left out. Without a corpus
    the items are all there are."""
    parsed = []
    for item_id, text in rows:
        for _, _, data, bounds in runs(pa.array([text], pa.string())):
            words = Words(data, bounds, lower=True, between=NOT_ALNUM)
            if len(words):
                parsed.append((item_id, words))
    if not parsed:
        return None
    parsed.sort(key=lambda x: (len(x[1]), str(x[0])))
    lengths = np.array([len(w) for _, w in parsed], float)
    counted = [np.unique(w.hash, return_counts=True) for _, w in parsed]
    item = np.repeat(np.arange(len(parsed)), [len(h) for h, _ in counted])
    terms, term = np.unique(np.concatenate([h for h, _ in counted]), return_inverse=True)
    tf = np.concatenate([c for _, c in counted]).astype(float)
    df = np.bincount(term)
    n, df_all, mean, longest = len(parsed), df, lengths.mean(), lengths.max()
    if corpus:
        n, mean, longest = corpus.items, corpus.mean, corpus.longest
        df_all = corpus.df[np.searchsorted(corpus.terms, terms)]
    idf = np.log1p((n - df_all + 0.5) / (df_all + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (
        tf + K1 * (1 - B + B * lengths[item] / mean))
    impact /= np.bincount(item, impact)[item]
    order = np.lexsort((item, term))
    item, term, impact = item[order], term[order], impact[order]
    begin = np.concatenate([[0], np.cumsum(df)])
    block_bound = np.zeros((len(terms), (len(parsed) - 1) // BLOCK_ITEMS + 1), np.float32)
    np.maximum.at(block_bound, (term, item // BLOCK_ITEMS), impact.astype(np.float32) * 1.000001)
    question, answer, size = [], [], []
    for _, words in parsed:
        cut = len(words) - max(1, int(len(words) * ANSWER_PART)) if len(words) > 1 else 0
        # Each part reaches into the other by what a triple needs.
        n = min(3, len(words))
        size.append(n)
        question.append(grams(words, 0, max(cut, n), n))
        answer.append(grams(words, max(0, min(cut, len(words) - n)), len(words), n))
    return Index(terms, begin, item, impact, np.maximum.reduceat(impact, begin[:-1]) * 1.000001,
                 block_bound, [i for i, _ in parsed], question, answer, size,
                 int(max(32, longest)))


def spread_ranges(first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges first..after in a row, and the range that each is of."""
    size = after - first
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) + (first - np.cumsum(size) + size)[of], of


def retrieve(words: Words, index: Index, threshold: float):
    """(row, item, score) for the best passage of each row and item that reaches the threshold.

    Passages are `index.passage` words long and overlap by half; the last one of a row may be shorter.
    """
    at = np.minimum(np.searchsorted(index.terms, words.hash), len(index.terms) - 1)
    hits = np.flatnonzero(index.terms[at] == words.hash)
    if not len(hits):
        return []
    half = max(1, index.passage // 2)
    per_row = -(-words.count // half)
    offset = np.concatenate([[0], np.cumsum(per_row)])
    term, doc = at[hits], words.doc[hits]
    part = offset[doc] + (hits - words.first[doc]) // half       # half passages, row by row
    # A term counts once in a half passage; in two halves at most twice, which keeps the bound.
    key = np.unique(part * len(index.terms) + term)
    part, term = key // len(index.terms), key % len(index.terms)
    sums = np.bincount(part, index.bound[term], minlength=offset[-1] + 1)
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    follows = np.zeros(offset[-1], bool)
    follows[:-1] = row_of[1:] == row_of[:-1]
    passage = np.flatnonzero(sums[:-1] + np.where(follows, sums[1:], 0) >= threshold)
    if not len(passage):
        return []
    first = np.searchsorted(part, passage)
    after = np.searchsorted(part, np.where(follows[passage], passage + 2, passage + 1))
    entry, of = spread_ranges(first, after)
    key = np.unique(of * len(index.terms) + term[entry])        # a term counts once in a passage
    of, term = key // len(index.terms), key % len(index.terms)
    # Passages are scored in groups of bounded size.
    n_items, n_blocks = len(index.ids), index.block_bound.shape[1]
    postings = index.begin[term + 1] - index.begin[term]
    weight = np.maximum(np.bincount(of, np.maximum(postings, n_blocks), len(passage)), n_items)
    group = (np.cumsum(weight) // GROUP_ENTRIES).astype(np.int64)
    group_begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    best: dict[tuple[int, int], float] = {}
    for low, high in zip(group_begin, np.append(group_begin[1:], len(passage)), strict=True):
        x, y = np.searchsorted(of, [low, high])
        mine, at = term[x:y], of[x:y] - low
        begins = np.searchsorted(at, np.arange(high - low))
        open_blocks = np.add.reduceat(index.block_bound[mine], begins) >= threshold
        some = open_blocks.any(1)[at]
        posting, nth = spread_ranges(index.begin[mine[some]], index.begin[mine[some] + 1])
        at, item = at[some][nth], index.item[posting]
        inside = open_blocks[at, item // BLOCK_ITEMS]
        score = np.bincount(at[inside] * n_items + item[inside], index.impact[posting[inside]])
        for cell in np.flatnonzero(score >= threshold):
            pair = (int(row_of[passage[low + cell // n_items]]), int(cell % n_items))
            best[pair] = max(best.get(pair, 0.0), float(score[cell]))
    return [(row, i, s) for (row, i), s in best.items()]


def overlaps(data: np.ndarray, bounds: np.ndarray, index: Index, threshold: float):
    """(row, item, score, overlap with question, answer and whole item) of what a run of texts retrieves."""
    words = Words(data, bounds, lower=True, between=NOT_ALNUM)
    held: dict = {}
    for row, i, score in retrieve(words, index, threshold):
        n = index.size[i]
        if (row, n) not in held:
            held[row, n] = grams(words, words.first[row], words.first[row + 1], n)
        whole = held[row, n]
        parts = index.question[i], index.answer[i]
        yield (row, i, score, *[float(np.isin(part, whole).mean())
                                for part in (*parts, np.union1d(*parts))])


def _search(index: Index, threshold: float):
    def run(batches):
        for batch in batches:
            for low, after, data, bounds in runs(batch.column(1)):
                ids = batch.column(0)[low:after].to_pylist()
                out = [(ids[row], index.ids[i], *rest)
                       for row, i, *rest in overlaps(data, bounds, index, threshold)]
                types = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], t) for k, t in enumerate(types)],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"])
    return run


def _holds(index: Index, threshold: float):
    """Whether a text holds an item."""
    def run(texts: pa.Array) -> pa.Array:
        leaks = np.zeros(len(texts), bool)
        for low, _, data, bounds in runs(texts):
            for row, _, _, question, answer, whole in overlaps(data, bounds, index, threshold):
                if question >= QUESTION and answer >= ANSWER or whole >= WHOLE:
                    leaks[low + row] = True
        return pa.array(leaks)
    return F.arrow_udf(run, "boolean")


def _terms(batches):
    """Each term of a run of items, and how many of them hold it."""
    for batch in batches:
        for _, _, data, bounds in runs(batch.column(0)):
            words = Words(data, bounds, lower=True, between=NOT_ALNUM)
            once = np.unique(np.stack([words.hash, words.doc.astype(np.uint64)]), axis=1)[0]
            hashes, df = np.unique(once, return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(hashes), pa.array(df.astype(np.int64))],
                                             names=["hash", "df"])


def _lengths(batches):
    for batch in batches:
        for _, _, data, bounds in runs(batch.column(0)):
            words = Words(data, bounds, lower=True, between=NOT_ALNUM)
            yield pa.RecordBatch.from_arrays([pa.array(words.count.astype(np.int64))], names=["n"])


def corpora(items: DataFrame):
    """A function from a part of the items to its corpus: the counts of all items, for its terms."""
    n, mean, longest = items.select("text").mapInArrow(_lengths, "n bigint").where("n > 0").agg(
        F.count("*"), F.avg("n"), F.max("n")).first()
    counted = materialize(items.select("text").mapInArrow(_terms, "hash bigint, df bigint").groupBy(
        "hash").agg(F.sum("df").alias("df")), "item-terms")

    def of(part: DataFrame) -> Corpus:
        mine = part.select("text").mapInArrow(_terms, "hash bigint, df bigint").select("hash").distinct()
        table = counted.join(mine, "hash", "left_semi").toPandas()
        terms = table["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(terms)
        return Corpus(n, mean, longest, terms[order], table["df"].to_numpy(np.int64)[order])
    return of


def retrieved(docs: DataFrame, items: DataFrame, threshold: float = RETRIEVED,
              id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, overlap) of all pairs that reach the threshold.

    The index of at most about `index_items` items goes to every task; the documents are read once for
    each index and never shuffled. A null or empty text has no passages, an item without words is
    found nowhere; repeated rows are searched each. No items, or no documents: no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = items.select(F.col(item_col).cast("bigint").alias("item_id"),
                          F.col(item_text_col).alias("text"))
    schema = ("doc_id bigint, item_id bigint, score double, question_overlap double, "
              "answer_overlap double, overlap double")
    found = None
    for index in indexes(wanted, index_items):
        some = rows.mapInArrow(_search(index, threshold), schema)
        found = some if found is None else found.unionByName(some)
    return found if found is not None else rows.sparkSession.createDataFrame([], schema)


def indexes(wanted: DataFrame, index_items: int):
    """An index for each part of the items (item_id, text) that has words."""
    n = -(-wanted.count() // index_items)
    corpus = corpora(wanted) if n > 1 else None
    for k in range(n):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        index = build_index([(r["item_id"], r["text"]) for r in part.collect()],
                            corpus(part) if corpus else None)
        if index is not None:
            yield index


def is_leak() -> Column:
    return ((F.col("question_overlap") >= QUESTION) & (F.col("answer_overlap") >= ANSWER)
            | (F.col("overlap") >= WHOLE))


def contaminated(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """The retrieved pairs whose document holds both the item's question and its answer, or enough of
    the whole item."""
    return retrieved(docs, items, **columns).where(is_leak())


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = RETRIEVED, text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text",
                    index_items: int = INDEX_ITEMS) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns, whatever their ids: each is decided where
    it is read. Rows without a text stay, and all do if there are no items."""
    wanted = items.select(F.col(item_col).cast("bigint").alias("item_id"),
                          F.col(item_text_col).alias("text"))
    for index in indexes(wanted, index_items):
        docs = docs.where(~_holds(index, threshold)(F.col(text_col)))
    return docs
