"""Toxic passages: maximal-scoring segments of a text under log-odds of its words.

Words and word beginnings are scored by the log-odds of toxic against other labelled documents, shrunk
by a Dirichlet prior, and a word has the best score among its beginnings; the linear-time scan finds every maximal segment; the extreme-value law of segment scores in
clean text says how surprising each one is; a logistic calibration turns that into a probability.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidings.llm.training import labelled_sample
from tidings.llm.words import NOT_ALNUM, Words, mix, runs

#: Most labelled documents to learn from.
TRAIN_DOCUMENTS = 30_000
#: Prior weight in documents; the log-odds and their deviation (in standard errors) that make a word
#: toxic; the scored words kept, by deviation; the score of any other word.
PRIOR_DOCUMENTS, ODDS, DEVIATION, SCORED_WORDS, OTHER = 30.0, 3.0, 3.0, 20_000, -0.25
#: Bytes of the beginnings; the last one takes in nearly every word whole.
BEGINNINGS = [3, 4, 5, 6, 7, 9, 40]
#: A segment is significant if clean text has one as good with at most this chance.
SIGNIFICANT = 0.05


@dataclass
class Model:
    """Scores of words by hash, the extreme-value law and the calibration."""

    hashes: np.ndarray
    scores: np.ndarray
    rate: float          # lambda
    scale: float         # K
    weights: np.ndarray


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, after the last, score) of a list, in linear time.

    Candidates are kept with the totals before and after them, and each with the nearest earlier one that begins
    lower, so that none is looked at twice. A new positive score joins with the candidates
    back to the nearest one that begins lower, if it ends higher than that one ended.
    """
    found: list[tuple[int, int, float, float, int]] = []     # first, after, totals before and after, lower one
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low, k = i, before, len(found) - 1
        while k >= 0 and found[k][2] >= low:
            k = found[k][4]
        while k >= 0 and found[k][3] < total:
            first, low, lower = found[k][0], found[k][2], found[k][4]
            del found[k:]
            k = lower
        found.append((first, i + 1, low, total, k))
    return [(a, b, after - before) for a, b, before, after, _ in found]


def unit_hashes(words: Words, size: int) -> np.ndarray:
    """A beginning counts apart from the same letters as a beginning of another size."""
    return words.beginnings(size) ^ np.uint64(size)


def segments_of(words: Words, model_hashes: np.ndarray, model_scores: np.ndarray):
    """(row, first word, after the last, score) of each segment of each row.

    Only scored words are visited; what stands between two of them is one negative sum.
    """
    if not len(model_hashes) or not len(words):
        return
    best = np.full(len(words), -np.inf)
    for unit in BEGINNINGS:
        h = unit_hashes(words, unit)
        at = np.minimum(np.searchsorted(model_hashes, h), len(model_hashes) - 1)
        found = np.flatnonzero(model_hashes[at] == h)
        best[found] = np.maximum(best[found], model_scores[at[found]])
    hits = np.flatnonzero(best > -np.inf)
    if not len(hits):
        return
    values, docs = best[hits], words.doc[hits]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    for a, b in zip(starts, np.append(starts[1:], len(hits)), strict=True):
        place = hits[a:b] - words.first[docs[a]]
        steps, where = [], []
        for k in range(b - a):
            gap = int(place[k] - (place[k - 1] + 1 if k else place[k]))
            if gap:
                steps.append(OTHER * gap)
                where.append(int(place[k]) - gap)
            steps.append(float(values[a + k]))
            where.append(int(place[k]))
        for first, after, score in maximal_segments(steps):
            yield int(docs[a]), where[first], where[after - 1] + 1, score


def _count(batches):
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for low, _, data, bounds in runs(batch.column(0)):
            words = Words(data, bounds, lower=True, between=NOT_ALNUM)
            for unit in BEGINNINGS:
                h = unit_hashes(words, unit)
                # Once for each document, so that what one text repeats doesn't weigh more.
                own = mix(h + words.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, once = np.unique(own, return_index=True)
                labels = toxic[low:][words.doc[once]]
                hashes, which = np.unique(h[once], return_inverse=True)
                n1 = np.bincount(which, labels, minlength=len(hashes)).astype(np.int64)
                n0 = np.bincount(which, 1 - labels, minlength=len(hashes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(n1), pa.array(n0)],
                    names=["hash", "toxic", "clean"])


def word_scores(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes and scores of words that deviate, and about what share of clean text they are: their
    documents, over the documents of a hundred words each."""
    counts = sample.select("text", "label").mapInArrow(
        _count, "hash bigint, toxic bigint, clean bigint").groupBy("hash").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = {r["label"]: float(r["count"]) for r in sample.groupBy("label").count().collect()}
    n1, n0 = n.get(1, 0.0), n.get(0, 0.0)
    if not n1 or not n0:
        return np.empty(0, np.uint64), np.empty(0), 0.0
    prior = PRIOR_DOCUMENTS * (F.col("toxic") + F.col("clean")) / (n1 + n0)
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(y1 / (n1 + PRIOR_DOCUMENTS - y1)) - F.log(y0 / (n0 + PRIOR_DOCUMENTS - y0))
    table = (counts.where((y1 < n1 + PRIOR_DOCUMENTS) & (y0 < n0 + PRIOR_DOCUMENTS))
             .select("hash", "clean", odds.alias("odds"),
                     (odds / F.sqrt(1 / y1 + 1 / y0)).alias("deviation"))
             .where((F.col("odds") > ODDS) & (F.col("deviation") > DEVIATION))
             .orderBy(F.desc("deviation"), "hash").limit(SCORED_WORDS).toPandas())
    hashes = table["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], table["odds"].to_numpy(float)[order], min(float(table["clean"].sum()) / n0 / 100, 0.5)


def _measure(hashes: np.ndarray, scores: np.ndarray, keep: list[str]):
    """The kept columns, the number of words, the best segment's score and the sum of all."""
    def run(batches):
        for batch in batches:
            for low, after, data, bounds in runs(batch.column(0)):
                words = Words(data, bounds, lower=True, between=NOT_ALNUM)
                best, total = np.zeros(after - low), np.zeros(after - low)
                for row, _, _, score in segments_of(words, hashes, scores):
                    best[row] = max(best[row], score)
                    total[row] += score
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(1 + i)[low:after] for i in range(len(keep))],
                     pa.array(words.count.astype(np.int64)), pa.array(best), pa.array(total)],
                    names=[*keep, "n_words", "best", "total"])
    return run


def features(model: Model, n_words, best, total) -> np.ndarray:
    """Of each document: 1, the best segment's surprise in clean text, and all segments' mass."""
    surprise = np.maximum(model.rate * best - np.log(model.scale * np.maximum(n_words, 1)), -5.0)
    return np.stack([np.ones_like(best), np.minimum(surprise, 60.0) / 4, np.log1p(total),
                     np.log1p(total / np.maximum(n_words, 1) * 100)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic",
        bound: int = TRAIN_DOCUMENTS) -> Model:
    """Learn from at most `bound` labelled documents. With one label only, every score is its share."""
    sample = labelled_sample(docs, labels, learn, label_col, bound)
    # Words are scored on one part and calibrated on the other, whose words they haven't seen.
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10))
    hashes, scores, share = word_scores(sample.where(part < 7))
    measured = sample.where(part >= 7).select("text", "label").mapInArrow(
        _measure(hashes, scores, ["label"]),
        "label int, n_words bigint, best double, total double").toPandas()
    y = measured["label"].to_numpy(float)
    n, best, total = (measured[c].to_numpy(float) for c in ("n_words", "best", "total"))
    if not len(hashes):
        p = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-6), 1 - 1e-6)
        return Model(hashes, scores, 1.0, 1.0, np.array([math.log(p / (1 - p)), 0, 0, 0]))
    # The rate at which a clean word's exponential score is 1 on average.
    rate, mean = 1.0, float(scores.mean())
    low, high = 1e-3, 50.0
    for _ in range(100):
        rate = (low + high) / 2
        value = share * math.exp(min(rate * mean, 600)) + (1 - share) * math.exp(rate * OTHER)
        low, high = (rate, high) if value < 1 else (low, rate)
    # The scale at which as many clean documents as the law says have a segment at all this good.
    clean = y == 0
    tail = np.log(np.maximum(n[clean], 1)) - rate * best[clean]
    scale = math.exp(-float(np.quantile(tail, 0.02))) * 0.02 if clean.any() else 1.0
    model = Model(hashes, scores, rate, max(scale, 1e-12), np.zeros(4))
    model.weights = logistic(features(model, n, best, total), y)
    return model


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from its whole text; a null text is an empty one.

    The model is of fixed size and goes to every task; nothing is shuffled.
    """
    def run(batches):
        measure = _measure(model.hashes, model.scores, ["doc_id"])
        for batch in measure(batches):
            n, best, total = (batch.column(i).to_numpy().astype(float) for i in (1, 2, 3))
            z = features(model, n, best, total) @ model.weights
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                names=["doc_id", "score"])

    return docs.select(F.col(text_col).alias("text"),
                       F.col(id_col).cast("bigint").alias("doc_id")).mapInArrow(
        run, "doc_id bigint, score double")


def toxic_segments(docs: DataFrame, model: Model, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, after_word, score, p_value) of each significant segment.

    `p_value` is the chance of one as good in a clean text of this length.
    """
    def run(batches):
        for batch in batches:
            for low, after, data, bounds in runs(batch.column(0)):
                words = Words(data, bounds, lower=True, between=NOT_ALNUM)
                ids = batch.column(1)[low:after].to_pylist()
                out = []
                for row, first, last, score in segments_of(words, model.hashes, model.scores):
                    expect = model.scale * float(words.count[row]) * math.exp(-model.rate * score)
                    p = -math.expm1(-expect)
                    if p <= SIGNIFICANT:
                        out.append((ids[row], first, last, score, p))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], kind) for i, kind in enumerate(types)],
                    names=["doc_id", "first_word", "after_word", "score", "p_value"])

    return docs.select(F.col(text_col).alias("text"),
                       F.col(id_col).cast("bigint").alias("doc_id")).mapInArrow(
        run, "doc_id bigint, first_word bigint, after_word bigint, score double, p_value double")
