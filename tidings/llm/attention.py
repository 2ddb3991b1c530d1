"""Quality scores by attention over passages (multiple-instance learning).

A document is a bag of passages. Each is encoded as a vector; gated attention, learnt from document
labels alone, weights them; the weighted vector gives the document's score.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidings.llm.training import labelled_sample
from tidings.llm.words import NOT_ALNUM, Words, mix, runs

#: Words of a passage; most labelled documents to learn from; size of the attention; rounds and step.
PASSAGE_WORDS, TRAIN_DOCUMENTS, HIDDEN, EPOCHS, STEP, BAG = 64, 12_000, 16, 30, 0.02, 128
#: Hashed word directions of a passage.
HASHED = 8

CLASSES = np.zeros(256, np.int64)
CLASSES[48:58] = 1
CLASSES[65:91] = 2
CLASSES[97:123] = 3
CLASSES[list(b" \t\r\n\v\f")] = 4
CLASSES[128:] = 5
CLASSES[ord("!")] = 6
CLASSES[list(b"#*$%&<>")] = 7
CLASSES[ord("|")] = 8
CLASSES[list(b".,;:?")] = 9
N_CLASSES = 10
ENCODED = N_CLASSES + 6 + HASHED


def encode_passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all passages of a run, and where each row's passages begin (one more than rows).

    A passage is a stretch of words and what stands between; a row without words is one passage. The
    vector has shares of character classes, word lengths, repeats within the passage and along the
    text, and hashed word directions.
    """
    words = Words(data, bounds, lower=True)
    n_rows = len(bounds) - 1
    per_row = np.maximum(-(-words.count // PASSAGE_WORDS), 1)
    begin = np.concatenate([[0], np.cumsum(per_row)])
    row = np.repeat(np.arange(n_rows), per_row)
    k = np.arange(begin[-1]) - begin[row]
    first = words.first[row] + k * PASSAGE_WORDS
    last = np.minimum(first + PASSAGE_WORDS, words.first[row + 1])
    start = np.where(k == 0, bounds[row], 0)
    later = np.flatnonzero(k > 0)
    start[later] = words.start[first[later]]
    end = np.append(start[1:], len(data))
    out = np.zeros((len(row), ENCODED), np.float32)
    size = np.maximum(end - start, 1)
    kinds = CLASSES[data]
    for c in range(N_CLASSES):
        total = np.concatenate([[0], np.cumsum(kinds == c)])
        out[:, c] = np.log1p(100 * (total[end] - total[start]) / size)
    n = np.maximum(last - first, 1)
    passage = np.searchsorted(first, np.arange(len(words)), "right") - 1 if len(words) else \
        np.empty(0, np.int64)
    own = mix(words.hash + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    again = own[order][1:] == own[order][:-1]
    repeats = np.bincount(passage[order[1:][again]], minlength=len(row)) if len(words) else 0
    beside = np.zeros(len(words))
    if len(words) > 1:
        beside[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    lengths = (words.end - words.start).astype(float)
    by_passage = lambda v: np.bincount(passage, v, minlength=len(row))
    at = N_CLASSES
    out[:, at] = repeats / n
    out[:, at + 1] = by_passage(beside) / n
    out[:, at + 2] = np.log1p(by_passage(lengths) / n)
    out[:, at + 3] = np.log1p(np.maximum(last - first, 0))
    out[:, at + 4] = np.log1p(words.count[row])
    # Words that came before in the same text, whatever the passage.
    whole = mix(words.hash + words.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(whole, kind="stable")
    seen = np.zeros(len(words))
    seen[order[1:][whole[order][1:] == whole[order][:-1]]] = 1
    out[:, at + 5] = by_passage(seen) / n
    for i in range(HASHED):
        sign = ((words.hash >> np.uint64(i)) & np.uint64(1)).astype(float) * 2 - 1
        out[:, at + 6 + i] = by_passage(sign) / np.sqrt(n)
    return out, begin


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    bias: float

    def parts(self) -> list[np.ndarray]:
        return [self.v, self.u, self.w, self.c]


def attend(model: Model, x: np.ndarray, begin: np.ndarray):
    """Attention of each passage, weighted vectors and scores; no row is without a passage."""
    h = (x - model.mean) / model.spread
    t, g = np.tanh(h @ model.v), 1 / (1 + np.exp(-np.clip(h @ model.u, -30, 30)))
    e = (t * g) @ model.w
    sizes = np.diff(begin)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin[:-1]), sizes))
    a = e / np.repeat(np.add.reduceat(e, begin[:-1]), sizes)
    z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
    hidden = np.concatenate([z, np.abs(z)], 1)
    p = 1 / (1 + np.exp(-np.clip(hidden @ model.c + model.bias, -30, 30)))
    return h, t, g, a, z, p


def train(x: np.ndarray, begin: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fit by Adam on bags of documents; the sample is bounded, so this is a fixed amount of work."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    model = Model(x.mean(0), x.std(0) + 0.05, rng.normal(0, 0.3, (d, HIDDEN)),
                  rng.normal(0, 0.3, (d, HIDDEN)), rng.normal(0, 0.3, HIDDEN), np.zeros(2 * d), 0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    model.bias = float(np.log(share / (1 - share)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in [*model.parts(), np.zeros(1)]]
    count = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        step = STEP * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for low in range(0, len(order), BAG):
            docs = order[low:low + BAG]
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in docs])
            sizes = begin[docs + 1] - begin[docs]
            own = np.concatenate([[0], np.cumsum(sizes)])
            h, t, g, a, z, p = attend(model, x[rows], own)
            err = (p - y[docs]) / len(docs)
            hidden = np.concatenate([z, np.abs(z)], 1)
            grad_c = hidden.T @ err + 1e-4 * model.c
            grad_z = err[:, None] * (model.c[:d] + model.c[d:] * np.sign(z))
            doc = np.repeat(np.arange(len(docs)), sizes)
            grad_a = (h * grad_z[doc]).sum(1)
            grad_e = a * (grad_a - np.add.reduceat(a * grad_a, own[:-1])[doc])
            inner = grad_e[:, None] * model.w
            grads = [h.T @ (inner * g * (1 - t * t)), h.T @ (inner * t * g * (1 - g)),
                     (t * g).T @ grad_e, grad_c, np.array([err.sum()])]
            count += 1
            new = []
            for (m, s), part, grad in zip(moments, [*model.parts(), np.array([model.bias])], grads,
                                          strict=True):
                m *= 0.9
                m += 0.1 * grad
                s *= 0.999
                s += 0.001 * grad * grad
                new.append(part - step * (m / (1 - 0.9 ** count))
                           / (np.sqrt(s / (1 - 0.999 ** count)) + 1e-8))
            model.v, model.u, model.w, model.c = new[:4]
            model.bias = float(new[4][0])
    return model


def _encode(batches):
    for batch in batches:
        for low, after, data, bounds in runs(batch.column(0)):
            x, begin = encode_passages(data, bounds)
            lists = pa.ListArray.from_arrays(
                pa.array((begin * ENCODED).astype(np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(1)[low:after], lists],
                                             names=["label", "passages"])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality",
        bound: int = TRAIN_DOCUMENTS) -> Model:
    """Learn from at most `bound` labelled documents. Without any, every score is one half."""
    sample = labelled_sample(docs, labels, learn, label_col, bound)
    table = sample.select("text", "label").mapInArrow(
        _encode, "label int, passages array<float>").toPandas()
    if not len(table):
        d = ENCODED
        return Model(np.zeros(d), np.ones(d), np.zeros((d, HIDDEN)), np.zeros((d, HIDDEN)),
                     np.zeros(HIDDEN), np.zeros(2 * d), 0.0)
    bags = [np.asarray(v, np.float32).reshape(-1, ENCODED) for v in table["passages"]]
    begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags), begin, table["label"].to_numpy(float))


def quality_scores(docs: DataFrame, model: Model, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, most_attention) for every row, from its whole text.

    A null text is an empty one, which has one passage without words. The model is of fixed size;
    nothing is shuffled. Repeated rows are scored each; no rows, no scores.
    """
    def run(batches):
        for batch in batches:
            for low, after, data, bounds in runs(batch.column(0)):
                x, begin = encode_passages(data, bounds)
                _, _, _, a, _, p = attend(model, x, begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[low:after], pa.array(p), pa.array(np.diff(begin)),
                     pa.array(np.maximum.reduceat(a, begin[:-1]))],
                    names=["doc_id", "score", "n_passages", "most_attention"])

    return docs.select(F.col(text_col).alias("text"),
                       F.col(id_col).cast("bigint").alias("doc_id")).mapInArrow(
        run, "doc_id bigint, score double, n_passages bigint, most_attention double")
