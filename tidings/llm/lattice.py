"""Language-model scores of whole texts: a lattice of subword pieces for each word.

The pieces and their order come from an existing vocabulary; its scores are ranks, which give the
prior of the piece probabilities. Their expected counts over the training words (all segmentations,
weighted) sharpen them. A word's probability is the sum over all its segmentations, by the forward
recursion in log space; a word of the training texts has one more arc, from its begin to its end, with
its relative frequency. The arc has the weight N / (N + T) for N tokens of T different words, pieces
the rest. As no piece crosses a space, a text's probability is the product over its words and an end.
"""

import math

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidings.llm.words import Words, buffers, runs
from tidings.shared import materialize

#: Weight of the prior against the training text, in pieces.
PRIOR_PIECES = 1000.0
#: Rounds of expected counts.
ROUNDS = 2
#: Words whose scores every task holds; all others are joined.
HEAD_WORDS = 100_000
#: Words of one length that are taken through the lattice together.
CHUNK = 20_000
SPACE = 0x20            # stands for the mark of a word's begin, as no word contains it
STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary as a sorted table of hashed piece beginnings.

    `hashes[i]` is a beginning of some piece; `piece[i]` numbers the piece that ends there, or is -1.
    Every single byte is a piece, so every text has a segmentation.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ranked: dict[bytes, float] = {bytes([b]): -math.inf for b in range(256)}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i):
                continue
            name = model.id_to_piece(i)
            text = bytes([int(name[3:5], 16)]) if model.is_byte(i) else \
                name.replace("▁", " ").encode()
            if b" " not in text[1:]:
                score = model.get_score(i)
                ranked[text] = max(score if not model.is_byte(i) else -math.inf,
                                   ranked.get(text, -math.inf))
        self.texts = sorted(ranked, key=lambda t: (-ranked[t], t))
        self.longest = max(map(len, self.texts))
        # Zipf's law over the ranks that the scores give.
        zipf = 1.0 / (np.arange(len(self.texts)) + 3.0)
        self.prior = zipf / zipf.sum()
        table: dict[int, int] = {}
        for number, text in enumerate(self.texts):
            h = 0
            for b in text:
                h = (h * int(STEP) + b + 1) & 0xFFFFFFFFFFFFFFFF
                table.setdefault(h, -1)
            table[h] = number
        self.hashes = np.array(sorted(table), np.uint64)
        self.piece = np.array([table[int(h)] for h in self.hashes], np.int64)


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def arcs(letters: np.ndarray, pieces: Pieces):
    """All pieces that begin at each place of equally long words: (begin, length, rows, numbers)."""
    n, length = letters.shape
    for begin in range(length):
        rows, h = np.arange(n), np.zeros(n, np.uint64)
        for size in range(1, min(pieces.longest, length - begin) + 1):
            h = h * STEP + (letters[rows, begin + size - 1] + np.uint64(1))
            at = np.minimum(np.searchsorted(pieces.hashes, h), len(pieces.hashes) - 1)
            alive = np.flatnonzero(pieces.hashes[at] == h)
            if not len(alive):
                break
            rows, h = rows[alive], h[alive]
            number = pieces.piece[at[alive]]
            ends = np.flatnonzero(number >= 0)
            if len(ends):
                yield begin, size, rows[ends], number[ends]


def forward(letters: np.ndarray, pieces: Pieces, log_p: np.ndarray, keep: bool = False):
    """Log of the summed probability of all segmentations up to each place, and the arcs if asked."""
    alpha = np.full((len(letters), letters.shape[1] + 1), -np.inf)
    alpha[:, 0] = 0.0
    kept = []
    for begin, size, rows, number in arcs(letters, pieces):
        alpha[rows, begin + size] = np.logaddexp(
            alpha[rows, begin + size], alpha[rows, begin] + log_p[number])
        if keep:
            kept.append((begin, size, rows, number))
    return alpha, kept


def expected(letters: np.ndarray, counts: np.ndarray, pieces: Pieces, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is used in these words, over all segmentations by their weight."""
    alpha, kept = forward(letters, pieces, log_p, keep=True)
    length = letters.shape[1]
    beta = np.full_like(alpha, -np.inf)
    beta[:, length] = 0.0
    total = np.zeros(len(log_p))
    for begin, size, rows, number in reversed(kept):
        onward = log_p[number] + beta[rows, begin + size]
        beta[rows, begin] = np.logaddexp(beta[rows, begin], onward)
        share = np.exp(alpha[rows, begin] + onward - alpha[rows, length])
        total += np.bincount(number, share * counts[rows], minlength=len(log_p))
    return total


def by_length(column: pa.Array):
    """(rows, letters) of the words of a binary column: chunks of equally long words with their mark."""
    data, bounds = buffers(column.cast(pa.string()) if pa.types.is_string(column.type)
                           else column.view(pa.string()))
    sizes = np.diff(bounds)
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        step = max(1, CHUNK * 10 // int(size + 1))
        for low in range(0, len(same), step):
            rows = same[low:low + step]
            letters = np.full((len(rows), size + 1), SPACE, np.uint64)
            letters[:, 1:] = data[bounds[rows][:, None] + np.arange(size)]
            yield rows, letters


def _count_words(batches):
    for batch in batches:
        trained = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for low, _, data, bounds in runs(batch.column(1)):
            words = Words(data, bounds, lower=True)
            for train in (True, False):
                mine = np.flatnonzero(trained[low:][words.doc] == train)
                hashes, first, count = np.unique(
                    words.hash[mine], return_index=True, return_counts=True)
                begin, end = words.start[mine[first]], words.end[mine[first]]
                text = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([text[a:b].lower() for a, b in zip(begin, end, strict=True)],
                              pa.binary()),
                     pa.array(hashes.view(np.int64)),
                     pa.array(count * int(train)), pa.array(count)],
                    names=["word", "hash", "trained", "total"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, hash, trained, total) over (trained, text): how often each lower-cased word occurs."""
    return (docs.select("trained", "text").mapInArrow(
        _count_words, "word binary, hash bigint, trained bigint, total bigint")
        .groupBy("word", "hash").agg(F.sum("trained").alias("trained"),
                                     F.sum("total").alias("total")))


def _expect(path: str, log_p: np.ndarray):
    def run(batches):
        pieces = pieces_of(path)
        total = np.zeros(len(log_p))
        for batch in batches:
            counts = batch.column(1).to_numpy().astype(float)
            for rows, letters in by_length(batch.column(0)):
                total += expected(letters, counts[rows], pieces, log_p)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])],
                                         names=["piece", "uses"])
    return run


def fit(words: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Natural-log probabilities of the pieces and of the end, from the training counts of words.

    What comes to the driver is one number per piece of the vocabulary.
    """
    pieces = pieces_of(path)
    p, p_end = pieces.prior, 0.5
    known = words.where("trained > 0").select("word", "trained")
    for _ in range(rounds):
        uses = np.zeros(len(p))
        for row in known.mapInArrow(_expect(path, np.log(p)), "piece bigint, uses double").groupBy(
                "piece").agg(F.sum("uses").alias("uses")).collect():
            uses[row["piece"]] = row["uses"]
        uses += PRIOR_PIECES * pieces.prior
        total = uses.sum() + ends + 1.0
        p, p_end = uses / total, (ends + 1.0) / total
    return np.log(p), math.log(p_end)


def _word_scores(path: str, log_p: np.ndarray, share: float, total: int):
    def run(batches):
        pieces = pieces_of(path)
        for batch in batches:
            out = np.zeros(len(batch))
            for rows, letters in by_length(batch.column(0)):
                out[rows] = forward(letters, pieces, log_p)[0][:, -1]
            arc = share * batch.column(2).to_numpy() / max(total, 1)
            with np.errstate(divide="ignore"):
                out = np.logaddexp(out + math.log1p(-share), np.log(arc)) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), batch.column(3), pa.array(out)],
                names=["hash", "trained", "total", "lattice"])
    return run


def _score(head: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Sums over the words that every task knows; the other words' hashes in a list."""
    hashes, known, values = head

    def run(batches):
        for batch in batches:
            for low, after, data, bounds in runs(batch.column(2)):
                words = Words(data, bounds, lower=True)
                n = after - low
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
                    found = hashes[at] == words.hash
                else:
                    at, found = np.zeros(len(words), int), np.zeros(len(words), bool)
                sums = [np.bincount(words.doc, np.where(found, v[at] if len(v) else 0.0, 0.0), minlength=n)
                        for v in (known, values[0], values[1])] if len(words) else [np.zeros(n)] * 3
                rest = np.flatnonzero(~found)
                bounds_of = np.concatenate([[0], np.cumsum(
                    np.bincount(words.doc[rest], minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:after], batch.column(1)[low:after],
                     pa.array(words.count.astype(np.int64)), pa.array(sums[0].astype(np.int64)),
                     pa.array(sums[1]), pa.array(sums[2]),
                     pa.ListArray.from_arrays(
                         pa.array(bounds_of), pa.array(words.hash[rest].view(np.int64)))],
                    names=["doc_id", "held_out", "n_words", "known", "base", "lattice", "rest"])
    return run


def frequent_from(words: DataFrame, most: int) -> int:
    """The least count that at most `most` words reach. From a histogram of counts: one row per count that occurs,
    one row to the driver."""
    counts = words.groupBy("total").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, 0))
    least = counts.withColumn("upto", upto).where(F.col("upto") <= most).agg(F.min("total")).first()[0]
    return (1 << 62) if least is None else least


def lattice_scores(docs: DataFrame, held_out: Column, path: str, id_col: str = "doc_id",
                   text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    `held_out` is a condition over `docs`; rows where it is true (or null) are scored but not learnt
    from. Tokens are the lower-cased words and an end; `base_score` is the add-one estimate over
    tokens, `score` the lattice's, both base-10 logs. A null or empty text is an end alone. With no
    training rows nothing is known and the pieces keep their prior. Rows that repeat are scored each.

    Word counts are combined before they are shuffled. The most frequent words, `head_words` of them at most,
    go to every task; all rarer words meet their scores in a join, so that no word is left
    out and none of the joined ones is frequent.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(held_out, F.lit(True)).alias("held_out"),
                       F.col(text_col).alias("text"))
    words = materialize(word_counts(rows.select((~F.col("held_out")).alias("trained"), "text")),
                        "word-counts")
    ends = rows.where(~F.col("held_out")).count()
    sums = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"),
                     F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    total, distinct = sums["n"] + ends, sums["v"] + (1 if ends else 0)
    log_p, log_end = fit(words, ends, path)
    share = total / (total + distinct) if total else 0.0

    base = F.log10((F.col("trained") + 1.0) / F.lit(float(total + distinct + 1)))
    scored = materialize(
        words.select("word", "hash", "trained", "total").mapInArrow(
            _word_scores(path, log_p, share, total), "hash bigint, trained bigint, total bigint, lattice double")
        .select("hash", "total", (F.col("trained") > 0).cast("bigint").alias("known"),
                base.alias("base"), "lattice"), "word-scores")
    table = (scored.where(F.col("total") >= frequent_from(scored, head_words))
             .select("hash", "known", "base", "lattice").toPandas())        # `head_words` rows at most
    hashes = table["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    head = (hashes[order], table["known"].to_numpy(float)[order],
            [table[c].to_numpy(float)[order] for c in ("base", "lattice")])

    parts = materialize(
        rows.mapInArrow(_score(head), "doc_id bigint, held_out boolean, n_words bigint, "
                        "known bigint, base double, lattice double, rest array<bigint>")
        .withColumn("row", F.monotonically_increasing_id()), "scored-parts")
    rare = (parts.select("row", F.explode("rest").alias("hash"))
            .join(scored.select("hash", F.col("known").alias("k"), F.col("base").alias("b"),
                                F.col("lattice").alias("l")), "hash")
            .groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("l").alias("l")))
    end_arc = share * ends / total if total else 0.0
    end_score = math.log10(end_arc + (1 - share) * math.exp(log_end))
    end_base = math.log10((ends + 1.0) / (total + distinct + 1))
    zero = F.lit(0.0)
    return (parts.drop("rest").join(rare, "row", "left").select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero) + end_base).alias("base_score"),
        (F.col("lattice") + F.coalesce("l", zero) + end_score).alias("score")))
