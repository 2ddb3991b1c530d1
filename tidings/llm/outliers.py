"""Quality rules: fixed bounds, and robust multivariate outliers of each language and source.

A document's statistics, transformed, are a vector. For each group the minimum-covariance-determinant
estimate (mean and covariance of the half that lies closest together) is found by concentration steps;
a document far from it in Mahalanobis distance is an outlier.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidings.llm.words import IS_SPACE, SAME, Words, mix, powers, runs, windows
from tidings.shared import materialize

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
ENDING = np.zeros(256, bool)
ENDING[list(b".,!?;:")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_ending"]
#: The vector, each with the least standard deviation that a group is taken to have, so that a
#: statistic which is nearly constant in a group doesn't make every deviation from it an outlier.
FEATURES = {"log_words": 1.5, "log_word_chars": 0.06, "symbols": 0.5, "repeats": 0.1, "upper": 0.5,
            "ending": 0.4}
#: Share of a group that the estimate rests on, concentration steps, and rows below which a group is
#: judged with its language, then with all.
SHARE, STEPS, LEAST_ROWS = 0.75, 5, 60
#: Squared distance beyond which a document is an outlier; the median of a group is scaled to that of
#: the chi-square distribution with as many degrees as the vector has parts.
CUT = 90.0


def per_row(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def duplicate_lines(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same row."""
    n = len(bounds) - 1
    line_ends = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([bounds[:-1], line_ends + 1]))
    start = start[start < len(data)]
    if not len(start):
        return np.zeros(n, np.int64)
    doc = np.searchsorted(bounds, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), bounds[doc + 1])
    end = end - ((end > start) & (data[end - 1] == 0x0A))
    visible = np.concatenate([[0], np.cumsum(~IS_SPACE[data], dtype=np.int64)])
    full = np.flatnonzero(visible[end] > visible[start])
    start, end, doc = start[full], end[full], doc[full]
    up, down = powers(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(SAME[data] * up[:-1], dtype=np.uint64)])
    line = mix((total[end] - total[start]) * down[start])
    order = np.lexsort((line, doc))
    again = np.zeros(len(order), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][again], minlength=n)


def repeated_words(words: Words, n: int) -> np.ndarray:
    """Words in three-word windows that the row has at least twice."""
    hashed, begin, _ = windows(words, 3)
    if not len(hashed):
        return np.zeros(n, np.int64)
    own = mix(hashed + words.doc[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = begin[twice]
    steps = np.zeros(len(words) + 4, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + 3, -1)
    covered = np.cumsum(steps)[:len(words)] > 0
    return np.bincount(words.doc[covered], minlength=n)


def counts_of(column: pa.Array):
    """(first row, row after the last, COUNTS) of runs of texts."""
    for low, after, data, bounds in runs(column):
        words = Words(data, bounds, lower=False)
        begins = (data & 0xC0) != 0x80
        yield low, after, [np.asarray(c, np.int64) for c in (
            words.count, per_row(~IS_SPACE[data] & begins, bounds), per_row(SYMBOLS[data], bounds),
            duplicate_lines(data, bounds), repeated_words(words, after - low),
            per_row(UPPER[data], bounds), per_row(ENDING[data], bounds))]


COUNTED = pa.struct([(c, pa.int64()) for c in COUNTS])


def _counted(texts: pa.Array) -> pa.Array:
    parts = [counts for _, _, counts in counts_of(texts)]
    columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)] if parts else [
        pa.array([], pa.int64())] * len(COUNTS)
    return pa.StructArray.from_arrays(columns, fields=list(COUNTED))


def with_statistics(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Add the COUNTS of a text as the struct `name`. Only the text goes to Python, and only numbers come
    back."""
    count = F.arrow_udf(_counted, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
    return rows.withColumn(name, count(text))


def text_statistics(docs: DataFrame, text_col: str, lang_col: str, source_col: str,
                    **carried: Column) -> DataFrame:
    """The `carried` columns, lang, source and COUNTS of every row."""
    rows = docs.select(*[c.alias(name) for name, c in carried.items()],
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       F.col(text_col).alias("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return with_statistics(rows, F.col("text"), "counts").select(
        *carried, "lang", "source", "counts.*").withColumn("base_failed", failed)


def vector() -> dict:
    """The transformed statistics as columns."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "log_words": F.log(n), "log_word_chars": F.log(chars / n),
        "symbols": F.log1p(1000 * F.col("n_symbols") / chars) / 2,
        "repeats": F.col("n_repeat_words") / n,
        "upper": F.log1p(200 * F.col("n_upper") / chars),
        "ending": F.log1p(200 * F.col("n_ending") / chars)}


PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
CENTRES = ", ".join(f"c{i} double" for i in range(len(FEATURES)))
INVERSE = ", ".join(f"w{i}_{j} double" for i, j in PAIRS)


def moments() -> list:
    """Sums that combine before the shuffle, of values of moderate size."""
    names = list(FEATURES)
    return [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)],
            *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in PAIRS]]


def _estimate(frames):
    """Mean and inverse covariance from a group's sums; a row is a group."""
    d, floor = len(FEATURES), np.array(list(FEATURES.values())) ** 2
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            mean = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
            cov = np.zeros((d, d))
            for i, j in PAIRS:
                cov[i, j] = cov[j, i] = row[f"q{i}_{j}"] / row["n"] - mean[i] * mean[j]
            cov += np.diag(np.maximum(floor - np.diag(cov), 0) + 1e-3 * floor)
            inverse = np.linalg.inv(cov)
            out.append([row["grp"], *mean, *[inverse[i, j] for i, j in PAIRS]])
        yield pd.DataFrame(out, columns=["grp", *[f"c{i}" for i in range(d)],
                                         *[f"w{i}_{j}" for i, j in PAIRS]])


def distance():
    """Squared Mahalanobis distance of a row joined with its group's estimate."""
    names = list(FEATURES)
    return sum((F.col(f"w{i}_{j}") * (1 if i == j else 2) * (F.col(names[i]) - F.col(f"c{i}"))
                * (F.col(names[j]) - F.col(f"c{j}")) for i, j in PAIRS), F.lit(0.0))


def estimate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(*moments()).mapInPandas(
        _estimate, f"grp string, {CENTRES}, {INVERSE}")


def robust_estimates(rows: DataFrame, steps: int = STEPS, share: float = SHARE) -> DataFrame:
    """(grp, c0.., w0_0..) of each group: the minimum-covariance-determinant estimate.

    The start is the rows whose parts all lie near the medians; each step keeps the `share` nearest
    and estimates anew, which never raises the determinant. A step is two aggregations that combine
    before the shuffle; groups of any size are fine.
    """
    names = list(FEATURES)
    # One row a group. Written tables are of known size: Spark broadcasts them where that is small, so that
    # the rows of a large group stay where they are.
    middle = materialize(rows.groupBy("grp").agg(*[
        F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(f"m{i}") for i, c in enumerate(names)]),
        "middle")
    away = F.greatest(*[
        F.abs(F.col(c) - F.col(f"m{i}")[1]) / F.greatest(F.col(f"m{i}")[2] - F.col(f"m{i}")[0],
                                                        F.lit(FEATURES[c]))
        for i, c in enumerate(names)])
    measured = rows.join(middle, "grp").select("grp", *names, away.alias("d2"))
    found = None
    for step in range(steps + 1):
        if found is not None:
            measured = rows.join(found, "grp").select("grp", *names, distance().alias("d2"))
        bound = materialize(measured.groupBy("grp").agg(
            F.percentile_approx("d2", share, 2000).alias("bound")), f"bound-{step}")
        near = measured.join(bound, "grp").where("d2 <= bound")
        found = materialize(estimate(near), f"estimate-{step}")
    return found


def quality_limits(stats: DataFrame) -> DataFrame:
    """(lang, source, c0.., w0_0.., middle): by what the rows of a language and source are judged.

    `stats` are the statistics of all rows; those that pass the base rules form the estimates. Groups of few
    rows are judged with their language, and small languages with all.
    """
    judged = stats.where("not base_failed")
    in_group = judged.groupBy("lang", "source").agg(F.count("*").alias("n_group"))
    in_lang = judged.groupBy("lang").agg(F.count("*").alias("n_lang"))
    group = (F.when(F.col("n_group") >= LEAST_ROWS, F.concat_ws("\u0001", "lang", "source"))
             .when(F.col("n_lang") >= LEAST_ROWS, F.col("lang")).otherwise(F.lit("\u0001\u0001")))
    groups = materialize(in_group.join(in_lang, "lang").select("lang", "source", group.alias("grp")),
                         "groups")
    rows = materialize(judged.join(groups, ["lang", "source"]).withColumns(vector())
                       .select("grp", *FEATURES), "vectors")
    found = robust_estimates(rows)
    measured = rows.join(found, "grp").select("grp", distance().alias("d2"))
    middle = measured.groupBy("grp").agg(F.percentile_approx("d2", 0.5, 2000).alias("middle"))
    return materialize(groups.join(found, "grp").join(middle, "grp").drop("grp"), "limits")


def with_verdicts(stats: DataFrame, limits: DataFrame, cut: float) -> DataFrame:
    """Add `distance` (null where the base rules fail) and `kept`."""
    typical = len(FEATURES) - 0.66
    scaled = distance() * typical / F.greatest("middle", F.lit(typical / 4))
    joined = stats.withColumns(vector()).join(limits, ["lang", "source"], "left")
    return joined.withColumn("distance", F.when(~F.col("base_failed"), scaled)).withColumn(
        "kept", F.coalesce(F.col("distance") <= cut, F.lit(False)))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     lang_col: str = "lang", source_col: str = "source",
                     cut: float = CUT) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance,
    kept) for every row.

    Rows fail the base rules with fewer than 50 words, or if over half of the words stand in
    three-word windows that come again. The others are judged by the squared distance from the
    estimate of their (language, source). A null or empty text has no words and fails. A null language or
    source counts as an empty one. Repeated rows are judged each. No rows, no verdicts; other columns are
    ignored.
    """
    stats = materialize(text_statistics(
        docs, text_col, lang_col, source_col, doc_id=F.col(id_col).cast("bigint")), "statistics")
    return with_verdicts(stats, quality_limits(stats), cut).select(
        "doc_id", *COUNTS[:5], "base_failed", "distance", "kept")


def kept_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source", cut: float = CUT) -> DataFrame:
    """The rows of `docs` that pass, with all their columns, whatever their ids.

    The limits are per language and source, so a row is judged where it is read, by statistics computed once
    more: no text is shuffled or written.
    """
    limits = quality_limits(materialize(text_statistics(docs, text_col, lang_col, source_col), "statistics"))
    rows = text_statistics(docs, text_col, lang_col, source_col, row=F.struct(*docs.columns))
    return with_verdicts(rows, limits, cut).where("kept").select("row.*")
