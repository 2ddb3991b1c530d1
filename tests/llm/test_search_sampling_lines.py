"""Lexical search, importance resampling and line bitmaps against plain brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from test_llm import LOWER, ODD, SCHEMA, empty, frame, sample_texts
from tidings.llm import bitsliced, line_dedup, resampling
from tidings.shared import new_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms_of(text):
    return [x.translate(LOWER) for x in TERM.findall(text or "")]


# --- ranked search --------------------------------------------------------------------------------

def scores(docs, items):
    """Score of every (item position, document position) above 0, by the formula."""
    held = [Counter(terms_of(t)) for t in docs]
    n_docs, total = sum(map(bool, held)), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = {}
    for i, item in enumerate(items):
        for d, counts in enumerate(held):
            part = 50 + (50 * sum(counts.values()) * n_docs) // total if total else 0
            score = sum(weight[t] * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * part))
                        for t in set(terms_of(item)) if t in counts)
            if score > 0:
                out[i, d] = score
    return out


def ranking(docs, ids, items, k):
    found, out = scores(docs, items), {}
    for i in range(len(items)):
        mine = [(-s, ids[d] is None, ids[d] or 0, ids[d]) for (j, d), s in found.items() if j == i]
        out[i] = [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(mine)[:k])]
    return out


def blocks_of(docs, ids):
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(docs, pa.string())],
                                       names=["id", "text"])
    return list(bitsliced._index([batch]))


def query_of(docs, items):
    """The query as `Query` makes it, without a session."""
    counts = [set(terms_of(t)) for t in docs]
    query = bitsliced.Query.__new__(bitsliced.Query)
    query.n = sum(map(bool, counts))
    query.total = sum(len(terms_of(t)) for t in docs)
    df = Counter(t for c in counts for t in c)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(items))), pa.array(items, pa.string())], names=["item_id", "text"])
    hashed = [np.array(x, np.int64).view(np.uint64)
              for b in bitsliced._item_terms([batch]) for x in b.column(1).to_pylist()]
    by_hash = {}
    for item in items:      # hash of each term, by indexing it alone
        for term in set(terms_of(item)):
            b = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([term])], names=["item_id", "text"])
            [one] = next(bitsliced._item_terms([b])).column(1).to_pylist()
            by_hash[np.uint64(np.array(one, np.int64).view(np.uint64)[0])] = df[term]
    query.terms = np.array(sorted(h for h, n in by_hash.items() if n), np.uint64)
    query.weights = np.array([bitsliced.term_weight(query.n, by_hash[h]) for h in query.terms], np.int64)
    query.items = [np.searchsorted(query.terms, [h for h in x if by_hash[h]]) for x in hashed]
    return query


def test_bounds_are_never_below_scores_and_leave_the_best(monkeypatch):
    monkeypatch.setattr(bitsliced, "BLOCK_ENTRIES", 2000)
    rng = random.Random(5)
    docs = [t for t in ODD if t is None or len(t) < 1000] + sample_texts(6, 150) + ["the the the w1 " * 40]
    docs += [docs[-3]] * 70                    # a group of copies
    rng.shuffle(docs)
    ids = list(range(len(docs)))
    items = [docs[3] or "one", "w1 w2 w3", "the", "nothing of this kind", " ".join(f"w{i}" for i in range(80)),
             "w5 w5 w5 W5"]
    want, query, blocks = scores(docs, items), query_of(docs, items), blocks_of(docs, ids)
    assert len(blocks) > 5 and sum(b.column(1)[0].as_py() for b in blocks) == query.n
    excluded = 0
    for b in blocks:
        at = {name: b.column(i)[0] for i, name in enumerate(b.schema.names)}
        block = bitsliced._Documents(
            np.array(at["ids"].as_py()), np.zeros(len(at["ids"]), bool), at["lengths"].values.to_numpy(),
            at["bits"].as_buffer(), at["slices"].as_py(), at["most"].as_py(), at["bounds"].values.to_numpy(),
            at["terms"].values.to_numpy().view(np.uint64), at["counts"].values.to_numpy(), query)
        upper = block.bounds_of_scores(query)
        for i in range(len(items)):
            got = block.exact(np.arange(block.n), query.terms[query.items[i]], query.weights[query.items[i]])
            assert got.tolist() == [want.get((i, d), 0) for d in block.ids.tolist()]
            assert (upper[i] >= got).all()
            excluded += int((upper[i] < np.sort(got)[-1]).sum())
    assert excluded > len(docs)                # the bounds do exclude
    for floors in ([1] * len(items), [max([s for (j, _), s in want.items() if j == i] or [1]) // 2
                                      for i in range(len(items))]):
        hits = [row for b in bitsliced._search(query, 10, floors)(blocks)
                for row in zip(*[c.to_pylist() for c in b.columns], strict=True)]
        for i, rows in ranking(docs, ids, items, 10).items():
            mine = sorted(((-s, d) for j, d, s in hits if j == i))
            assert [(r + 1, d, -s) for r, (s, d) in enumerate(mine)] == [
                x for x in rows if x[2] >= floors[i]]


def search_all(spark, docs, items, k=5):
    path = new_path(spark, "test-index")
    bitsliced.build_index(docs, path)
    return bitsliced.search(spark, path, items, k)


def test_search_equals_the_formula(spark):
    docs = ODD + sample_texts(7, 60) + ["tie one", "tie two", "tie three"] * 4
    ids = [None if i == 3 else i for i in range(len(docs))]
    items = ["tie", "long one two", None, "", "!!", "x" * 50_000 + " same TEXT", "tie"]
    rows = spark.createDataFrame([(i if i < 6 else 0, t) for i, t in enumerate(items)],
                                 "item_id bigint, text string").withColumn("rank", F.lit("clash"))
    want = ranking(docs, ids, items, 5)
    want = sorted([(i, *x) for i in range(6) for x in want[i]] + [(0, *x) for x in want[6]], key=repr)
    got = search_all(spark, frame(spark, docs, True).repartition(3), rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert search_all(spark, empty(spark), rows).count() == 0
    assert search_all(spark, frame(spark, docs), rows.limit(0)).count() == 0
    assert search_all(spark, frame(spark, [None, "", " . "]), rows).count() == 0


def test_items_come_in_bounded_sets(spark, monkeypatch):
    monkeypatch.setattr(bitsliced, "ITEMS_AT_ONCE", 3)
    items = spark.createDataFrame([(str(i), f"w{i} w{i + 1}") for i in range(8)], "item_id string, text string")
    docs = sample_texts(8, 40)
    assert [len(x) for x in bitsliced.item_sets(items, "item_id", "text")] == [3, 3, 2]
    got = search_all(spark, frame(spark, docs), items)
    ids = [None if i == 3 else i for i in range(len(docs))]
    want = ranking(docs, ids, [f"w{i} w{i + 1}" for i in range(8)], 5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(str(i), *x) for i in range(8) for x in want[i]], key=repr)


# --- resampling -----------------------------------------------------------------------------------

def test_checksums_by_columns_are_those_of_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000, dtype=np.uint8)
    length = np.concatenate([rng.integers(0, 40, 500), [5000, 0, 4096, 4097]])
    begin = rng.integers(0, len(data) - length + 1)
    got = resampling.crc32_of_ranges(data, begin, length)
    assert got.tolist() == [zlib.crc32(data[b:b + n]) for b, n in zip(begin, length, strict=True)]


def features_of(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(docs, ids, target, buckets=10_000):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets
    s, t = Counter(), Counter()
    for text in docs:
        s.update(map(bucket, features_of(text)[1]))
    for text in target:
        t.update(map(bucket, features_of(text)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc, text in zip(ids, docs, strict=True):
        words, found = features_of(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
                 for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(found), weight, score, None, len(words)])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = place + 1
    return sorted(map(repr, (tuple(r[:5]) for r in rows)))


def test_resampling_equals_the_formula(spark):
    docs, target = ODD + sample_texts(9, 80), sample_texts(10, 15) + [None, ""]
    ids = [None if i == 3 else i for i in range(len(docs))]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame(spark, docs, True).repartition(3), aim, 25)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == resampled(docs, ids, target)
    assert resampling.resample(empty(spark), aim, 25).count() == 0
    none = resampling.resample(frame(spark, docs), aim.limit(0), 25)
    assert sorted(repr(tuple(r)) for r in none.collect()) == resampled(docs, ids, [])


def test_one_id_in_many_rows_is_drawn_row_by_row(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(7, text)] * 200 + [(i, text + " x") for i in range(8, 108)],
                                 "doc_id bigint, text string").repartition(7)
    got = resampling.resample(rows, rows.limit(1).select("text"), 50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 151))


# --- lines ----------------------------------------------------------------------------------------

def kept_lines(rows, least, copies):
    """(doc, lines, lines lost, text left) by definition."""
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        who = -(1 << 63) if doc is None else doc
        left = [x for x in lines if len(holders.get(key(x), ())) < copies or who == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(map(repr, out))


def line_rows(seed, n):
    rng = random.Random(seed)
    common = [f"a line that comes again, number {i} é" for i in range(12)] + ["short", "", " \t"]
    rows = []
    for doc in range(n):
        lines = [rng.choice(common) if rng.random() < .6 else f"a line of its own {doc} {rng.random()}"
                 for _ in range(rng.randint(0, 14))]
        if rng.random() < .7:
            lines.insert(rng.randint(0, len(lines)), "  THE one line that nearly all documents hold \r")
        rows.append((doc, "\n".join(lines)))
    return rows


def cleaned(docs, **kwargs):
    return line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, **kwargs))


def test_lines_are_those_of_the_definition(spark):
    rows = line_rows(1, 300) + [(5, "x"), (None, "the one line that nearly all documents hold"), (400, None),
                                (401, ""), (299, "a line that comes again, number 1 é\n" * 50), (7, "x"), (7, "x")]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).withColumns(
        {c: F.lit("clash") for c in ("doc", "version", "pos", "keep", "high")}).repartition(5)
    for least, copies in ((20, 3), (3, 2), (1, 7)):
        got = cleaned(docs, least=least, copies=copies)
        assert sorted(repr(tuple(r)) for r in got.collect()) == kept_lines(rows, least, copies)
    assert cleaned(empty(spark)).count() == 0


def test_a_line_over_many_ranges(spark):
    """More rows of one hash than a range holds."""
    rows = [(i, "the very same line in all of them\n" * (1 + i % 3) + f"line of document {i} alone")
            for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cleaned(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(repr(tuple(r)) for r in got) == kept_lines(rows, 20, 3)


def test_streamed_decisions_do_not_depend_on_ranges_and_batches():
    rng = random.Random(3)
    for trial in range(300):
        copies = rng.choice([1, 2, 3, 4])
        rows = sorted({(rng.randint(0, 4), 0, -rng.randint(0, rng.choice([2, 9])), 0, rng.randint(0, 3))
                       for _ in range(rng.randint(1, 60))})
        rows = np.array([(h, low, -d, v, p) for h, low, d, v, p in rows], np.int64)
        docs = defaultdict(set)
        for r in rows.tolist():
            docs[r[0]].add(r[2])
        want = sorted(tuple(r) for r in rows.tolist() if len(docs[r[0]]) >= copies and r[2] < max(docs[r[0]]))
        lost, later, seen = [], [], defaultdict(set)
        cuts = sorted(rng.sample(range(len(rows) + 1), min(rng.randint(0, 4), len(rows))))
        for part in np.split(rows, cuts):
            inner = sorted(rng.sample(range(len(part) + 1), min(rng.randint(0, 5), len(part))))
            batches = [SimpleNamespace(column=lambda i, b=b: SimpleNamespace(
                to_numpy=lambda: b[:, i])) for b in np.split(part, inner)]
            for out in line_dedup._decide(copies)(batches):
                for *row, kind in zip(*[c.to_pylist() for c in out.columns], strict=True):
                    if kind == line_dedup.LOSE:
                        lost.append(tuple(row))
                    else:
                        seen[row[0]].add(row[2])
                        if kind == line_dedup.LATER:
                            later.append(tuple(row))
        lost += [r for r in later if len(seen[r[0]]) >= copies and r[2] < max(seen[r[0]])]
        assert sorted(lost) == want, trial


def test_bitmaps_hold_a_bit_a_line(spark):
    docs = spark.createDataFrame(line_rows(2, 60), "doc_id bigint, text string")
    for row in line_dedup.keep_bitmaps(docs).collect():
        bits = zlib.decompress(row["keep"])
        assert bits and any(b != 255 for b in bits)
