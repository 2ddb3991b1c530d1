"""Every operator against a plain brute-force version or a property, and its edge cases."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from tidings.llm import (
    attention, bm25, hilbert, jaccard, lattice, lengths, outliers, segments, token_files, weak, words,
)
from tidings.llm.encode import Encoder
from tidings.shared import new_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Nulls, empties, blanks, ties, repeats and one very long text.
ODD = [None, "", "   ", "one", "one two", "one two three", "ONE two three", "é ü 日本", "\n\n", "a\tb\x0bc",
       "long " * 30_000, "x" * 50_000, "same text here again", "same text here again"]


def frame(spark, texts, extra=False):
    rows = [(i if i != 3 else None, t, None if i % 5 == 4 else "en", None if i % 7 == 6 else "s", None)
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    # Columns with the names that the operators use inside.
    return df.withColumns({c: F.lit("clash") for c in ("row", "part", "hash", "n", "base", "more",
                                                       "spans_base", "grp", "region", "label")}
                          ) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sample_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "über", "niño,", "end.", "\n"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90))) for _ in range(n)]
    for base in texts[:20]:
        parts = base.split(" ")
        for _ in range(3):
            near = list(parts)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    return texts


# --- words and ids ------------------------------------------------------------------------------

def test_words_are_those_of_the_pattern():
    texts = [t for t in ODD if t is None or len(t) < 1000] + sample_texts(1)
    got = []
    for _, _, data, bounds in words.runs(pa.array(texts, pa.string()), 300):
        w = words.Words(data, bounds, lower=True)
        got += [[bytes(data[a:b]) for a, b in zip(w.start[f:t], w.end[f:t], strict=True)]
                for f, t in itertools.pairwise(w.first)]
        by_word = {}
        for a, b, h in zip(w.start, w.end, w.hash, strict=True):
            assert by_word.setdefault(bytes(data[a:b]).lower(), h) == h
        assert len(set(by_word.values())) == len(by_word)
    assert got == [[w.encode() for w in WORD.findall(t or "")] for t in texts]


def test_ids_equal_the_library_s():
    enc, rng = Encoder(VOCABULARY), random.Random(2)
    letters = "ab .,\n\t'é1 !​\x1c　Z"
    texts = [t for t in ODD if t] + sample_texts(3) + [
        "".join(rng.choice(letters) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(enc.ids(t), enc.type).tolist() for t in texts] == want


def ids_of(text, end):
    enc = Encoder(VOCABULARY)
    return (enc.tokenizer.encode(text, add_special_tokens=False).ids if text else []) + [end]


def test_token_files_round_trip(spark):
    texts = ODD + sample_texts(4, 10)
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(frame(spark, texts, True), path, VOCABULARY, end_id=2)
    order = [3, *[i for i in range(len(texts)) if i != 3]]       # rows without an id come first
    at, want = 0, []
    for i in order:
        ids = ids_of(texts[i], 2)
        want.append((None if i == 3 else i, at, len(ids),
                     zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.digest(spark, path).orderBy("start").collect()]
    assert got == want
    some = token_files.read_tokens(spark, path, F.col("doc_id") == 5).collect()
    assert [r["tokens"] for r in some] == [ids_of(texts[5], 2)]
    assert [tuple(r) for r in token_files.read_metadata(spark, path).orderBy("start").collect()] == [
        w[:3] for w in want]
    path = new_path(spark, "test-tokens")
    token_files.write_tokens(empty(spark), path, VOCABULARY, end_id=2)
    assert token_files.digest(spark, path).count() == 0


def test_packing_holds_each_id_once_without_padding(spark):
    texts = ODD + sample_texts(5, 30)
    rows = hilbert.pack_along_curve(frame(spark, texts, True), VOCABULARY, 0, size=64).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        ids, at = ids_of(text, 0), 0
        for r in sorted(by_doc[None if i == 3 else i], key=lambda r: r["start"]):
            piece = np.array(ids[at:at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (
                at, len(ids), zlib.crc32(piece.tobytes()))
            at += r["length"]
        assert at == len(ids)
    sizes = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes[r["sequence_id"]]
        sizes[r["sequence_id"]] += r["length"]
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(n <= 64 and n & (n - 1) == 0 for n in sizes.values())
    assert hilbert.pack_along_curve(empty(spark), VOCABULARY, 0).count() == 0


def test_hilbert_keys_of_neighbours_are_cells_side_by_side():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = hilbert.hilbert_key(cells, bits=3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_lengths(spark):
    texts = ODD + sample_texts(6, 20)
    n = [len(ids_of(t, 0)) for t in texts]
    histogram = lengths.length_histogram(frame(spark, texts, True), VOCABULARY, "source")
    rows = lengths.context_totals(histogram).where("whole").collect()
    assert {r["n_tokens"]: r["documents"] for r in rows} == Counter(n)
    for r in rows:
        assert r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in n)
        assert r["longer"] == sum(x > r["n_tokens"] for x in n)
        assert r["tokens_total"] == sum(n)
    at = {r["limit"]: r for r in lengths.total_at(histogram, [1, 7, 10**6]).where("whole").collect()}
    assert {k: r["truncated_total"] for k, r in at.items()} == {
        k: sum(min(x, k) for x in n) for k in (1, 7, 10**6)}
    assert lengths.context_totals(lengths.length_histogram(empty(spark), VOCABULARY, "lang")).count() == 0


# --- Jaccard join -------------------------------------------------------------------------------

def brute_components(texts, size, num, den):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size
                    else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


@pytest.mark.parametrize(("seed", "size", "num", "den"), [(1, 3, 90, 100), (2, 5, 80, 100), (3, 1, 60, 100)])
def test_jaccard_components(spark, seed, size, num, den):
    texts = sample_texts(seed) + [t for t in ODD if t is None or len(t) < 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn(
        "region", F.lit("clash"))
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, size, num, den).collect())
    assert got == brute_components(texts, size, num, den)


def test_jaccard_chain_and_hot_group(spark):
    """A chain of small edits is one component though its ends differ; so is a large near group."""
    rng = random.Random(9)
    parts = [f"a{i}" for i in range(80)]
    chain = [" ".join(parts)]
    for i in range(30):
        parts[rng.randrange(80)] = f"b{i}"
        chain.append(" ".join(parts))
    group = [f"c{i}" for i in range(100)]
    near = [" ".join(group[:k] + [f"d{k}"] + group[k + 1:]) for k in range(0, 100, 2)]
    texts = chain + near
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in jaccard.jaccard_components(df, 3, 85, 100).collect())
    assert got == brute_components(texts, 3, 85, 100)


def test_jaccard_rows_that_share_an_id(spark):
    """Each text of an id links it; the texts of an id are one document."""
    rng = random.Random(19)
    a, b, c, d = [" ".join(f"{x}{rng.randint(0, 9999)}" for _ in range(60)) for x in "abcd"]
    got = lambda rows: sorted({
        (r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(
            spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90, 100).collect()}, key=repr)
    assert got([(5, a), (5, b), (7, b + " more")]) == [(5, 5), (7, 5)]
    assert got([(5, b), (5, a), (7, b + " more"), (3, a + " else"), (9, c)]) == [
        (3, 3), (5, 3), (7, 3), (9, 9)]
    assert got([(None, d), (4, d + " more"), (None, c)]) == sorted(
        [(None, 4), (4, 4), (None, None)], key=repr)


def test_jaccard_large_group_is_measured_in_few_pairs(spark, monkeypatch):
    """Near copies of one text, each with a few words of its own: most are linked, but not all to the first."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        mine = list(base)
        for j in rng.sample(range(120), rng.randint(1, 4)):
            mine[j] = f"own{i}x{j}"
        texts.append(" ".join(mine))
    counted = []

    def measured(pairs, texts, size):
        counted.append(pairs.count())
        return real(pairs, texts, size)

    real = jaccard.measured
    monkeypatch.setattr(jaccard, "measured", measured)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(frame(spark, texts), 3, 85, 100).collect()
                 if r["doc_id"] is not None)
    ids = [i for i in range(len(texts)) if i != 3]
    shingles = [{tuple(t.split()[j:j + 3]) for j in range(118)} for t in texts]
    least = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if 100 * len(shingles[a] & shingles[b]) >= 85 * len(shingles[a] | shingles[b]):
            old, new = sorted((least[a], least[b]), reverse=True)
            least = [new if x == old else x for x in least]
    named = {c: min(i for i in ids if least[i] == c) for c in set(least) if any(least[i] == c for i in ids)}
    assert got == [(i, len(shingles[i]), named[least[i]]) for i in ids]
    assert sum(counted) < 10 * len(texts)


def test_jaccard_region_of_many_unlinked_documents(spark):
    """2,000 documents share a passage, and so regions, but only some pairs are linked."""
    rng = random.Random(20)
    shared = " ".join(f"p{i}" for i in range(30))
    texts = [shared + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(1960)]
    near = [texts[i] + " tail" for i in range(0, 40)]
    texts += near
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"]
           for r in jaccard.jaccard_components(df, 3, 90, 100).collect()}
    assert got == {i: i - 1960 if i >= 1960 else i for i in range(2000)}


def test_components_of_long_chains(spark):
    rng = random.Random(21)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000) for i in range(1, 50)] + [(7, 7), (5000, 4000)]
    rng.shuffle(edges)
    links = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in jaccard.components(links).collect()}
    want = {**dict.fromkeys(range(301), 0), **dict.fromkeys(range(1000, 1050), 1000), 4000: 4000, 5000: 4000}
    assert got == want
    assert jaccard.components(links.limit(0)).count() == 0


def test_one_of_each_keeps_columns_of_any_name(spark):
    rng = random.Random(22)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(40)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[0] + " x"), (3, texts[1]), (None, texts[1]), (None, texts[2]),
            (4, None), (4, None), (5, ""), (1, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {c: F.lit("mine") for c in ("__row", "doc", "version", "row", "h1", "first")})
    got = jaccard.one_of_each(docs, 5, 80, 100)
    assert got.columns == docs.columns
    assert sorted((repr((r["doc_id"], r["text"])), r["doc"], r["version"], r["__row"]) for r in got.collect()) == [
        (repr(x), "mine", "mine", "mine") for x in sorted(
            [rows[0], rows[3], rows[5], *rows[6:]], key=repr)]


def test_jaccard_edges(spark):
    rows = jaccard.jaccard_components(frame(spark, ODD, True), 3, 90, 100).collect()
    assert len(rows) == len(ODD)
    by_id = {r["doc_id"]: r["component_id"] for r in rows}
    assert by_id[5] == by_id[6] == 5 and by_id[13] == 12 and by_id[0] == 0 and by_id[1] == 1
    assert jaccard.jaccard_components(empty(spark), 3, 90, 100).count() == 0


# --- quality and toxicity -----------------------------------------------------------------------

def statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    counts = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if counts[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_quality_statistics_and_outliers(spark):
    rng = random.Random(8)
    clean = [" ".join(f"{rng.choice(['plain', 'words', 'prose'])}{rng.randint(0, 400)}"
                      for _ in range(rng.randint(60, 200))) for _ in range(150)]
    junk = [" ".join(f"###{rng.random()}$$$" for _ in range(100)) for _ in range(5)]
    texts = ODD + clean + junk + ["a\nb\na\n\nb\na", "x y z x y z q", "tail\n"]
    got = outliers.quality_verdicts(frame(spark, texts, True)).collect()
    assert len(got) == len(texts)
    by_id = {r["doc_id"]: r for r in got}
    for i, text in enumerate(texts):
        r, want = by_id[None if i == 3 else i], statistics(text)
        assert tuple(r[c] for c in outliers.COUNTS[:5]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    first = len(ODD)
    assert all(by_id[i]["kept"] for i in range(first, first + 150))
    assert not any(by_id[i]["kept"] for i in range(first + 150, first + 155))
    assert outliers.quality_verdicts(empty(spark)).count() == 0


def held_out_rate(score, label):
    return np.mean((score >= 0.5) == (label == 1))


def test_attention_learns_from_document_labels(spark):
    rng = random.Random(10)
    prose = lambda n: " ".join(f"{rng.choice('abcdefg')}word{rng.randint(0, 99)}" for _ in range(n))
    texts = [prose(150) + (" ###" * 60 if i % 3 == 0 else "") + " " + prose(90) for i in range(240)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(240)], "doc_id bigint, quality int")
    model = attention.fit(docs, labels, F.col("doc_id") < 180)
    rows = [r for r in attention.quality_scores(docs, model).collect() if (r["doc_id"] or 0) >= 180]
    assert held_out_rate(np.array([r["score"] for r in rows]),
                         np.array([int(r["doc_id"] % 3 != 0) for r in rows])) > 0.9
    odd = attention.quality_scores(frame(spark, ODD, True), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    blank = attention.fit(docs, labels, F.lit(False))
    assert {r["score"] for r in attention.quality_scores(docs, blank).collect()} == {0.5}
    assert attention.quality_scores(empty(spark), model).count() == 0


def test_maximal_segments():
    """The segments are disjoint, hold no better prefix, and the best one is the best run of all."""
    rng = random.Random(11)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 8 for _ in range(rng.randint(1, 25))]
        found = sorted(segments.maximal_segments(scores))
        best = max(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
        if best > 0:
            assert max(s for _, _, s in found) == pytest.approx(best)
        after_all = [*found, (len(scores), 0, 0)][1:]
        for (a, b, s), after in zip(found, after_all, strict=True):
            assert b <= after[0] and s == pytest.approx(sum(scores[a:b]))
            assert all(sum(scores[a:k]) > 0 and sum(scores[k:b]) > 0 for k in range(a + 1, b))
        inside = {i for a, b, _ in found for i in range(a, b)}
        assert all(i in inside for i, s in enumerate(scores) if s > 0)


def test_maximal_segments_by_definition_and_in_linear_time():
    """The best run of all, then the best ones of what lies before and after it; and long falling totals."""
    def by_definition(scores, first=0):
        best = max(((sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)),
                   default=(0, 0, 0))
        if best[0] <= 0:
            return []
        _, a, b = best
        return [*by_definition(scores[:a], first), (first + a, first + b),
                *by_definition(scores[b:], first + b)]
    rng = random.Random(23)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 8 for _ in range(rng.randint(1, 18))]
        assert sorted((a, b) for a, b, _ in segments.maximal_segments(scores)) == by_definition(scores)
    start = time.perf_counter()
    assert len(segments.maximal_segments([1.0, -2.0] * 100_000)) == 100_000
    assert len(segments.maximal_segments([2.0, -1.0] * 100_000)) == 1
    assert time.perf_counter() - start < 5


def test_rows_without_an_id_are_in_no_fold(spark):
    from tidings.llm.queries import fold
    rows = spark.createDataFrame([(None,), (1,), (10,)], "doc_id bigint")
    assert [r[0] for r in rows.select(fold(5, zlib.crc32(b"1") % 5)).collect()] == [
        False, True, zlib.crc32(b"10") % 5 == zlib.crc32(b"1") % 5]


def test_toxic_segments(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randint(0, 400)}" for _ in range(n))
    texts = [prose(80) + (" vilewordx, vilewordy! " if i % 4 == 0 else " ") + prose(40) for i in range(400)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    model = segments.fit(docs, labels, F.col("doc_id") < 300)
    rows = [r for r in segments.toxicity_scores(docs, model).collect() if (r["doc_id"] or 0) >= 300]
    assert held_out_rate(np.array([r["score"] for r in rows]),
                         np.array([int(r["doc_id"] % 4 == 0) for r in rows])) > 0.95
    found = segments.toxic_segments(docs, model).where("doc_id = 300").collect()
    assert [(r["first_word"], r["after_word"]) for r in found] == [(80, 82)]
    odd = segments.toxicity_scores(frame(spark, ODD, True), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    one_class = segments.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert all(r["score"] < 0.1 for r in segments.toxicity_scores(docs, one_class).collect())
    assert segments.toxicity_scores(empty(spark), model).count() == 0


# --- personal data ------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m.group() if c.isdigit()]
            twice = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1]))
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".") if kind == "ip"),
                    "card": 14 <= len(digits) <= 19 and twice % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), no, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark):
    rng = random.Random(13)
    texts = ODD + [
        "a@b.c@d.e f_g@h.i x@y.z_foo@bar.com", "4668 6568 1750 6359 46686568175063591 4111-1111-1111-1111",
        "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1 1..2", "+1 (988) 555-2485 +12 +1234567890123456",
        "\U0001f600 a@b.co é 1.2.3.4", "1 2 3 4 " * 5000,
        'password=d72a491f71c7584344 and token = "6b526d9e98196c4dff5a73e8083186bb0ce9e5bd" end',
        *["".join(rng.choice("ab@.1234567890 -+()é_%") for _ in range(60)) for _ in range(400)],
        *["".join(rng.choice("1234567890 -") for _ in range(40)) for _ in range(400)]]
    docs = frame(spark, texts, True)
    for r in weak.personal_data(docs).collect():
        want = base_spans(texts[3 if r["doc_id"] is None else r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert [s for s in every if not s.startswith("secret")] == want
        assert r["n_email"] == sum(s.startswith("email") for s in want)
    clean = {r["doc_id"]: r["text"] for r in weak.redacted(docs).collect()}
    assert weak.redacted(docs).columns == docs.columns
    assert clean[0] is None and clean[len(ODD) + 4] == "\U0001f600 <email> é <ip>"
    assert clean[len(ODD) + 6] == 'password=<secret> and token = "<secret>" end'
    assert weak.personal_data(empty(spark)).count() == 0 == weak.redacted(empty(spark)).count()


# --- benchmark search ---------------------------------------------------------------------------

def test_bm25_bounds_lose_nothing(spark):
    rng = random.Random(14)
    vocabulary = [f"v{i}" for i in range(200)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))) for _ in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(100)) for _ in range(60)]
    for i in range(0, 60, 3):
        texts[i] += " " + items[i % 40].upper() + ". tail"
    index = bm25.build_index(list(enumerate(items)))
    for _, _, data, bounds in words.runs(pa.array(texts)):
        w = words.Words(data, bounds, lower=True, between=words.NOT_ALNUM)
        got = {(r, index.ids[i]): s for r, i, s in bm25.retrieve(w, index, 0.4)}
        want, half = {}, index.passage // 2
        for row in range(len(bounds) - 1):
            own = w.hash[w.first[row]:w.first[row + 1]]
            for begin in range(0, len(own), half):
                terms = np.flatnonzero(np.isin(index.terms, own[begin:begin + 2 * half]))
                for t in terms:
                    for k in range(index.begin[t], index.begin[t + 1]):
                        key = (row, index.ids[index.item[k]], begin)
                        want[key] = want.get(key, 0.0) + index.impact[k]
        best = {}
        for (row, item, _), s in want.items():
            if s >= 0.4:
                best[row, item] = max(best.get((row, item), 0.0), s)
        assert got == pytest.approx(best)
    docs = frame(spark, texts)
    tests = spark.createDataFrame([*enumerate(items), (99, None), (98, " ")], "item_id bigint, text string")
    for size in (5_000, 7):
        leaks = {(r["doc_id"], r["item_id"]) for r in bm25.contaminated(
            docs, tests, index_items=size).collect()}
        assert {(i if i != 3 else None, i % 40) for i in range(0, 60, 3)} == leaks
    assert bm25.contaminated(frame(spark, ODD, True), tests).count() == 0
    assert bm25.contaminated(empty(spark), tests).count() == 0
    assert bm25.contaminated(docs, tests.where("false")).count() == 0


def test_bm25_finds_items_of_one_and_two_words(spark):
    rng = random.Random(18)
    prose = [" ".join(f"v{rng.randint(0, 200)}" for _ in range(100)) for _ in range(4)]
    texts = [prose[0] + " Zygote quark. " + prose[1], prose[1] + " quark of zygote", "xylem", prose[2]]
    tests = spark.createDataFrame([(1, "zygote quark"), (2, "xylem"), (3, prose[3])],
                                  "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in bm25.contaminated(frame(spark, texts), tests).collect()
            } == {(0, 1), (2, 2)}


def test_bm25_finds_edited_and_partial_items_however_the_index_is_split(spark):
    rng = random.Random(19)
    prose = lambda n: [f"v{rng.randint(0, 200)}" for _ in range(n)]
    items = [prose(rng.randint(30, 60)) for _ in range(20)]
    edited = [f"edit{i}" if i % 6 == 5 else w for i, w in enumerate(items[0])]
    partial = items[1][:-(len(items[1]) // 3)]
    texts = [" ".join([*prose(50), *part, *prose(50)]) for part in (edited, partial, [], [])]
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)],
                                  "item_id bigint, text string")
    docs = frame(spark, texts)
    assert {(r["doc_id"], r["item_id"]) for r in bm25.contaminated(docs, tests).collect()} == {
        (0, 0), (1, 1)}
    scores = lambda size: {(r["doc_id"], r["item_id"]): r["score"] for r in bm25.retrieved(
        docs, tests, threshold=0.1, index_items=size).collect()}
    assert scores(7) == pytest.approx(scores(5_000))


# --- lattice ------------------------------------------------------------------------------------

def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces(PIECES)
    log_p = np.log(pieces.prior)
    chance = dict(zip(pieces.texts, pieces.prior, strict=True))

    def total(text):
        return 1.0 if not text else sum(
            chance[text[:k]] * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in chance)
    for word in (b"the", b"hat", "über".encode(), b"x\xff", b"a"):
        (_, letters), = lattice.by_length(pa.array([word], pa.binary()))
        alpha, _ = lattice.forward(letters, pieces, log_p)
        assert np.exp(alpha[0, -1]) == pytest.approx(total(b" " + word))
        uses = lattice.expected(letters, np.ones(1), pieces, log_p)
        assert sum(u * len(t) for u, t in zip(uses, pieces.texts, strict=True)) == pytest.approx(
            len(word) + 1)


@pytest.mark.parametrize("head", [0, 20, 100_000])
def test_lattice_scores(spark, head):
    texts = ODD[:10] + ODD[12:] + sample_texts(15, 20)
    docs = frame(spark, texts, True)
    got = {r["doc_id"]: r for r in lattice.lattice_scores(
        docs, F.col("doc_id") % 3 == 0, PIECES, head_words=head).collect()}
    counts, tokens = Counter(), [WORD.findall((t or "").translate(LOWER)) + ["\n"] for t in texts]
    for i, t in enumerate(tokens):
        if i % 3:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(tokens):
        r = got[None if i == 3 else i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            i % 3 == 0, len(t), sum(counts[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in t))
        assert r["score"] < 0
    nothing = lattice.lattice_scores(docs, F.lit(True), PIECES).collect()
    assert all(r["n_known"] == 0 == r["train_tokens"] for r in nothing)
    assert lattice.lattice_scores(empty(spark), F.lit(False), PIECES).count() == 0


def test_lattice_scores_of_very_long_texts(spark):
    texts = ODD[10:12] + sample_texts(20, 5)
    rows = lattice.lattice_scores(frame(spark, texts), F.col("doc_id") == 1, PIECES, head_words=0).collect()
    got = {r["doc_id"]: r for r in rows}
    assert (got[0]["n_tokens"], got[1]["n_tokens"], got[1]["n_known"]) == (30_001, 2, 1)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert got[1]["score"] < got[2]["score"]


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(16)
    prose = [" ".join(f"word{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(80)]
    item = " ".join(f"bench{i}" for i in range(30))
    texts = [*prose, prose[0], prose[1] + " more", prose[2] + " " + item, prose[3][::-1] + " a@b.co", "short"]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs)
        if name != "packing":
            assert docs.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert ids(seen[0]) == set(range(84))
    assert ids(seen[1]) == set(range(80)) | {82, 83}
    assert ids(seen[2]) == set(range(80)) | {83}
    assert "<email>" in seen[3].where("doc_id = 83").first()["text"]
    assert ids(seen[4]) == ids(seen[3])


def test_pipeline_decides_each_row_for_itself(spark, tmp_path):
    """Ids that are missing, or shared by unrelated texts, neither lose a row nor save one."""
    rng = random.Random(17)
    prose = [" ".join(f"word{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(84)]
    item = " ".join(f"bench{i}" for i in range(30))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    at = lambda rows: spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    after = lambda stage, rows: Counter(
        (r["doc_id"], r["text"]) for r in stage(spark, at(rows), str(tmp_path)).collect())
    clean = [*enumerate(prose[:80]), (None, prose[80]), (None, prose[81]), (5, prose[82])]
    assert after(corpus_pipeline.quality_rules, [*clean, (6, "short"), (None, "short")]) == Counter(clean)
    copies = [(None, prose[80]), (90, prose[0] + " more"), (None, prose[1])]
    assert after(corpus_pipeline.near_duplicates, [*copies, *clean]) == Counter(clean)
    named = at(clean).withColumns({c: F.lit("mine") for c in ("__row", "row", "lang_", "middle", "kept", "c0")})
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.decontamination):
        rows = stage(spark, named, str(tmp_path))
        assert rows.columns == named.columns
        assert {(r["row"], r["__row"], r["kept"]) for r in rows.collect()} == {("mine",) * 3}
    leaks = [(7, prose[83] + " " + item), (None, prose[7] + " " + item)]
    assert after(corpus_pipeline.decontamination, [*leaks, *clean]) == Counter(clean)


@pytest.mark.parametrize("texts", [[], ODD])
def test_pipeline_edges(spark, tmp_path, texts):
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0
