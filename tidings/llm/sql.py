"""Operators as SQL, where SQL can state them."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Ranked search: exact scores of every document that has a term of the item.
RANKED = rf"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")},
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
docs AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM docs),
wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format("text")},
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark),
weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM counts SEMI JOIN wanted USING (term) GROUP BY term), corpus),
scores AS (
    SELECT item_id, c.doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN counts c USING (term) JOIN docs USING (doc_id), corpus
    GROUP BY item_id, c.doc_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
    FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

#: Resampling. The checksum is folded over the bytes of each distinct feature.
RESAMPLED = rf"""
WITH table_of_bytes AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
    SELECT 0 AS target, doc_id, text FROM documents
    UNION ALL SELECT 1, item_id, text FROM benchmark),
split AS (
    SELECT target, doc_id,
        coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM texts),
runs AS (
    SELECT target, doc_id, len(w) AS n_words,
        list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f
    FROM split),
placed AS (SELECT target, doc_id, unnest(f) AS feature FROM runs),
hashed AS (
    SELECT feature, xor(list_reduce(
        list_concat([4294967295], list_transform(range(1, strlen(feature) + 1), lambda i:
            ('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT feature FROM placed), table_of_bytes),
counts AS (
    SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t
    FROM placed JOIN hashed USING (feature) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM counts),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
    FROM counts, totals),
sums AS (
    SELECT doc_id, sum(gain)::BIGINT AS gain FROM placed JOIN hashed USING (feature) JOIN gains USING (bucket)
    WHERE target = 0 GROUP BY doc_id),
weighed AS (
    SELECT doc_id, n_words, len(f)::BIGINT AS n_features,
        CASE WHEN len(f) = 0 THEN 0
             ELSE (gain - ((gain % len(f)) + len(f)) % len(f)) // len(f) END::BIGINT AS weight,
        ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
    FROM runs LEFT JOIN sums USING (doc_id) WHERE target = 0),
scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM weighed),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS drawn
    FROM scored)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_words >= 20 AND place <= drawn THEN place END::BIGINT AS rank
FROM ranked
"""

#: Lines that come again.
LINES = rf"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (
    SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
    FROM lines),
again AS (
    SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
decided AS (SELECT k.*, holder IS NOT NULL AND doc_id < holder AS lost FROM keyed k LEFT JOIN again USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM decided GROUP BY doc_id
"""

#: Jaccard components: all shared shingles are counted, and links followed to the end.
COMPONENTS = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        END) AS s
    FROM split),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""

SQL = {
    "op1_jaccard_join": COMPONENTS,
    "op11_bitsliced_search": RANKED,
    "op12_crc_resampling": RESAMPLED,
    "op13_line_bitmaps": LINES,
}
