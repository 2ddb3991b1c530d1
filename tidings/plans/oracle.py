"""The catalog's queries as SQL over the test tables."""

import re

from tidings import fixed_values as fv
from tidings.plans import catalog as c, tables as t

WS = "'" + fv.WHITESPACE + "'"
NL = "chr(10)"
NO_TEXT = "CAST(NULL AS VARCHAR)"
APPROX = f"'{fv.APPROX_DATE_TAG}'"


# --- expressions --------------------------------------------------------------------------------

def ident(url: str) -> str:
    return f"substr(sha1({url}), 1, 16)"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def day(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def entities(text: str) -> str:
    """The references that occur in the tables; an ampersand's semicolon may be missing."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·")):
        text = f"replace({text}, '&{name};', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def plain(html: str) -> str:
    """HTML to text without truncation."""
    text = f"regexp_replace({html}, '(?s)<!--.*?-->', '', 'g')"
    text = f"regexp_replace({text}, '(?i)<li[^>]*>', {NL} || '- ', 'g')"
    text = f"regexp_replace({text}, '(?i)</p>|<br\\s*/?>|</li>|</h[1-6]>', {NL}, 'g')"
    text = entities(f"regexp_replace({text}, '<[^>]+>', '', 'g')")
    text = f"regexp_replace({text}, '[ \\t]+', ' ', 'g')"
    text = f"array_to_string([{strip('x')} for x in string_split({text}, {NL})], {NL})"
    return strip(f"regexp_replace({text}, '\\n{{3,}}', {NL} || {NL}, 'g')")


def cut(text: str, n: int = fv.SUMMARY_MAX_CHARS) -> str:
    """Truncation of a plain column."""
    def last(char: str) -> str:
        found = f"instr(reverse(substr({text}, 1, {n})), {char})"
        return f"(CASE WHEN {found} = 0 THEN -1 ELSE {n} - {found} END)"

    line, space = last(NL), last("' '")
    at = (f"CASE WHEN {line} >= {n} * {fv.SUMMARY_MIN_CUT} THEN {line} "
          f"WHEN {space} > 0 THEN {space} ELSE {n} END")
    return (f"CASE WHEN length({text}) <= {n} THEN {text} "
            f"ELSE rtrim(substr({text}, 1, {at}), {WS}) || '{fv.ELLIPSIS}' END")


def category(text: str, rules=None, fallback: str = fv.FALLBACK_CATEGORY) -> str:
    def test(keywords) -> str:
        words = "|".join(re.escape(k) for k in keywords)
        return f"regexp_matches({text}, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words})')"

    whens = " ".join(f"WHEN {test(ks)} THEN '{name}'"
                     for name, ks in (rules or fv.CATEGORY_RULES))
    return f"CASE {whens} ELSE '{fallback}' END"


def hint(column: str, hints: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in hints.items()) + " END"


def sk(published: str = "published", first_seen: str = "first_seen") -> str:
    return f"coalesce(nullif({published}, ''), nullif({first_seen}, ''), '')"


def month(key: str = "sk") -> str:
    return f"CASE WHEN {key} = '' THEN '{fv.UNDATED_MONTH}' ELSE substr({key}, 1, 7) END"


def joined(tags: str) -> str:
    return f"array_to_string({tags}, '|')"


# --- views --------------------------------------------------------------------------------------

SIGHTINGS = f"""sightings AS (
    SELECT {ident('url')} AS id, * FROM (
        SELECT '{t.SITE}/users/' || user_id || '/' || event_type || '/' || {day('ts')} AS url,
               {day('ts')} AS run_date,
               CASE WHEN event_type <> 'error' THEN {day('ts')} END AS published,
               event_type AS source, event_id AS ord FROM events))"""

SEEN_ITEMS = f"""seen_items AS (
    SELECT id, url, source, published, {NO_TEXT} AS first_seen, ord, run_date FROM sightings)"""

LEDGER = f"""ledger AS (
    SELECT id, min(run_date) AS first_seen FROM sightings
    WHERE run_date < '{c.LEDGER_DAY}' GROUP BY id)"""

ORDER_ITEMS = f"""order_items AS (
    SELECT {ident('url')} AS id, *, {sk()} AS sk FROM (
        SELECT o_orderpriority AS source, 'Orders · ' || o_orderpriority AS source_label,
               'Order ' || o_orderkey AS title, '{t.SITE}/orders/' || o_orderkey AS url,
               CASE o_orderkey % 50 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE {day('o_orderdate')} END
                   AS published,
               CASE WHEN o_orderkey % 50 <> 1 THEN {day('o_orderdate')} END AS first_seen,
               CASE WHEN o_orderstatus = 'P' THEN ''
                    ELSE 'Customer ' || o_custkey || ' status ' || o_orderstatus END AS summary,
               '{fv.FALLBACK_CATEGORY}' AS category, [o_orderstatus] AS tags, o_orderkey AS ord
        FROM orders))"""

ENTRIES = f"""entries AS (
    SELECT doc_id, source AS repo,
           chr(160) || ' Document ' || doc_id || ' in ' || lang || {NL} AS title,
           '{t.SITE}/post/' || doc_id AS url, {NO_TEXT} AS published, text AS summary,
           CASE WHEN lang = 'en' THEN [lang, source] END AS tags FROM documents)"""

DESCRIBED = f"""described AS (
    SELECT page_id, '{t.SITE}/post/' || page_id AS url,
           CASE WHEN page_id % 4 < 2
                THEN 'Page ' || page_id || ' &lt;b&gt; &amp;amp; more' END AS description
    FROM pages)"""

LINKS = f"""named AS (
    SELECT o_orderkey, o_orderpriority, year(o_orderdate) AS y, month(o_orderdate) AS m,
           strftime(o_orderdate, '%B') AS name FROM orders),
links AS (
    SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month,
           'order-' || o_orderkey AS slug,
           'Order ' || o_orderkey || ' "' || o_orderpriority || '"' AS title,
           '{t.SITE}/aws/en/release-notes/product/' || y || '/' || lower(name)
               || '#order-' || o_orderkey AS url
    FROM named WHERE o_orderpriority <> '1-URGENT'
    UNION ALL
    SELECT CAST(y AS INTEGER), CAST(m AS INTEGER), 'order-' || o_orderkey, 'Upper & bare',
           '{t.SITE}/aws/en/release-notes/product/' || y || '/' || upper(name)
               || '#order-' || o_orderkey
    FROM named WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))"""

SECTIONS = f"""sections AS (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
           CAST(month(o_orderdate) AS INTEGER) AS month, 'order-' || o_orderkey AS slug,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'Repeated ' || o_orderkey
                ELSE CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN 'No date' || {NL} ELSE '' END
                     || 'no id' || {NL} || {NL} || '- Total ' || o_custkey || {NL} || {NL}
                     || '- Status & ' || o_orderstatus END AS body,
           CASE WHEN o_orderstatus = 'F' THEN {day('o_orderdate')} END AS exact_date
    FROM orders
    UNION ALL
    SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER),
           'end', 'tail', {NO_TEXT} FROM orders)"""

STORED = f"""stored AS (
    SELECT {month()} AS month, id, source, title, url, published, 1 AS batch, ord AS pos
    FROM order_items),
incoming AS (
    SELECT month, id, title || ' (updated)' AS title, published, 2 AS batch, pos
    FROM stored WHERE source = '1-URGENT'
    UNION ALL
    SELECT month, {ident("url || '/again'")}, title, published, 2, pos
    FROM stored WHERE source = '1-URGENT')"""

MERGED_EVENTS = f"""{SIGHTINGS}, {SEEN_ITEMS}, {LEDGER},
stored AS (
    SELECT id, arg_max(url, ord) AS url, arg_max(published, ord) AS published,
           '{c.LEDGER_DAY}' AS first_seen, 0 AS batch, min(ord) AS ord FROM seen_items
    WHERE run_date >= '{c.LIVE_SINCE}' AND run_date < '{c.SPLIT_DAY}' GROUP BY id),
fresh AS (
    SELECT * FROM seen_items
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1),
merged AS (
    SELECT *, {sk()} AS sk FROM (
        SELECT id, url, published, first_seen, batch, ord FROM stored
        UNION ALL
        SELECT f.id, f.url, f.published, coalesce(l.first_seen, '{c.EVENTS_AS_OF}'), 1, f.ord
        FROM fresh f LEFT JOIN ledger l USING (id)
        WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.id = f.id))),
live AS (
    SELECT * FROM merged
    WHERE sk >= {day(f"DATE '{c.EVENTS_AS_OF}' - {c.EVENTS_AGE}")}
    ORDER BY sk DESC, batch, ord LIMIT {fv.MAX_ITEMS})"""

ITEM_LIST = ("id, source, source_label, title, url, published, first_seen, summary, category, "
             "tags")


def document_items(prefix: str, source: str, label: str, title: str, tags: str, summary: str,
                   published: str = NO_TEXT, url: str = "url", hints=None) -> str:
    """Normalized items of the documents as a chain of views that ends in `items`."""
    by_rules = category("title || ' ' || summary")
    chosen = f"coalesce({hint('repo', hints)}, {by_rules})" if hints else by_rules
    return f"""{prefix}, staged AS (
    SELECT {ident(url)} AS id, {source} AS source, {label} AS source_label,
           {strip(title)} AS title, {url} AS url, {published} AS published,
           {NO_TEXT} AS first_seen, {strip(summary)} AS summary, {tags} AS tags, repo
    FROM entries),
items AS (
    SELECT id, source, source_label, title, url, published, first_seen, summary,
           {chosen} AS category, coalesce({joined('tags')}, '') AS tags FROM staged)"""


BLOG = (f"'{fv.SOURCE_BLOG}'", f"'{fv.LABEL_BLOG}'")
RELEASE = (f"'{fv.SOURCE_RELEASES}'", f"'{fv.LABEL_RELEASES_PREFIX}' || repo")


def with_cut(prefix: str, source: str, key: str, expression: str, target: str) -> str:
    """Select key and the truncated plain text of an expression."""
    return (f"{prefix} SELECT {key}, {cut('full_text')} AS {target} FROM "
            f"(SELECT {key}, {expression} AS full_text FROM {source})")


def three_sources(until: str | None = None) -> str:
    """Views `docs_in`, `pages_in`, `orders_in`: the items of a run's three sources."""
    return f"""{ENTRIES}, {ORDER_ITEMS},
docs_in AS (
    SELECT {ident('url')} AS id, {BLOG[0]} AS source, {strip('title')} AS title, url,
           published, {category(strip('title') + " || ' ' || " + strip('summary'))} AS category,
           coalesce({joined('tags')}, '') AS tags, '000000|documents' AS origin, doc_id AS pos
    FROM entries),
page_texts AS (SELECT page_id, url, {plain('html')} AS full_text FROM pages),
page_cut AS (SELECT page_id, url, {cut('full_text')} AS summary FROM page_texts),
pages_in AS (
    SELECT {ident('url')} AS id, '{fv.SOURCE_NOTES}' AS source, 'Page ' || page_id AS title, url,
           {NO_TEXT} AS published,
           {category("'Page ' || page_id || ' ' || summary")} AS category,
           {APPROX} AS tags, '000001|pages' AS origin, page_id AS pos FROM page_cut),
orders_in AS (
    SELECT id, source, title, url, published, category, {joined('tags')} AS tags,
           '000002|orders' AS origin, ord AS pos, first_seen AS fetched_on FROM order_items)"""


def two_runs() -> str:
    """Views for the state after the catalog's two daily runs."""
    def cutoff(as_of: str) -> str:
        return day(f"DATE '{as_of}' - {fv.MAX_AGE_DAYS}")

    def fetched(run: int, as_of: str) -> str:
        columns = "id, source, title, published, category, origin, pos"
        return f"""fetched{run} AS (
    SELECT {columns} FROM docs_in UNION ALL SELECT {columns} FROM pages_in
    UNION ALL SELECT {columns} FROM orders_in
    WHERE {run} = 2 OR coalesce(fetched_on, '') <= '{as_of}')"""

    def live(run: int, as_of: str) -> str:
        return f"""live{run} AS (
    SELECT * FROM merged{run} WHERE sk >= {cutoff(as_of)}
    ORDER BY sk DESC, batch, origin, pos LIMIT {fv.MAX_ITEMS}),
out{run} AS (SELECT *, {month()} AS month FROM merged{run}
             WHERE id NOT IN (SELECT id FROM live{run}))"""

    first, second = c.FIRST_RUN, c.SECOND_RUN
    return f"""{three_sources()}, {fetched(1, first)}, {fetched(2, second)},
merged1 AS (
    SELECT *, {sk()} AS sk FROM (SELECT *, '{first}' AS first_seen, 1 AS batch FROM fetched1)),
{live(1, first)},
merged2 AS (
    SELECT *, {sk()} AS sk FROM (
        SELECT id, source, title, published, category, origin, pos, first_seen, batch FROM live1
        UNION ALL
        SELECT f.*, CASE WHEN f.id IN (SELECT id FROM fetched1) THEN '{first}'
                         ELSE '{second}' END, 2
        FROM fetched2 f WHERE f.id NOT IN (SELECT id FROM live1))),
{live(2, second)}"""


def recent_notes(names: str, sentence: str) -> str:
    """Views `recent` and `enriched`: links with the sections of the recent months."""
    return f"""recent AS (
    SELECT * FROM sections WHERE year * 12 + month BETWEEN 1999 * 12 + 11 AND 2000 * 12 + 2),
enriched AS (
    SELECT l.*, coalesce(nullif(r.body, ''), '{sentence.replace("|| year ||", "|| l.year ||")}') AS summary,
           coalesce(r.exact_date, {day('last_day(make_date(l.year, l.month, 1))')}) AS published,
           CASE WHEN r.exact_date IS NULL THEN {APPROX} ELSE '' END AS tags
    FROM (SELECT *, {names}[month] AS name FROM links) l
    LEFT JOIN recent r ON l.year = r.year AND l.month = r.month AND l.slug = r.slug)"""


# --- queries ------------------------------------------------------------------------------------

def oracle_sql() -> dict[str, str]:
    keywords = [k for _, ks in fv.CATEGORY_RULES for k in ks]
    keyword_list = "[" + ", ".join(f"'{k}'" for k in keywords) + "]"
    names = "[" + ", ".join(f"'{m}'" for m in fv.MONTH_NAMES) + "]"
    sentence = fv.NOTES_SUMMARY_FORMAT.replace("%s", "' || name || '").replace(
        "%d", "' || year || '")
    title_case = ("array_to_string([upper(substr(w, 1, 1)) || substr(w, 2) "
                  "for w in string_split(keyword, ' ')], ' ')")
    meta_text = entities("d.description")

    sql = {
        "url_id": f"SELECT page_id, url, {ident('url')} AS id FROM pages",
        "html_to_text": with_cut("", "pages", "page_id", plain("html"), "text"),
        "truncate_summary": f"SELECT doc_id, {cut('text')} AS summary FROM documents",
        "drop_trailer_lines": f"""
            SELECT doc_id, {strip(f'''array_to_string([x for x in string_split(body, {NL})
                if NOT regexp_matches({strip('x')},
                    '(?i)^(Co-authored-by|Signed-off-by|Reviewed-by):')], {NL})''')} AS body
            FROM (SELECT doc_id, 'Reviewed-by: one' || {NL} || text || {NL}
                    || '  CO-AUTHORED-BY: two' || {NL} || 'kept by: x' || {NL}
                    || 'Signed-off-by : kept' || {NL} || chr(9) || 'signed-off-by:three' || {NL}
                    AS body FROM documents)""",
        "leading_date": f"""
            SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {day('o_orderdate')} END
                       AS exact_date, 'Order ' || o_orderkey AS body FROM orders""",
        "date_fallback": f"""
            SELECT o_orderkey,
                   CASE WHEN o_orderstatus = 'F' THEN 'Body ' || o_orderkey
                        ELSE '{sentence}' END AS summary,
                   CASE WHEN o_orderstatus = 'F' THEN {day('o_orderdate')}
                        ELSE {day('last_day(o_orderdate)')} END AS published,
                   CASE WHEN o_orderstatus = 'F' THEN '' ELSE {APPROX} END AS tags
            FROM (SELECT *, year(o_orderdate) AS year, {names}[month(o_orderdate)] AS name
                  FROM orders)""",
        "month_bucket": f"WITH {ORDER_ITEMS} SELECT id, {month()} AS month FROM order_items",
        "feed_dates": f"""
            SELECT o_orderkey,
                   CASE o_orderstatus
                        WHEN 'F' THEN strftime(o_orderdate, '%a, %d %b %Y') || ' 23:30:00 -0500'
                        WHEN 'O' THEN {day('o_orderdate')} || 'T01:15:00.5+02:00'
                        ELSE 'soon' END AS stamp,
                   CASE o_orderstatus WHEN 'F' THEN {day('o_orderdate + INTERVAL 1 DAY')}
                        WHEN 'O' THEN {day('o_orderdate - INTERVAL 1 DAY')} END AS day
            FROM orders""",
        "recent_months": f"""
            SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year,
                   CAST(month(o_orderdate) AS INTEGER) AS month FROM orders
            WHERE date_trunc('month', o_orderdate) IN (
                SELECT unnest(generate_series(
                    date_trunc('month', DATE '{c.NOTES_AS_OF}') - INTERVAL 3 MONTH,
                    date_trunc('month', DATE '{c.NOTES_AS_OF}'), INTERVAL 1 MONTH)))""",

        "categorize": f"""
            WITH {ENTRIES} SELECT doc_id, coalesce({hint('repo', t.PROSE_HINTS)},
                {category("title || ' ' || summary", t.PROSE_RULES, t.PROSE_FALLBACK)})
                AS category FROM entries""",
        "categorize_taxonomy": f"""
            WITH titled AS (
                SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'News x' ELSE 'News (' END
                       || {title_case} || 's)' AS title
                FROM (SELECT *, {keyword_list}[doc_id % {len(keywords)} + 1] AS keyword
                      FROM documents))
            SELECT doc_id, title, {category("title || ' ' || text")} AS category FROM titled""",
        "categorize_hints_table": f"""
            SELECT doc_id, source, coalesce(n_name, '{t.PROSE_FALLBACK}') AS category
            FROM documents LEFT JOIN nation ON source = 'src' || (n_nationkey * 2)""",

        "normalize_items": f"""WITH {document_items(ENTRIES, *BLOG, 'title', 'tags', 'summary')}
            SELECT {ITEM_LIST} FROM items""",
        "normalize_releases": f"""WITH {document_items(
            ENTRIES, *RELEASE, "repo || ': ' || title", '[repo]', 'summary',
            hints=t.PROSE_HINTS)} SELECT {ITEM_LIST} FROM items""",

        "page_links": f"""
            WITH found AS (
                SELECT page_id, unnest(regexp_extract_all(html, '{c.ANCHOR.replace("'", "''")}', 1))
                           AS href,
                       unnest(regexp_extract_all(html, '{c.ANCHOR.replace("'", "''")}', 2))
                           AS inner_html,
                       unnest(range(len(regexp_extract_all(html,
                           '{c.ANCHOR.replace("'", "''")}', 0)))) AS pos
                FROM pages),
            titled AS (
                SELECT page_id, href, pos, {strip(entities(
                    "regexp_replace(regexp_replace(inner_html, '(?s)<!--.*?-->', '', 'g'), "
                    "'<[^>]+>', '', 'g')"))} AS title
                FROM (SELECT * FROM found QUALIFY row_number() OVER (
                        PARTITION BY page_id, href ORDER BY pos) = 1))
            SELECT page_id, href, pos, title FROM titled WHERE title <> ''""",
        "note_links": f"WITH {LINKS} SELECT year, month, slug, title, url FROM links",
        "page_sections": f"""
            WITH split AS (
                SELECT page_id, regexp_extract_all(html, '{c.PAGE_HEADING}', 1) AS slugs,
                       regexp_split_to_array(html, '{c.PAGE_HEADING}') AS texts FROM pages),
            numbered AS (
                SELECT *, unnest(range(len(slugs))) AS pos FROM split)
            SELECT page_id, pos, slugs[pos + 1] AS slug,
                   CASE WHEN pos = len(slugs) - 1
                        THEN substr(texts[pos + 2], 1, {fv.LAST_SECTION_CHARS})
                        ELSE texts[pos + 2] END AS section
            FROM numbered""",
        "month_sections": f"""WITH {SECTIONS}
            SELECT year, month, slug, body, exact_date FROM sections""",
        "meta_description": f"WITH {DESCRIBED} SELECT page_id, description FROM described",
        "enrich_summary": f"""
            WITH {ENTRIES}, {DESCRIBED},
            cleaned AS (SELECT doc_id, url, {plain('summary')} AS teaser FROM entries)
            SELECT e.doc_id, e.url, coalesce({meta_text}, {cut('e.teaser')}) AS summary
            FROM cleaned e LEFT JOIN described d USING (url)""",
        "enrich_links": f"""
            WITH {LINKS}, {SECTIONS},
            {recent_notes(names, sentence)}
            SELECT {ident('url')} AS id, '{fv.SOURCE_NOTES}' AS source,
                   '{fv.LABEL_NOTES}' AS source_label, title, url, published,
                   {NO_TEXT} AS first_seen, summary,
                   {category("title || ' ' || summary")} AS category, tags
            FROM enriched""",

        "dedupe_first": f"""WITH {SIGHTINGS}
            SELECT id, url, run_date, published, source, ord FROM sightings
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1""",
        "dedupe_last": f"""WITH {SIGHTINGS}
            SELECT id, url, run_date, published, source, ord FROM sightings
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord DESC) = 1""",
        "dedupe_last_in_place": f"""WITH {SIGHTINGS}
            SELECT id, url, run_date, published, source, first_ord AS ord, ord AS event
            FROM (SELECT *, min(ord) OVER (PARTITION BY id) AS first_ord FROM sightings)
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY event DESC) = 1""",
        "new_items": f"""WITH {SIGHTINGS}, {SEEN_ITEMS}
            SELECT f.id, f.url, f.source, f.published, f.first_seen, f.ord FROM seen_items f
            WHERE NOT EXISTS (SELECT 1 FROM seen_items s
                              WHERE s.id = f.id AND s.run_date < '{c.SPLIT_DAY}')""",
        "seen_ledger": f"""WITH {SIGHTINGS}
            SELECT id, min(run_date) AS first_seen FROM sightings GROUP BY id""",
        "assign_first_seen": f"""WITH {SIGHTINGS}, {SEEN_ITEMS}, {LEDGER}
            SELECT f.id, f.url, f.source, f.published,
                   coalesce(l.first_seen, '{c.EVENTS_AS_OF}') AS first_seen, f.ord,
                   l.id IS NOT NULL AS known
            FROM seen_items f LEFT JOIN ledger l USING (id)""",
        "ledger_roundtrip": f"""WITH {SIGHTINGS}, {LEDGER}
            SELECT id, coalesce(l.first_seen, '{c.EVENTS_AS_OF}') AS first_seen
            FROM (SELECT DISTINCT id FROM sightings) LEFT JOIN ledger l USING (id)""",
        "merge_live": f"""WITH {MERGED_EVENTS}
            SELECT id, url, published, first_seen, batch, ord, sk FROM live""",
        "merge_archive": f"""WITH {MERGED_EVENTS}
            SELECT id, url, published, first_seen, batch, ord, sk FROM merged
            WHERE id NOT IN (SELECT id FROM live)""",

        "retention_live": f"""WITH {ORDER_ITEMS}
            SELECT id, sk, ord FROM order_items
            WHERE sk >= {day(f"DATE '{c.ORDERS_AS_OF}' - {c.ORDERS_AGE}")}
            ORDER BY sk DESC, ord LIMIT {c.ORDERS_CAP}""",
        "retention_archive": f"""WITH {ORDER_ITEMS}, live AS (
                SELECT id FROM order_items
                WHERE sk >= {day(f"DATE '{c.ORDERS_AS_OF}' - {c.ORDERS_AGE}")}
                ORDER BY sk DESC, ord LIMIT {c.ORDERS_CAP})
            SELECT id, sk, ord FROM order_items WHERE id NOT IN (SELECT id FROM live)""",
        "retention_large_cap": f"""WITH {ORDER_ITEMS}
            SELECT id, sk, ord, CASE WHEN row_number() OVER (ORDER BY sk DESC, ord) <= 5000
                                     THEN 'live' ELSE 'archive' END AS placement
            FROM order_items""",
        "retention_age_only": f"""WITH {ORDER_ITEMS}
            SELECT id, sk, ord,
                   CASE WHEN sk >= {day(f"DATE '{c.ORDERS_AS_OF}' - {c.ORDERS_AGE}")}
                        THEN 'live' ELSE 'archive' END AS placement FROM order_items""",

        "archive_upsert": f"""WITH {ORDER_ITEMS}, {STORED}
            SELECT month, id, title, published, CAST(first_batch AS BIGINT) AS batch, pos
            FROM (SELECT *, min(batch) OVER (PARTITION BY month, id) AS first_batch
                  FROM (SELECT month, id, title, published, batch, pos FROM stored
                        UNION ALL SELECT * FROM incoming))
            QUALIFY row_number() OVER (PARTITION BY month, id ORDER BY batch DESC) = 1""",
        "archive_new_count": f"""WITH {ORDER_ITEMS}, {STORED}
            SELECT count(*) AS new_count FROM (
                SELECT DISTINCT month, id FROM incoming
                EXCEPT SELECT month, id FROM stored)""",
        "archive_manifest": f"""WITH {ORDER_ITEMS}
            SELECT {month()} AS month, count(*) AS count FROM order_items GROUP BY 1""",
        "archive_month": f"""WITH {ORDER_ITEMS}, {STORED}
            SELECT month, id, title, published, CAST(batch AS BIGINT) AS batch, pos FROM stored
            WHERE month = '1997-03'""",

        "latest_update": f"""WITH {SIGHTINGS}, seen AS (
                SELECT id, min(run_date) AS first_seen FROM sightings GROUP BY id)
            SELECT id, first_seen FROM seen
            WHERE first_seen = (SELECT max(first_seen) FROM seen)""",
        "filter_source_date": f"""WITH {ORDER_ITEMS}
            SELECT id, source, published, first_seen FROM order_items
            WHERE source IN ('1-URGENT', '5-LOW') AND sk BETWEEN '1997-02-10' AND '1998-03-20'""",
        "item_dates": f"""WITH {ORDER_ITEMS}, odd AS (
                SELECT id, first_seen, CASE WHEN source = '5-LOW' AND published IS NOT NULL
                                            THEN substr(published, 1, 8) || '32'
                                            ELSE published END AS published FROM order_items)
            SELECT id, published, {day('try_cast(published AS DATE)')} AS published_date,
                   {day('try_cast(first_seen AS DATE)')} AS first_seen_date FROM odd""",
        "publish_items": f"""WITH {ORDER_ITEMS}
            SELECT id, source, source_label, title, url, published, first_seen, summary, category,
                   {joined('tags')} AS tags, '{c.GENERATED_AT}' AS generated_at
            FROM order_items""",
        "store_roundtrip": f"""WITH {document_items(ENTRIES, *BLOG, 'title', 'tags', 'summary')}
            SELECT {ITEM_LIST} FROM items""",

        "scan_rss": f"""WITH {ENTRIES.replace(
                NO_TEXT + ' AS published',
                day("DATE '2026-01-01' + CAST(doc_id % 200 AS INTEGER) + 1") + ' AS published')},
            texts AS (SELECT *, {plain('summary')} AS full_text FROM entries),
            {document_items('cut_texts AS (SELECT * REPLACE (' + cut('full_text')
                            + ' AS summary) FROM texts)', *BLOG, 'title', 'tags', 'summary',
                            published='published').replace('FROM entries', 'FROM cut_texts')}
            SELECT {ITEM_LIST} FROM items""",
        "scan_atom": f"""WITH {ENTRIES},
            texts AS (
                SELECT *, {plain(f"'<p>' || replace(summary, '&', '+') || '</p>Signed-off-by: someone'")}
                       AS full_text FROM entries),
            cut_texts AS (SELECT *, {cut('full_text')} AS shortened FROM texts),
            {document_items('bodies AS (SELECT * REPLACE (' + strip(f'''array_to_string(
                [x for x in string_split(shortened, {NL})
                 if NOT regexp_matches({strip('x')}, '(?i)^Signed-off-by:')], {NL})''')
                            + ' AS summary) FROM cut_texts)', *RELEASE,
                            "repo || ': ' || " + strip('title'), '[repo]', 'summary',
                            published="'2026-05-02'", hints=t.PROSE_HINTS)
             .replace('FROM entries', 'FROM bodies')}
            SELECT {ITEM_LIST} FROM items""",
        "scan_repo_listing": """
            SELECT 'org' || c_nationkey || '/' || c_name AS full_name FROM customer
            WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal >= 0""",
        "repo_union": """
            WITH mentions AS (
                SELECT r_name AS full_name, 0 AS side, 'r' AS origin, r_regionkey AS pos
                FROM region
                UNION ALL
                SELECT r_name, 0, 's', n_nationkey FROM nation
                JOIN region ON n_regionkey = r_regionkey
                UNION ALL SELECT n_name, 1, 'n', n_nationkey FROM nation
                UNION ALL SELECT r_name, 1, 'n', r_regionkey + 100 FROM region)
            SELECT full_name, side, origin, CAST(pos AS BIGINT) AS pos FROM mentions
            QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY side, origin, pos) = 1""",
        "union_sources": f"""WITH {three_sources()}
            SELECT id, source, title, url, published, category, tags, origin, pos FROM docs_in
            UNION ALL
            SELECT id, source, title, url, published, category, tags, origin, pos FROM pages_in
            UNION ALL
            SELECT id, source, title, url, published, category, tags, origin, pos
            FROM orders_in""",
        "source_status": """
            SELECT 'documents' AS source, 'ok' AS status, count(*) AS n FROM documents
            UNION ALL SELECT 'pages', 'ok', count(*) FROM pages
            UNION ALL SELECT 'absent', 'missing', 0
            UNION ALL SELECT 'orders', 'ok', count(*) FROM orders""",

        "landed_run": f"""
            WITH {ENTRIES},
            posts AS (
                SELECT e.*, {day("DATE '2026-01-01' + CAST(doc_id % 200 AS INTEGER) + 1")} AS day,
                       {plain('summary')} AS teaser FROM entries e),
            blog AS (
                SELECT '{t.SITE}/post/' || doc_id AS link, {strip('title')} AS title, day,
                       CASE doc_id WHEN 1 THEN 'Post 1 & its <b>page</b>' WHEN 2 THEN 'Post 2'
                                   ELSE {cut('teaser')} END AS summary FROM posts
                UNION ALL SELECT '{t.SITE}/late', 'Late & last', '2026-07-04', ''),
            watched AS (
                SELECT 'src' || n_nationkey AS repo FROM nation
                WHERE NOT (n_nationkey % 2 = 0 AND n_nationkey % 5 = 4) AND n_nationkey % 7 <> 3
                UNION SELECT unnest({c.landed.CONFIGURED})),
            bodies AS (
                SELECT doc_id, repo, title, CASE doc_id % 3
                    WHEN 0 THEN {plain("'<p>' || translate(summary, '&<', '+(') || '</p>Signed-off-by: someone'")}
                    ELSE {plain("translate(summary, '&<', '+(')")} END AS full_text
                FROM entries SEMI JOIN watched USING (repo)),
            shortened AS (SELECT *, {cut('full_text')} AS short FROM bodies),
            releases AS (
                SELECT '{t.SITE}/release/' || doc_id AS link, repo || ': ' || {strip('title')} AS title,
                       {strip(f"""array_to_string([x for x in string_split(short, {NL})
                           if NOT regexp_matches({strip('x')}, '(?i)^Signed-off-by:')], {NL})""")} AS summary
                FROM shortened),
            {LINKS}, {SECTIONS}, {recent_notes(names, sentence)}
            SELECT 'item' AS kind, '{fv.SOURCE_BLOG}' AS source, {ident('link')} AS name, title,
                   day AS published, {strip('summary')} AS summary, CAST(NULL AS BIGINT) AS records,
                   CAST(NULL AS BIGINT) AS unusable FROM blog
            UNION ALL
            SELECT 'item', '{fv.SOURCE_RELEASES}', {ident('link')}, title, '2026-05-02', summary, NULL, NULL
            FROM releases
            UNION ALL
            SELECT 'item', '{fv.SOURCE_NOTES}', {ident('url')}, title, published, summary, NULL, NULL
            FROM enriched
            UNION ALL SELECT 'document', 'blog', 'ok', NULL, NULL, NULL, count(*) + 3, 2 FROM documents
            UNION ALL SELECT 'document', 'blog', 'unreadable', NULL, NULL, NULL, 0, 0
            UNION ALL SELECT 'document', 'posts', 'ok', NULL, NULL, NULL, 3, 0
            UNION ALL SELECT 'document', 'releases', 'ok', NULL, NULL, NULL, count(*), 0 FROM documents
            UNION ALL SELECT 'document', 'repos', 'ok', NULL, NULL, NULL, count(*) + 2, 2 FROM nation
            UNION ALL SELECT 'source', '{fv.SOURCE_BLOG}', 'ok', '', NULL, NULL, NULL, NULL
            UNION ALL SELECT 'source', '{fv.SOURCE_RELEASES}', 'ok', '', NULL, NULL, NULL, NULL
            UNION ALL SELECT 'source', '{fv.SOURCE_NOTES}', 'ok', '', NULL, NULL, NULL, NULL""",

        "run_summary": f"""WITH {two_runs()},
            counts AS (
                SELECT 1 AS batch, '{c.FIRST_RUN}' AS as_of,
                       (SELECT count(*) FROM live1) AS live,
                       (SELECT count(*) FROM live1) AS net_new,
                       (SELECT count(*) FROM out1) AS outside_window,
                       (SELECT count(*) FROM out1) AS newly_archived
                UNION ALL
                SELECT 2, '{c.SECOND_RUN}', (SELECT count(*) FROM live2),
                       (SELECT count(*) FROM live2) - (SELECT count(*) FROM live1),
                       (SELECT count(*) FROM out2),
                       (SELECT count(*) FROM (SELECT month, id FROM out2
                                              EXCEPT SELECT month, id FROM out1))),
            per_source AS (
                SELECT 1 AS batch, source, count(*) AS fetched FROM fetched1 GROUP BY source
                UNION ALL SELECT 2, source, count(*) FROM fetched2 GROUP BY source)
            SELECT CAST(batch AS BIGINT) AS batch, as_of, source, fetched, live, net_new,
                   outside_window, newly_archived
            FROM counts JOIN per_source USING (batch)""",
        "daily_run": f"""WITH {two_runs()},
            archived AS (
                SELECT * FROM out2 UNION ALL
                SELECT * FROM out1 o
                WHERE NOT EXISTS (SELECT 1 FROM out2 n WHERE n.month = o.month AND n.id = o.id))
            SELECT id, source, title, published, first_seen, category, 'live' AS place FROM live2
            UNION ALL
            SELECT id, source, title, published, first_seen, category, month FROM archived""",
    }
    feed = f"""WITH {ORDER_ITEMS}
        SELECT '[' || source_label || '] ' || title AS title, url AS link, url AS guid,
               nullif(summary, '') AS description,
               strftime(CAST(nullif(sk, '') AS DATE), '%a, %d %b %Y 00:00:00 +0000') AS pubDate
        FROM order_items ORDER BY sk DESC, ord LIMIT {fv.FEED_ITEMS}"""
    by_prose = f"""SELECT doc_id, {category('text', t.PROSE_RULES, t.PROSE_FALLBACK)} AS category
        FROM documents"""
    return sql | {
        "feed_top_n": feed, "publish_feed": feed,
        "categorize_rules_table": by_prose, "categorize_rules_join": by_prose,
    }
