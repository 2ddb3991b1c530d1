"""One query per operator over the test tables. Each reads its tables whole."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidings import fixed_values as fv
from tidings.functions import dates, text as tx
from tidings.operators import (
    archive as ar, classify, dedupe, extract, ledger, merge as mg, normalize, notes, publish,
    retention,
)
from tidings.plans import daily, landed, tables as t
from tidings.schema import ITEM, ITEM_COLUMNS, STORED_ITEM
from tidings.shared import materialize, new_path
from tidings.sources import feeds, listings, sinks, status, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORD = ["ord"]
SPLIT_DAY = "2024-01-15"          # sightings before it are live, all are fetched again
LEDGER_DAY = "2024-01-12"         # sightings before it are in the ledger
LIVE_SINCE = "2024-01-08"         # older ones were archived
EVENTS_AS_OF, EVENTS_AGE = "2024-02-01", 20
ORDERS_AS_OF, ORDERS_AGE, ORDERS_CAP = "1999-06-30", 90, 60
NOTES_AS_OF = "2000-02-10"
FIRST_RUN, SECOND_RUN = "2001-06-30", "2001-08-01"     # the second fetches everything
GENERATED_AT = "2026-07-30T06:00:00+00:00"

ANCHOR = r"""(?is)<a[^>]*href=["']?([^"'>]+)["']?[^>]*>(.*?)</a>"""
PAGE_HEADING = r"(?i)<(nav|h1|p|footer)>"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def flat(items: DataFrame, *columns: str) -> DataFrame:
    """Project, with tags as one string."""
    tags = F.array_join("tags", "|").alias("tags")
    return items.select(*[tags if c == "tags" else F.col(c) for c in columns])


def flat_items(items: DataFrame) -> DataFrame:
    return flat(items, *ITEM_COLUMNS)


# --- scalars ------------------------------------------------------------------------------------

@query
def url_id(spark, sf_dir):
    pages = t.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", tx.url_id(F.col("url")).alias("id"))


@query
def html_to_text(spark, sf_dir):
    pages = t.texts(spark, sf_dir, "pages").select("page_id", "html")
    return tx.with_plain_text(pages, "html", "text").select("page_id", "text")


@query
def truncate_summary(spark, sf_dir):
    documents = t.texts(spark, sf_dir, "documents")
    return documents.select("doc_id", tx.truncate_text(F.col("text")).alias("summary"))


@query
def drop_trailer_lines(spark, sf_dir):
    body = t.text_of("Reviewed-by: one\n", F.col("text"), "\n  CO-AUTHORED-BY: two\nkept by: x\n",
                     "Signed-off-by : kept\n\tsigned-off-by:three\n")
    return t.texts(spark, sf_dir, "documents").select(
        "doc_id", tx.drop_trailer_lines(body).alias("body"))


@query
def leading_date(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "P", F.lit("Smarch")).otherwise(
        F.date_format("o_orderdate", "MMMM"))
    gap = F.when(F.col("o_orderstatus") == "F", F.lit("\n\n")).otherwise(F.lit(" \n"))
    body = t.text_of(name, F.date_format("o_orderdate", " d, yyyy"), gap, "Order ",
                     F.col("o_orderkey"))
    lines = t.texts(spark, sf_dir, "orders").select("o_orderkey", body.alias("text"))
    return lines.select("o_orderkey", dates.leading_date(F.col("text")).alias("exact_date"),
                        dates.drop_leading_date(F.col("text")).alias("body"))


@query
def date_fallback(spark, sf_dir):
    exact = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", t.DAY))
    body = F.when(F.col("o_orderstatus") == "P", F.lit("")).when(
        F.col("o_orderstatus") == "F", t.text_of("Body ", F.col("o_orderkey")))
    links = t.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        exact.alias("exact_date"), body.alias("body"))
    return flat(notes.with_fallbacks(links), "o_orderkey", "summary", "published", "tags")


@query
def month_bucket(spark, sf_dir):
    return ar.with_month(t.with_sk(t.order_items(spark, sf_dir))).select("id", "month")


@query
def feed_dates(spark, sf_dir):
    stamp = (F.when(F.col("o_orderstatus") == "F",
                    F.date_format("o_orderdate", "EEE, dd MMM yyyy '23:30:00 -0500'"))
             .when(F.col("o_orderstatus") == "O",
                   F.date_format("o_orderdate", "yyyy-MM-dd'T01:15:00.5+02:00'"))
             .otherwise(F.lit("soon")))
    stamped = t.texts(spark, sf_dir, "orders").select("o_orderkey", stamp.alias("stamp"))
    return stamped.select("o_orderkey", "stamp", dates.feed_date(F.col("stamp")).alias("day"))


@query
def recent_months(spark, sf_dir):
    months = t.table(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return notes.recent_pages(months, NOTES_AS_OF).distinct()


# --- classification -----------------------------------------------------------------------------

@query
def categorize(spark, sf_dir):
    entries = t.document_entries(spark, sf_dir)
    text = classify.item_text(F.col("title"), F.col("summary"))
    return classify.with_category(
        entries, text, F.col("repo"), t.PROSE_RULES, t.PROSE_HINTS, t.PROSE_FALLBACK
    ).select("doc_id", "category")


@query
def categorize_taxonomy(spark, sf_dir):
    """The standard rules on texts that mention a keyword, by turns at a word start and inside."""
    keywords = F.array(*[F.lit(k) for _, ks in fv.CATEGORY_RULES for k in ks])
    n = sum(len(ks) for _, ks in fv.CATEGORY_RULES)
    doc = F.col("doc_id")
    keyword = F.element_at(keywords, (doc % n + 1).cast("int"))
    lead = F.when(doc % 3 == 0, F.lit("News x")).otherwise(F.lit("News ("))
    title = t.text_of(lead, F.initcap(keyword), "s)")
    docs = t.texts(spark, sf_dir, "documents").select("doc_id", title.alias("title"), "text")
    text = classify.item_text(F.col("title"), F.col("text"))
    return classify.with_category(docs, text).select("doc_id", "title", "category")


def prose_rules_table(spark) -> DataFrame:
    rows = [(p, c, k) for p, (c, ks) in enumerate(t.PROSE_RULES) for k in ks]
    return spark.createDataFrame(rows, "priority int, category string, keyword string")


@query
def categorize_rules_table(spark, sf_dir):
    docs = t.texts(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify.with_table_category(docs, "doc_id", "text", prose_rules_table(spark),
                                         t.PROSE_FALLBACK)
    return found.select("doc_id", "category")


@query
def categorize_rules_join(spark, sf_dir):
    docs = t.texts(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify.with_joined_category(docs, "doc_id", "text", prose_rules_table(spark),
                                          t.PROSE_FALLBACK)
    return found.select("doc_id", "category")


@query
def categorize_hints_table(spark, sf_dir):
    hints = t.table(spark, sf_dir, "nation").select(
        t.text_of("src", F.col("n_nationkey") * 2).alias("hint"),
        F.col("n_name").alias("category"))
    docs = t.table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.lit(t.PROSE_FALLBACK).alias("category"))
    return classify.with_hint_table(docs, "source", hints).select("doc_id", "source", "category")


# --- normalization ------------------------------------------------------------------------------

@query
def normalize_items(spark, sf_dir):
    return flat_items(normalize.blog_items(t.document_entries(spark, sf_dir)))


@query
def normalize_releases(spark, sf_dir):
    entries = t.document_entries(spark, sf_dir)
    return flat_items(normalize.release_items(entries, hints=t.PROSE_HINTS))


# --- extraction ---------------------------------------------------------------------------------

@query
def page_links(spark, sf_dir):
    pages = t.texts(spark, sf_dir, "pages").select("page_id", "html")
    links = extract.page_links(pages, ANCHOR, ["page_id", "href"], ["pos"])
    return links.select("page_id", "href", "pos", "title")


@query
def note_links(spark, sf_dir):
    links = extract.note_links(t.index_pages(spark, sf_dir), t.SITE, ["origin"])
    return links.select("year", "month", "slug", "title", "url")


@query
def page_sections(spark, sf_dir):
    pages = t.texts(spark, sf_dir, "pages").select("page_id", "html")
    return extract.page_sections(pages, PAGE_HEADING).select("page_id", "pos", "slug", "section")


@query
def month_sections(spark, sf_dir):
    return notes.month_sections(t.month_pages(spark, sf_dir), ["origin"])


@query
def meta_description(spark, sf_dir):
    return t.described_pages(spark, sf_dir).select(
        "page_id", extract.meta_description(F.col("html")).alias("description"))


@query
def enrich_summary(spark, sf_dir):
    entries = t.document_entries(spark, sf_dir).select("doc_id", "url", "summary")
    posts = t.described_pages(spark, sf_dir).select("url", "html")
    return extract.with_post_summary(entries, posts)


@query
def enrich_links(spark, sf_dir):
    links = extract.note_links(t.index_pages(spark, sf_dir), t.SITE, ["origin"])
    recent = notes.recent_pages(t.month_pages(spark, sf_dir), NOTES_AS_OF)
    enriched = notes.enrich_links(links, notes.month_sections(recent, ["origin"]))
    return flat_items(normalize.note_items(enriched))


# --- deduplication, ledger, merge ---------------------------------------------------------------

@query
def dedupe_first(spark, sf_dir):
    return dedupe.keep_first(t.sightings(spark, sf_dir), ["id"], ORD)


@query
def dedupe_last(spark, sf_dir):
    return dedupe.keep_last(t.sightings(spark, sf_dir), ["id"], ORD)


@query
def dedupe_last_in_place(spark, sf_dir):
    return dedupe.last_value_first_place(
        t.sightings(spark, sf_dir).withColumn("event", F.col("ord")), ["id"], ORD)


@query
def new_items(spark, sf_dir):
    fresh = t.first_seen_items(spark, sf_dir)
    return ledger.new_items(fresh, t.first_seen_items(spark, sf_dir, before=SPLIT_DAY))


@query
def seen_ledger(spark, sf_dir):
    return ledger.rebuild_ledger(t.sightings(spark, sf_dir))


def known_before(spark, sf_dir, day: str) -> DataFrame:
    seen = t.sightings(spark, sf_dir)
    return ledger.rebuild_ledger(seen.where(F.col("run_date") < day))


@query
def assign_first_seen(spark, sf_dir):
    return ledger.assign_first_seen(t.first_seen_items(spark, sf_dir),
                                    known_before(spark, sf_dir, LEDGER_DAY), EVENTS_AS_OF)


@query
def ledger_roundtrip(spark, sf_dir):
    """Two appends to the ledger of a store: the known ids first, then what a batch adds."""
    target = store.Store(new_path(spark, "ledger"))
    target.append_ledger(known_before(spark, sf_dir, LEDGER_DAY))
    batch = dedupe.keep_first(t.first_seen_items(spark, sf_dir), ["id"], ORD)
    dated = ledger.assign_first_seen(batch, target.ledger(spark), EVENTS_AS_OF)
    target.append_ledger(ledger.ledger_additions(dated))
    return target.ledger(spark)


def merged_events(spark, sf_dir) -> DataFrame:
    """Live items of a period, with their dates of first sighting, merged with a full refetch."""
    live = t.first_seen_items(spark, sf_dir, since=LIVE_SINCE, before=SPLIT_DAY)
    live = live.withColumn("first_seen", F.lit(LEDGER_DAY))
    fresh = t.first_seen_items(spark, sf_dir)
    placed = [live.withColumn("batch", F.lit(0)), fresh.withColumn("batch", F.lit(1))]
    return mg.merge(*placed, known_before(spark, sf_dir, LEDGER_DAY), EVENTS_AS_OF,
                    ["batch", "ord"])


MERGE_COLUMNS = ["id", "url", "published", "first_seen", "batch", "ord", "sk"]


@query
def merge_live(spark, sf_dir):
    live = retention.live_items(merged_events(spark, sf_dir), EVENTS_AS_OF, fv.MAX_ITEMS,
                                EVENTS_AGE, ["batch", "ord"])
    return live.select(*MERGE_COLUMNS)


@query
def merge_archive(spark, sf_dir):
    merged = materialize(merged_events(spark, sf_dir), "merged")
    rest = retention.archive_items(merged, EVENTS_AS_OF, fv.MAX_ITEMS, EVENTS_AGE,
                                   ["batch", "ord"])
    return rest.select(*MERGE_COLUMNS)


# --- retention ----------------------------------------------------------------------------------

@query
def retention_live(spark, sf_dir):
    items = t.with_sk(t.order_items(spark, sf_dir)).select("id", "sk", "ord")
    return retention.live_items(items, ORDERS_AS_OF, ORDERS_CAP, ORDERS_AGE, ORD)


@query
def retention_archive(spark, sf_dir):
    items = t.with_sk(t.order_items(spark, sf_dir)).select("id", "sk", "ord")
    return retention.archive_items(items, ORDERS_AS_OF, ORDERS_CAP, ORDERS_AGE, ORD)


@query
def retention_large_cap(spark, sf_dir):
    """A cap of a third of the items, without an age test."""
    items = t.with_sk(t.order_items(spark, sf_dir)).select("id", "sk", "ord")
    return retention.with_placement(items, ORDERS_AS_OF, 5000, None, ORD)


@query
def retention_age_only(spark, sf_dir):
    items = t.with_sk(t.order_items(spark, sf_dir)).select("id", "sk", "ord")
    return retention.with_placement(items, ORDERS_AS_OF, None, ORDERS_AGE, ORD)


# --- archive ------------------------------------------------------------------------------------

def stored_orders(spark, sf_dir) -> DataFrame:
    """Order items with the columns of a stored archive."""
    placed = t.order_items(spark, sf_dir).select(
        *ITEM_COLUMNS, F.lit(1).cast("long").alias("batch"), F.lit("orders").alias("origin"),
        F.col("ord").alias("pos"))
    return ar.with_month(t.with_sk(placed)).select(*STORED_ITEM.fieldNames(), "month")


def incoming_orders(spark, sf_dir) -> DataFrame:
    """What a later run sends: updated rows of one priority, and new ids in the same months."""
    known = stored_orders(spark, sf_dir).where(F.col("source") == "1-URGENT")
    known = known.withColumn("batch", F.lit(2).cast("long"))
    updated = known.withColumn("title", t.text_of(F.col("title"), " (updated)"))
    url = t.text_of(F.col("url"), "/again")
    added = known.withColumn("url", url).withColumn("id", tx.url_id(F.col("url")))
    return updated.unionByName(added)


ARCHIVE_COLUMNS = ["month", "id", "title", "published", "batch", "pos"]


@query
def archive_upsert(spark, sf_dir):
    """A written archive, a second run's upsert on its touched months, and the table read back."""
    target = store.Store(new_path(spark, "archive"))
    target.upsert_archive(stored_orders(spark, sf_dir))
    target.upsert_archive(materialize(incoming_orders(spark, sf_dir), "incoming"))
    return target.archive(spark).select(*ARCHIVE_COLUMNS)


@query
def archive_new_count(spark, sf_dir):
    return ar.new_count(stored_orders(spark, sf_dir), incoming_orders(spark, sf_dir))


@query
def archive_manifest(spark, sf_dir):
    return ar.manifest(stored_orders(spark, sf_dir))


@query
def archive_month(spark, sf_dir):
    """One month read from a partitioned archive."""
    path = new_path(spark, "archive")
    store.write_archive(stored_orders(spark, sf_dir), path)
    target = store.read_or_empty(spark, path, store.ARCHIVED_ITEM)
    return ar.month_items(target, "1997-03").select(*ARCHIVE_COLUMNS)


# --- publishing ---------------------------------------------------------------------------------

@query
def latest_update(spark, sf_dir):
    seen = ledger.rebuild_ledger(t.sightings(spark, sf_dir))
    return publish.latest_update(seen)


@query
def filter_source_date(spark, sf_dir):
    items = publish.filter_source_date(t.order_items(spark, sf_dir), ["1-URGENT", "5-LOW"],
                                       "1997-02-10", "1998-03-20")
    return items.select("id", "source", "published", "first_seen")


@query
def item_dates(spark, sf_dir):
    """Derived dates; some days are written impossibly on purpose."""
    items = t.order_items(spark, sf_dir)
    odd = F.when(F.col("source") == "5-LOW", t.text_of(F.substring("published", 1, 8), "32"))
    dated = publish.with_dates(items.withColumn("published", F.coalesce(odd, "published")))
    return dated.select("id", "published",
                        F.date_format("published_date", t.DAY).alias("published_date"),
                        F.date_format("first_seen_date", t.DAY).alias("first_seen_date"))


@query
def feed_top_n(spark, sf_dir):
    return publish.feed_entries(t.order_items(spark, sf_dir), order=ORD)


@query
def publish_items(spark, sf_dir):
    """The site payload as written and read back."""
    path = new_path(spark, "site")
    sinks.write_site(t.order_items(spark, sf_dir), path, GENERATED_AT)
    schema = StructType(ITEM.fields + [StructField("generated_at", StringType())])
    return flat(spark.read.schema(schema).json(path), *ITEM_COLUMNS, "generated_at")


@query
def publish_feed(spark, sf_dir):
    """The feed document as written and read back."""
    path = new_path(spark, "feed")
    items = t.order_items(spark, sf_dir).select(
        *ITEM_COLUMNS, F.lit(1).alias("batch"), F.lit("orders").alias("origin"),
        F.col("ord").alias("pos"))
    sinks.write_feed(items, path)
    return (spark.read.format("xml").option("rowTag", "item")
            .schema("title string, link string, guid string, description string, pubDate string")
            .load(path))


# --- sources ------------------------------------------------------------------------------------

@query
def store_roundtrip(spark, sf_dir):
    """Items written as the live store and read back; a store that is not there adds nothing."""
    items = normalize.blog_items(t.document_entries(spark, sf_dir))
    path = new_path(spark, "live")
    items.write.parquet(path)
    absent = store.read_or_empty(spark, f"{path}-absent", ITEM)
    return flat_items(store.read_or_empty(spark, path, ITEM).unionByName(absent))


def landed_rss(spark, sf_dir) -> str:
    """Documents landed as RSS documents."""
    path = new_path(spark, "rss")
    (landed.rss_rows(spark, sf_dir).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path))
    return path


@query
def scan_rss(spark, sf_dir):
    entries = feeds.scan_rss(spark, landed_rss(spark, sf_dir))
    plain = tx.with_plain_text(entries, "summary", "plain").withColumn("summary", F.col("plain"))
    return flat_items(normalize.blog_items(plain))


def landed_atom(spark, sf_dir) -> str:
    """Documents landed as Atom documents, a folder per repository."""
    def typed(column: str):
        return F.struct(F.col(column).alias("_VALUE"), F.lit("html").alias("_type"))

    link = F.struct(F.col("url").alias("_href"), F.lit("alternate").alias("_rel"))
    body = t.text_of("<p>", F.replace("summary", F.lit("&"), F.lit("+")),
                     "</p>Signed-off-by: someone")
    entries = t.document_entries(spark, sf_dir).withColumn("body", body)
    path = new_path(spark, "atom")
    (entries.select(
        "repo", typed("title").alias("title"),
        F.lit("2026-05-01T23:30:00-05:00").alias("updated"), F.array(link).alias("link"),
        typed("body").alias("content"))
     .write.partitionBy("repo").format("xml").option("rootTag", "feed")
     .option("rowTag", "entry").save(path))
    return path


@query
def scan_atom(spark, sf_dir):
    entries = feeds.scan_atom(spark, landed_atom(spark, sf_dir), r"repo=([^=]+)/[^/]+$")
    return flat_items(normalize.release_items(entries, hints=t.PROSE_HINTS))


@query
def scan_repo_listing(spark, sf_dir):
    """Listing pages landed as JSON, scanned without archived repositories and forks."""
    path = new_path(spark, "listing")
    (t.table(spark, sf_dir, "customer").select(
        t.text_of("org", F.col("c_nationkey"), "/", F.col("c_name")).alias("full_name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment") == "MACHINERY")
        .alias("archived"),
        F.when(F.col("c_acctbal") < 0, F.lit(True)).alias("fork"))
     .write.json(path))
    return listings.scan_repo_listing(spark, path).select("full_name")


@query
def repo_union(spark, sf_dir):
    return listings.repo_union(*t.repo_names(spark, sf_dir))


def table_sources(spark, sf_dir, orders_until: str | None = None) -> dict[str, DataFrame]:
    """Documents, pages and orders as the three sources of a run."""
    docs = t.document_entries(spark, sf_dir).select(
        "*", F.lit("documents").alias("origin"), F.col("doc_id").alias("pos"))
    plain = tx.with_plain_text(t.texts(spark, sf_dir, "pages"), "html", "summary").select(
        F.col("page_id").alias("pos"), F.lit("pages").alias("origin"), "url", "summary",
        t.text_of("Page ", F.col("page_id")).alias("title"),
        F.lit(None).cast("string").alias("published"),
        F.array(F.lit(fv.APPROX_DATE_TAG)).alias("tags"))
    orders = t.order_items(spark, sf_dir)
    if orders_until:
        orders = orders.where(F.coalesce(F.col("first_seen"), F.lit("")) <= orders_until)
    orders = orders.select(*ITEM_COLUMNS, F.lit("orders").alias("origin"),
                           F.col("ord").alias("pos"))
    return {
        "documents": normalize.blog_items(docs, carry=daily.PLACE),
        "pages": normalize.note_items(plain, carry=daily.PLACE),
        "orders": orders.withColumn("first_seen", F.lit(None).cast("string")),
    }


@query
def union_sources(spark, sf_dir):
    return flat(daily.union_sources(table_sources(spark, sf_dir)), "id", "source", "title", "url",
                "published", "category", "tags", "origin", "pos")


@query
def source_status(spark, sf_dir):
    """Three readable sources and a missing one: counts of what each contributed."""
    readers = {
        name: (lambda name=name: t.table(spark, sf_dir, name).select(
            F.lit(name).alias("source")))
        for name in ("documents", "pages", "absent", "orders")}
    frames, states = status.isolate(spark, readers, "source string")
    rows = None
    for frame in frames.values():
        rows = frame if rows is None else rows.unionByName(frame)
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    return states.join(counts, "source", "left").select(
        "source", "status", F.coalesce("n", F.lit(0)).alias("n"))


@query
def landed_run(spark, sf_dir):
    """A whole landing folder, staged: its items, and what the faulty documents in it came to."""
    found = daily.stage_sources(spark, landed.land(spark, sf_dir, NOTES_AS_OF), t.SITE, NOTES_AS_OF,
                                landed.configured(spark), landed.LAYOUT)
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    items = found.items.select(
        F.lit("item").alias("kind"), "source", F.col("id").alias("name"), "title", "published", "summary",
        none.alias("records"), none.alias("unusable"))
    # A page of the notes is as many documents as its writer made parts.
    documents = (found.documents.where(~F.col("input").isin("notes")).groupBy("input", "status")
                 .agg(F.sum("records").alias("records"), F.sum("unusable").alias("unusable"))
                 .select(F.lit("document").alias("kind"), F.col("input").alias("source"),
                         F.col("status").alias("name"), text.alias("title"), text.alias("published"),
                         text.alias("summary"), "records", "unusable"))
    sources = found.sources.select(
        F.lit("source").alias("kind"), "source", F.col("status").alias("name"), F.col("detail").alias("title"),
        text.alias("published"), text.alias("summary"), none.alias("records"), none.alias("unusable"))
    return items.unionByName(documents).unionByName(sources)


# --- pipeline -----------------------------------------------------------------------------------

@query
def run_summary(spark, sf_dir):
    """Counts of a second run, as recorded in the run log."""
    target = store.Store(new_path(spark, "store"))
    two_runs(spark, sf_dir, target)
    runs = target.runs(spark)
    return runs.select(
        "batch", "as_of", F.explode("fetched").alias("source", "fetched"), "live", "net_new",
        "outside_window", "newly_archived")


def two_runs(spark, sf_dir, target: store.Store) -> None:
    for as_of in (FIRST_RUN, SECOND_RUN):
        until = as_of if as_of == FIRST_RUN else None
        fresh = daily.union_sources(table_sources(spark, sf_dir, until))
        daily.daily_run(spark, target, fresh, as_of)


@query
def daily_run(spark, sf_dir):
    """The stores after two daily runs, the second of which fetches everything again."""
    target = store.Store(new_path(spark, "store"))
    two_runs(spark, sf_dir, target)
    columns = ["id", "source", "title", "published", "first_seen", "category"]
    live = target.live(spark).select(*columns, F.lit("live").alias("place"))
    return live.unionByName(
        target.archive(spark).select(*columns, F.col("month").alias("place")))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
