"""The daily run: extract, merge, archive, record."""

from contextlib import closing
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidings import fixed_values as fv
from tidings.operators import archive as ar
from tidings.operators.extract import note_links, with_post_summary
from tidings.operators.ledger import ledger_additions
from tidings.operators.merge import merge
from tidings.operators.normalize import blog_items, note_items, release_items
from tidings.operators.notes import enrich_links, month_pages, month_sections, recent_pages
from tidings.operators.retention import ARCHIVE, LIVE, last_kept, with_placement
from tidings.schema import (
    ARCHIVED_ITEM, ATOM_ENTRY, FRESH_ITEM, ITEM_COLUMNS, ORDER_COLUMNS, PAGE, RSS_ENTRY, STORED_ITEM,
)
from tidings.shared import LEAN, materialize, scratch, settings
from tidings.sources import feeds, listings
from tidings.sources.pages import read_pages
from tidings.sources.reading import empty
from tidings.sources.rows import IN_PLACE, PART, ROW, Rows, with_part
from tidings.sources.staging import OK, Staging, stage
from tidings.sources.status import STATUS
from tidings.sources.store import Store

PLACE = ("origin", "pos")


def blog_source(spark: SparkSession, feed_path: str, posts: DataFrame) -> DataFrame:
    """Landed RSS documents plus the posts' own pages (url, html) -> items."""
    return blog_items(with_post_summary(feeds.scan_rss(spark, feed_path), posts), carry=PLACE)


def release_source(spark: SparkSession, atom_path: str, repos: DataFrame) -> DataFrame:
    """Landed release feeds of the watched repositories -> items."""
    entries = listings.of_repos(feeds.scan_atom(spark, atom_path), repos)
    return release_items(entries, carry=PLACE)


def note_source(index_pages: DataFrame, pages: DataFrame, base_url: str, as_of: str,
                months: int = fv.RECENT_MONTHS) -> DataFrame:
    """Index pages and month pages (url, html) -> release-note items."""
    links = note_links(index_pages.withColumnRenamed("url", "origin"), base_url, ["origin"])
    recent = recent_pages(month_pages(pages), as_of, months)
    sections = month_sections(recent.withColumnRenamed("url", "origin"), ["origin"])
    return note_items(enrich_links(links, sections), carry=PLACE)


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources, in the given order: `origin` is prefixed by the source's ordinal.

    Each frame is items plus (origin, pos).
    """
    whole = None
    for ordinal, frame in enumerate(sources.values()):
        placed = frame.select(
            *ITEM_COLUMNS,
            F.concat(F.lit(f"{ordinal:06d}|"), F.col("origin")).alias("origin"), "pos")
        whole = placed if whole is None else whole.unionByName(placed)
    return whole


def run_summary(existing: DataFrame, fresh: DataFrame, merged: DataFrame,
                newly_archived: DataFrame) -> DataFrame:
    """One row of run counts, all taken with Spark: fetched per source, live, net new, outside the
    window, newly archived. `merged` carries `placement`; `newly_archived` is a one-row count."""
    fetched = (fresh.groupBy("source").agg(F.count("*").alias("n"))
               .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n"))))
                    .alias("fetched")))
    before = existing.agg(F.count("*").alias("n"))
    counts = merged.agg(
        F.count_if(F.col("placement") == LIVE).alias("live"),
        F.count_if(F.col("placement") == ARCHIVE).alias("outside_window"))
    return counts.select(
        fetched.scalar().alias("fetched"), "live",
        (F.col("live") - before.scalar()).alias("net_new"), "outside_window",
        newly_archived.scalar().alias("newly_archived"))


def daily_run(spark: SparkSession, store: Store, fresh: DataFrame, as_of: str,
              max_items: int | None = fv.MAX_ITEMS,
              max_age_days: int | None = fv.MAX_AGE_DAYS,
              stream: tuple[str, int] | None = None) -> DataFrame:
    """Merge one batch (items plus origin, pos) into the store; returns the run's summary row.

    `stream` names the stream and its batch if the items come from one; the run log keeps both.

    The live items and the batch are written to a folder of the run once, because each has several
    readers and the stores they were computed from change below. All that decides where an item goes is done on its key,
    dates and place, which are joined, shuffled and written; the items are picked by number when a store is
    written. The folder goes when the run ends, however it ends. Order of the writes: archive, ledger, live, then the
    run log that makes the run count. What was replaced long enough ago is deleted last.
    """
    previous = store.last_run(spark)
    batch = previous["batch"] + 1 if previous else 1
    existing = store.live(spark)
    fresh = fresh.withColumn("batch", F.lit(batch).cast("long")).select(*STORED_ITEM.fieldNames())
    both = (existing.withColumn("stored", F.lit(True))
            .unionByName(fresh.withColumn("stored", F.lit(False))))
    with scratch(spark, "run") as folder, settings(spark, LEAN), closing(Rows(both, f"{folder}/rows")) as rows:
        summary = _merge_rows(spark, store, rows, folder, existing, as_of, max_items, max_age_days, batch, stream)
    store.vacuum(spark)
    return summary


def _merge_rows(spark: SparkSession, store: Store, rows: Rows, folder: str, existing: DataFrame, as_of: str,
                max_items: int | None, max_age_days: int | None, batch: int,
                stream: tuple[str, int] | None) -> DataFrame:
    """The run over its numbered rows: (`stored`) the live items, and the batch."""
    def kept(frame: DataFrame, name: str) -> DataFrame:
        return materialize(frame, name, folder, compression="zstd")

    fresh = rows.all().where(~F.col("stored"))
    narrow = ["id", "published", "first_seen", *ORDER_COLUMNS, ROW]
    merged = kept(merge(rows.all().where("stored").select(*narrow), fresh.select(*narrow), store.ledger(spark), as_of)
                  .drop("published"), "merged")
    last = last_kept(merged, as_of, max_items, max_age_days) if max_items else None
    placed = ar.with_month(with_placement(merged, as_of, max_items, max_age_days, last=last))
    past = placed.where(F.col("placement") == ARCHIVE)

    with settings(spark, IN_PLACE):
        outside = ar.with_digest(rows.pick(past.select(ROW, "first_seen", "month"))
                                 .select(*ARCHIVED_ITEM.fieldNames()))
        digests = kept(outside.select("month", "id", "digest"), "digests")
    keys = kept(ar.news(store.archive_index(spark), digests), "news")
    # The keys are written, so Spark knows their size: a few are broadcast.
    chosen = kept(past.join(keys, ["month", "id"], "left_semi")
                  .select("month", "id", "first_seen", *ORDER_COLUMNS, ROW), "outgoing")
    archived = keys.where(~F.col("held")).agg(F.count("*").alias("newly_archived"))
    summary = materialize(run_summary(existing, fresh, placed, archived), "summary")
    newest = kept(placed.where(F.col("placement") == LIVE).select("first_seen", *ORDER_COLUMNS, ROW), "newest")

    # Where a task holds a lot of one month, it writes that month; only what is scattered is gathered.
    settled = kept(rows.settled(chosen, "month"), "settled")
    loose = kept(with_part(chosen).join(settled, [PART, "month"], "left_anti").drop(PART), "loose")
    still = kept(with_part(chosen).join(settled, [PART, "month"], "left_semi").drop(PART), "still")

    with settings(spark, IN_PLACE):
        store.upsert_archive(rows.pick(loose), chosen.select("month", "id"), settled=rows.pick(still))
        store.append_ledger(ledger_additions(placed))
        live_path = store.write_live(rows.pick(newest), batch)
    store.write_manifest(spark)
    name, number = stream or (None, None)
    store.append_run(summary.select(
        F.lit(batch).cast("long").alias("batch"), F.lit(as_of).alias("as_of"),
        F.lit(live_path).alias("live_path"), F.lit(name).cast("string").alias("stream"),
        F.lit(number).cast("long").alias("stream_batch"), "*"))
    return summary


@dataclass(frozen=True)
class Layout:
    """Where a landing folder holds what, and what names a release feed's repository in its path."""
    blog: str = "blog/*.xml"
    posts: str = "posts/*"
    releases: str = "releases/*/*/releases.atom"
    repos: str = "repos/*.json"
    notes: str = "notes"
    repo_of_path: str = feeds.REPO_OF_PATH


class Landed(NamedTuple):
    """What a landing folder gives: items, and the status of the sources, their inputs and documents."""
    items: DataFrame
    sources: DataFrame
    inputs: DataFrame
    documents: DataFrame


def stage_sources(spark: SparkSession, landing: str, base_url: str, as_of: str,
                  configured_repos: DataFrame, layout: Layout = Layout()) -> Landed:
    """Stage all sources of a landing folder, each input by a job of its own.

    The inputs: blog feeds, `posts/` (one file per post, named by its URL in percent encoding), release feeds,
    repository listings, and `notes/` (a mirror of the site: index page and month pages). A source fails with
    its own input; without posts the teasers stand, without listings the configured repositories. Whatever
    fails contributes nothing, and the others go on.
    """
    staging = Staging(spark)
    at = {f: f"{landing}/{getattr(layout, f)}" for f in ("blog", "posts", "releases", "repos", "notes")}
    placed = [T.StructField("origin", T.StringType()), T.StructField("pos", T.LongType())]
    page = T.StructType([*PAGE.fields, placed[0]])
    has_text = F.length(F.coalesce("html", F.lit(""))) > 0

    blog = staging.records(
        "blog", at["blog"], lambda skip: feeds.scan_xml(spark, at["blog"], "item", RSS_ENTRY, skip),
        feeds.rss_usable(), T.StructType([*RSS_ENTRY.fields, *placed]))
    posts = staging.records(
        "posts", at["posts"], lambda skip: read_pages(spark, at["posts"], "posts", "", skip), has_text, page)
    releases = staging.records(
        "releases", at["releases"],
        lambda skip: feeds.scan_xml(spark, at["releases"], "entry", ATOM_ENTRY, skip),
        feeds.atom_usable(), T.StructType([*ATOM_ENTRY.fields, *placed]))
    repos = staging.records(
        "repos", at["repos"], lambda skip: listings.read_listing(spark, at["repos"], skip),
        listings.listing_usable(), listings.LISTED)
    notes = staging.records(
        "notes", at["notes"], lambda skip: read_pages(spark, at["notes"], "notes", base_url, skip),
        has_text, page)

    def of_blog(_):
        named = posts.select(F.url_decode(F.regexp_replace("url", "^/", "")).alias("url"), "html")
        return blog_items(with_post_summary(feeds.rss_entries(blog), named), carry=PLACE)

    def of_releases(_):
        watched = listings.repo_union(configured_repos, listings.active_repos(repos))
        entries = feeds.atom_entries(releases, layout.repo_of_path)
        return release_items(listings.of_repos(entries, watched), carry=PLACE)

    def of_notes(_):
        pages = notes.select("url", "html")
        index = pages.where(~F.col("url").rlike(fv.MONTH_PAGE_URL))
        return note_source(index, pages, base_url, as_of)

    frames, rows = {}, []
    for source, own, build in ((fv.SOURCE_BLOG, "blog", of_blog),
                               (fv.SOURCE_RELEASES, "releases", of_releases),
                               (fv.SOURCE_NOTES, "notes", of_notes)):
        found = staging.inputs[own]
        if found.status == OK:
            found = stage(spark, f"items-{own}", build, FRESH_ITEM)
        frames[source] = found.rows if found.status == OK else empty(spark, FRESH_ITEM)
        rows.append((source, found.status, found.detail))
    return Landed(union_sources(frames), spark.createDataFrame(rows, STATUS), staging.input_status(),
                  staging.document_status())


def landed_sources(spark: SparkSession, landing: str, base_url: str, as_of: str,
                   configured_repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sources of a landing folder -> (fresh items, source status)."""
    landed = stage_sources(spark, landing, base_url, as_of, configured_repos)
    return landed.items, landed.sources
