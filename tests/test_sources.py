"""Landed feeds, listings and pages; failure isolation; incremental runs."""

import gzip
import json
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from tidings import fixed_values as fv
from tidings.operators.normalize import blog_items, release_items
from tidings.plans.daily import PLACE, landed_sources, stage_sources, union_sources
from tidings.schema import RSS_ENTRY
from tidings.sources import feeds, listings, staging
from tidings.sources.pages import scan_pages
from tidings.sources.status import isolate, record_status
from tidings.sources.store import Store
from tidings.streaming.landing import merge_new_files

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0"><channel><title>Channel</title>
<item><title>One &amp; only</title><link>https://example.com/1</link>
  <description>&lt;p&gt;Teaser &amp;amp; more&lt;/p&gt;</description>
  <pubDate>Fri, 03 Jul 2026 23:30:00 -0500</pubDate>
  <category>Platform</category><category> Data </category></item>
<item><title>Two</title><link> https://example.com/2 </link></item>
<item><title>No link</title></item>
</channel></rss>"""

ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>Releases</title>
<entry><id>1</id><updated>2026-05-01T23:30:00-05:00</updated>
  <link rel="self" href="https://example.com/self"/>
  <link rel="alternate" href="https://example.com/{name}/v1"/><title>v1</title>
  <content type="html">&lt;p&gt;Fix&lt;/p&gt;Co-authored-by: someone</content></entry>
<entry><id>2</id><updated>bad</updated><link href="https://example.com/{name}/v2"/>
  <title> v2 </title><content type="html">Signed-off-by: only</content></entry>
</feed>"""


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_scan_rss(spark, tmp_path):
    put(tmp_path, "a.xml", RSS)
    rows = feeds.scan_rss(spark, str(tmp_path / "*.xml")).orderBy("origin", "pos").collect()
    assert [(r.title, r.url, r.published, r.summary, r.tags) for r in rows] == [
        ("One & only", "https://example.com/1", "2026-07-04", "<p>Teaser &amp; more</p>",
         ["Platform", "Data"]),
        ("Two", "https://example.com/2", None, None, [])]


def test_scan_atom_names_the_repository_by_path(spark, tmp_path):
    put(tmp_path, "apache/spark/releases.atom", ATOM.format(name="spark"))
    put(tmp_path, "labs/x.y/releases.atom", ATOM.format(name="x"))
    entries = feeds.scan_atom(spark, str(tmp_path / "*/*/releases.atom"))
    rows = release_items(entries, carry=PLACE).orderBy("origin", "pos").collect()
    assert [(r.title, r.published, r.summary, r.tags, r.url) for r in rows[:2]] == [
        ("apache/spark: v1", "2026-05-02", "Fix", ["apache/spark"],
         "https://example.com/spark/v1"),
        ("apache/spark: v2", None, "", ["apache/spark"], "https://example.com/spark/v2")]
    assert rows[0].category == "Data Engineering" and rows[2].source_label == "GitHub · labs/x.y"


def test_listing_and_repo_union(spark, tmp_path):
    put(tmp_path, "p1.json", json.dumps([
        {"full_name": "o/a", "archived": True}, {"full_name": "o/b", "fork": True},
        {"full_name": "o/c", "archived": False, "fork": False, "size": 3},
        {"full_name": "o/d"}]))
    put(tmp_path, "p2.json", json.dumps([{"full_name": "x/y"}, {"full_name": "o/c"}]))
    found = listings.scan_repo_listing(spark, str(tmp_path / "*.json"))
    assert [r.full_name for r in found.orderBy("origin", "pos").collect()] == [
        "o/c", "o/d", "x/y", "o/c"]
    configured = spark.createDataFrame([("x/y", "cfg", 0), ("z/z", "cfg", 1), ("x/y", "cfg", 2)],
                                       "full_name string, origin string, pos long")
    union = listings.repo_union(configured, found).orderBy("side", "origin", "pos")
    assert [r.full_name for r in union.collect()] == ["x/y", "z/z", "o/c", "o/d"]
    assert listings.scan_repo_listing(spark, str(tmp_path / "none")).count() == 0


def test_scan_pages_mirrors_the_site(spark, tmp_path):
    put(tmp_path, "notes/a/b.html", "<p>b</p>")
    put(tmp_path, "notes/a/c d", "two\nlines é")
    pages = scan_pages(spark, str(tmp_path / "notes"), "notes", "https://example.com/")
    assert {r.url: r.html for r in pages.collect()} == {
        "https://example.com/a/b": "<p>b</p>", "https://example.com/a/c d": "two\nlines é"}


def test_isolate(spark, tmp_path):
    put(tmp_path, "ok.json", '{"a": "1"}')
    frames, status = isolate(spark, {
        "good": lambda: spark.read.schema("a string").json(str(tmp_path)),
        "gone": lambda: spark.read.schema("a string").json(str(tmp_path / "gone")),
        "broken": lambda: spark.range(1).select("nothing")}, "a string")
    assert {n: f.count() for n, f in frames.items()} == {"good": 1, "gone": 0, "broken": 0}
    assert {r.source: r.status for r in status.collect()} == {
        "good": "ok", "gone": "missing", "broken": "failed"}


def test_a_bad_record_does_not_stop_the_others(spark, tmp_path):
    put(tmp_path, "bad.xml", RSS.replace("<title>Two</title>", "<title>Two</b></title>"))
    put(tmp_path, "good.xml", RSS)
    records = feeds.scan_xml(spark, str(tmp_path), "item", RSS_ENTRY)
    titles = {r.title for r in feeds.rss_entries(records).collect()}
    assert {"One & only", "Two"} <= titles
    usable = F.col("_corrupt").isNull() & feeds.is_entry(F.col("title"), F.col("link"))
    status = {r.origin.rsplit("/", 1)[1]: r for r in record_status(records, usable).collect()}
    assert status["good.xml"].records == 3 and status["good.xml"].unusable == 1
    assert status["bad.xml"].unusable >= 1


def test_landed_sources_together(spark, tmp_path):
    product = "aws/en/release-notes/product"
    put(tmp_path, "blog/feed.xml", RSS)
    put(tmp_path, f"posts/{quote('https://example.com/2', safe='')}.html",
        '<meta name="description" x content="Real &amp; whole">')
    put(tmp_path, "releases/apache/spark/releases.atom", ATOM.format(name="spark"))
    put(tmp_path, "releases/un/watched/releases.atom", ATOM.format(name="no"))
    put(tmp_path, "repos/p1.json", json.dumps([{"full_name": "apache/spark"}]))
    put(tmp_path, f"notes/{product}/index.html",
        f'<a href="/{product}/2026/july#one">One</a>')
    put(tmp_path, f"notes/{product}/2026/july.html", "<h2 id='one'>One</h2>July 2, 2026<br>Body")
    configured = spark.createDataFrame([], "full_name string, origin string, pos long")
    fresh, status = landed_sources(spark, str(tmp_path), "https://example.com", "2026-07-30",
                                   configured)
    rows = fresh.orderBy("origin", "pos").collect()
    assert [(r.source, r.title, r.summary, r.published) for r in rows] == [
        (fv.SOURCE_BLOG, "One & only", "Teaser & more", "2026-07-04"),
        (fv.SOURCE_BLOG, "Two", "Real & whole", None),
        (fv.SOURCE_RELEASES, "apache/spark: v1", "Fix", "2026-05-02"),
        (fv.SOURCE_RELEASES, "apache/spark: v2", "", None),
        (fv.SOURCE_NOTES, "One", "Body", "2026-07-02")]
    assert {r.status for r in status.collect()} == {"ok"}

    fresh, status = landed_sources(spark, str(tmp_path / "absent"), "https://example.com",
                                   "2026-07-30", configured)
    assert fresh.count() == 0 and {r.status for r in status.collect()} == {"missing"}


def test_one_unreadable_document_costs_no_other(spark, tmp_path):
    """Broken archives are left out and named; an entry without a link is counted; an empty feed is named."""
    put(tmp_path, "blog/a.xml", RSS)
    put(tmp_path, "blog/none.xml", "<rss><channel/></rss>")
    whole = gzip.compress(RSS.encode() * 50)
    for name, data in (("cut", whole[:len(whole) // 2]), ("no", b"no archive")):
        (tmp_path / f"blog/{name}.xml").mkdir()
        (tmp_path / f"blog/{name}.xml/part.xml.gz").write_bytes(data)
    put(tmp_path, "releases/apache/spark/releases.atom", ATOM.format(name="spark"))
    configured = spark.createDataFrame([("apache/spark", "cfg", 0)],
                                       "full_name string, origin string, pos long")
    landed = stage_sources(spark, str(tmp_path), "https://example.com", "2026-07-30", configured)
    assert {r.title for r in landed.items.collect()} == {
        "One & only", "Two", "apache/spark: v1", "apache/spark: v2"}
    assert {r.source: r.status for r in landed.sources.collect()} == {
        fv.SOURCE_BLOG: "ok", fv.SOURCE_RELEASES: "ok", fv.SOURCE_NOTES: "missing"}
    assert {r.input: r.status for r in landed.inputs.collect()} == {
        "blog": "ok", "posts": "missing", "releases": "ok", "repos": "missing", "notes": "missing"}
    documents = {r.document.split("/", 4)[-1].rsplit("/blog/")[-1]: (r.status, r.records, r.unusable)
                 for r in landed.documents.where("input = 'blog'").collect()}
    assert documents == {"a.xml": ("ok", 3, 1), "none.xml": ("empty", 0, 0),
                         "cut.xml/part.xml.gz": ("unreadable", 0, 0),
                         "no.xml/part.xml.gz": ("unreadable", 0, 0)}


def test_a_source_that_fails_while_it_runs_costs_no_other(spark, tmp_path, monkeypatch):
    """More unreadable documents than are left out one by one; and a failure that names no document."""
    put(tmp_path, "releases/apache/spark/releases.atom", ATOM.format(name="spark"))
    for n in range(3):
        (tmp_path / f"blog/{n}.xml").mkdir(parents=True)
        (tmp_path / f"blog/{n}.xml/part.xml.gz").write_bytes(b"no archive")
    configured = spark.createDataFrame([("apache/spark", "cfg", 0)],
                                       "full_name string, origin string, pos long")
    monkeypatch.setattr(staging, "MAX_UNREADABLE", 2)
    landed = stage_sources(spark, str(tmp_path), "https://example.com", "2026-07-30", configured)
    status = {r.source: (r.status, r.detail) for r in landed.sources.collect()}
    assert status[fv.SOURCE_BLOG] == ("failed", "FAILED_READ_FILE.NO_HINT")
    assert status[fv.SOURCE_RELEASES][0] == "ok" and landed.items.count() == 2

    staged = staging.stage(spark, "x", lambda skip: spark.range(3).select(
        F.raise_error(F.lit("broken")).cast("string").alias("a")), "a string")
    assert (staged.status, staged.rows.count()) == ("failed", 0)
    with pytest.raises(ZeroDivisionError):         # an error of this program isn't a failed source
        staging.stage(spark, "x", lambda skip: 1 / 0, "a string")


def test_atom_content_of_each_kind(spark, tmp_path):
    """Text, escaped markup, CDATA and a subtree; an empty summary gives way to the content."""
    put(tmp_path, "o/r/releases.atom", """<feed xmlns="http://www.w3.org/2005/Atom">
<entry><title type="text">a</title><link href="https://e/a"/><content type="text">one &amp;amp; two</content></entry>
<entry><title>b</title><link href="https://e/b"/><content type="html">&lt;p&gt;one&lt;/p&gt;&lt;li&gt;two</content></entry>
<entry><title>c</title><link href="https://e/c"/><summary/><content><![CDATA[<p>one</p><br/>two]]></content></entry>
<entry><title>d</title><link href="https://e/d"/><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">
  <p>one <b>bold</b></p><ul><li>two</li></ul></div></content></entry>
<entry><title>e</title><link href="https://e/e"/><summary type="html">s</summary><content>c</content></entry>
</feed>""")
    rows = feeds.scan_atom(spark, str(tmp_path / "*/*/releases.atom")).orderBy("pos").collect()
    assert [(r.title, r.summary) for r in rows] == [
        ("a", "one & two"), ("b", "one\n\n- two"), ("c", "one\n\ntwo"), ("d", "one bold\n\n- two"), ("e", "s")]


def test_listing_pages_of_either_form_lose_nothing(spark, tmp_path):
    put(tmp_path, "a.json", "\n \n[\n" + ",\n".join(f'{{"full_name": "o/a{i}"}}' for i in range(5)) + "\n]")
    put(tmp_path, "b.json", "\n".join(f'{{"full_name": "o/b{i}", "fork": {str(i == 1).lower()}}}' for i in range(5)))
    put(tmp_path, "c.json", '{"message": "rate limit"}')
    put(tmp_path, "d.json", '[{"full_name": "o/d0"}, {"full_na')
    put(tmp_path, "e.json", " \n")
    put(tmp_path, "f.json", "[]")
    put(tmp_path, "g h.json", '[{"full_name": "o/g0", "archived": true}, {"full_name": "o/g1"}]')
    found = listings.scan_repo_listing(spark, str(tmp_path / "*.json")).orderBy("origin", "pos").collect()
    assert [r.full_name for r in found] == [
        *[f"o/a{i}" for i in range(5)], "o/b0", "o/b2", "o/b3", "o/b4", "o/g1"]
    stage = staging.Staging(spark)
    stage.records("repos", str(tmp_path / "*.json"), lambda skip: listings.read_listing(
        spark, str(tmp_path / "*.json"), skip), listings.listing_usable(), listings.LISTED)
    got = {r.document[-6:]: (r.status, r.records, r.unusable) for r in stage.document_status().collect()}
    assert got == {"a.json": ("ok", 5, 0), "b.json": ("ok", 5, 0), "c.json": ("ok", 1, 1),
                   "d.json": ("ok", 1, 1), "e.json": ("empty", 0, 0), "f.json": ("empty", 0, 0),
                   "h.json": ("ok", 2, 0)}


def test_union_keeps_the_order_of_sources(spark, tmp_path):
    put(tmp_path, "a.xml", RSS)
    items = blog_items(feeds.scan_rss(spark, str(tmp_path)), carry=PLACE)
    both = union_sources({"first": items, "second": items}).orderBy("origin", "pos").collect()
    assert [r.title for r in both] == ["One & only", "Two"] * 2


def test_incremental_runs_merge_each_file_once(spark, tmp_path):
    landing, store = tmp_path / "landing", Store(str(tmp_path / "store"))

    def run(as_of):
        records = feeds.read_records(spark.readStream, str(landing), "item", RSS_ENTRY)
        merge_new_files(records, lambda batch: blog_items(feeds.rss_entries(batch), carry=PLACE),
                        store, str(tmp_path / "checkpoint"), as_of)

    put(landing, "a.xml", RSS)
    run("2026-07-10")
    assert {r.url: r.first_seen for r in store.live(spark).collect()} == {
        "https://example.com/1": "2026-07-10", "https://example.com/2": "2026-07-10"}
    put(landing, "b.xml", RSS.replace("example.com/2", "example.com/3"))
    run("2026-07-11")
    assert {r.url: r.first_seen for r in store.live(spark).collect()} == {
        "https://example.com/1": "2026-07-10", "https://example.com/2": "2026-07-10",
        "https://example.com/3": "2026-07-11"}
    log = store.runs(spark).orderBy("batch").collect()
    assert [r.fetched[fv.SOURCE_BLOG] for r in log] == [2, 2]
    assert [r.stream_batch for r in log] == [0, 1]

    # The run was logged, but the stream's own commit is lost: the batch comes again.
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint/commits" / name).rename(tmp_path / f"lost{name}")
    run("2026-07-12")
    assert store.runs(spark).count() == 2


def test_a_new_checkpoint_under_an_old_path_is_a_new_stream(spark, tmp_path):
    landing, store = tmp_path / "landing", Store(str(tmp_path / "store"))
    checkpoint = tmp_path / "checkpoint"

    def run(folder, as_of):
        (tmp_path / folder).mkdir()
        checkpoint.unlink(missing_ok=True)
        checkpoint.symlink_to(tmp_path / folder)
        records = feeds.read_records(spark.readStream, str(landing), "item", RSS_ENTRY)
        merge_new_files(records, lambda batch: blog_items(feeds.rss_entries(batch), carry=PLACE),
                        store, str(checkpoint), as_of)

    put(landing, "a.xml", RSS)
    run("first", "2026-07-10")
    put(landing, "b.xml", RSS.replace("example.com/2", "example.com/3"))
    run("second", "2026-07-11")
    assert {r.url: r.first_seen for r in store.live(spark).collect()} == {
        "https://example.com/1": "2026-07-10", "https://example.com/2": "2026-07-10",
        "https://example.com/3": "2026-07-11"}
    log = store.runs(spark).orderBy("batch").collect()
    assert [r.stream_batch for r in log] == [0, 0] and log[0].stream != log[1].stream


def test_rss_as_feeds_are(spark, tmp_path):
    """Permalink guids, content:encoded, dc:date; a guid that is no permalink is no link."""
    from tidings.sources.feeds import scan_rss
    (tmp_path / "feed.xml").write_text("""<rss xmlns:content="c" xmlns:dc="d"><channel>
<item><title>A</title><guid>https://e/a</guid><content:encoded>&lt;p&gt;x&lt;/p&gt;</content:encoded>
<dc:date>2026-07-03T23:30:00-02:00</dc:date></item>
<item><title>B</title><guid isPermaLink="false">17</guid></item>
<item><title>C</title><guid isPermaLink="true">https://e/no</guid><link>https://e/c</link>
<description>d</description><content:encoded>e</content:encoded></item>
</channel></rss>""", encoding="utf-8")
    got = scan_rss(spark, str(tmp_path / "feed.xml")).orderBy("pos").collect()
    assert [(r.title, r.url, r.published, r.summary) for r in got] == [
        ("A", "https://e/a", "2026-07-04", "<p>x</p>"), ("C", "https://e/c", None, "d")]


def test_listing_pages_that_are_no_listing(spark, tmp_path):
    from tidings.sources.listings import scan_repo_listing
    for name, text in {"a.json": '[{"full_name": "x/y", "fork": false}]',
                       "b.json": '{"message": "rate limit"}', "c.json": '[{"full_na'}.items():
        (tmp_path / name).write_text(text)
    assert [r.full_name for r in scan_repo_listing(spark, str(tmp_path / "*.json")).collect()] == ["x/y"]


def test_pages_below_a_folder_of_the_same_name(spark, tmp_path):
    from tidings.sources.pages import scan_pages
    folder = tmp_path / "notes" / "in" / "notes"
    (folder / "aws").mkdir(parents=True)
    (folder / "aws" / "may.html").write_text("<p>")
    assert [r.url for r in scan_pages(spark, str(folder), "notes", "https://b").collect()] == [
        "https://b/aws/may"]
