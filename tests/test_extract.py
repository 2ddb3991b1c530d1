from pyspark.sql import functions as F

from tidings import fixed_values as fv
from tidings.operators import extract, notes
from tidings.plans.daily import note_source

BASE = "https://example.com"
PRODUCT = "/aws/en/release-notes/product"

INDEX = f"""<nav>
<a class="x" href="{PRODUCT}/2026/july#one"><span>One</span> &amp; all</a>
<A HREF={PRODUCT}/2026/JULY#two title=t>Two
lines</A>
<a href='{PRODUCT}/2026/smarch#bad'>Unknown month</a>
<a href="{PRODUCT}/2026/may#three"><!-- empty --></a>
<a href="{PRODUCT}/2026/may#three">Hidden by the empty one</a>
<a href="{PRODUCT}/2019/may#old">Old</a>
<a href="{PRODUCT}/2019/may#old">Old again</a>
<a href="/elsewhere">No</a></nav>"""

JULY = f"""<h1>July</h1><h2>No id</h2><p>skipped</p>
<h2 class="c" id="one">One</h2><p>July 26, 2026</p><h2>Inner</h2><ul><li>First</li></ul>
<h2 data-x="1" id=two>Two</h2><p>Smarch 3, 2026</p><p>Body two</p>
<h2 id="one">One again</h2><p>Later body</p>
<h2 id="last">Last</h2>{"x" * 2990}<a href="cut">link</a>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_note_links(spark):
    df = pages(spark, [(BASE + "/index", INDEX)]).withColumnRenamed("url", "origin")
    links = extract.note_links(df, BASE, ["origin"]).orderBy("pos").collect()
    assert [(r.year, r.month, r.slug, r.title) for r in links] == [
        (2026, 7, "one", "One & all"), (2026, 7, "two", "Two\nlines"), (2019, 5, "old", "Old")]
    assert links[1].url == f"{BASE}{PRODUCT}/2026/JULY#two"


def test_sections_end_at_the_next_heading_with_an_id(spark):
    df = spark.createDataFrame([(1, JULY)], "n int, html string")
    rows = extract.page_sections(df).orderBy("pos").collect()
    assert [r.slug for r in rows] == ["one", "two", "one", "last"]
    assert "<h2>Inner</h2>" in rows[0].section
    assert len(rows[3].section) == fv.LAST_SECTION_CHARS and rows[3].section.endswith("<a href=\"c")


def test_month_sections_of_repeated_headings(spark):
    df = spark.createDataFrame([(2026, 7, "p", JULY)],
                               "year int, month int, origin string, html string")
    rows = {r.slug: r for r in notes.month_sections(df, ["origin"]).collect()}
    assert (rows["one"].body, rows["one"].exact_date) == ("Later body", "2026-07-26")
    assert (rows["two"].body, rows["two"].exact_date) == ("Body two", None)
    assert rows["last"].body.startswith("xxx")


def test_note_source_end_to_end(spark):
    index = pages(spark, [(BASE + "/index", INDEX)])
    months = pages(spark, [(f"{BASE}{PRODUCT}/2026/july", JULY),
                           (f"{BASE}{PRODUCT}/2019/may", "<h2 id='old'>O</h2><p>Not read</p>"),
                           (f"{BASE}{PRODUCT}/2026/smarch", JULY)])
    rows = {r.title: r for r in note_source(index, months, BASE, "2026-07-30").collect()}
    assert rows["One & all"].published == "2026-07-26" and rows["One & all"].tags == []
    assert rows["One & all"].summary == "Later body"
    assert rows["Two\nlines"].published == "2026-07-31"
    assert rows["Two\nlines"].tags == ["approx-date"]
    assert rows["Old"].summary == fv.NOTES_SUMMARY_FORMAT % ("May", 2019)
    assert rows["Old"].published == "2019-05-31"
    assert {r.source for r in rows.values()} == {fv.SOURCE_NOTES}


def test_meta_description(spark):
    rows = [
        ('<meta name="description" lang="en" content="A &amp; B">', "A &amp; B"),
        ('<META content="C" x name="description">', "C"),
        ('<meta name="description" a content="">', None),
        ('<meta name="other" content="no">', None),
        ('<meta content="first" name="description"><meta name="description" z content="second">',
         "first"),
        ("", None), (None, None)]
    df = spark.createDataFrame(rows, "html string, want string")
    for r in df.select("want", extract.meta_description(F.col("html")).alias("got")).collect():
        assert r.got == r.want


def test_post_summary_falls_back_to_the_teaser(spark):
    entries = spark.createDataFrame(
        [("a", "<p>teaser a</p>"), ("b", "teaser b"), ("c", None), ("d", "teaser d")],
        "url string, summary string")
    posts = pages(spark, [("a", '<meta name="description" x content="Real &lt;i&gt;">'),
                          ("b", '<meta name="description" x content="<!-- -->">'),
                          ("d", "<p>none</p>")])
    got = {r.url: r.summary for r in extract.with_post_summary(entries, posts).collect()}
    assert got == {"a": "Real <i>", "b": "teaser b", "c": "", "d": "teaser d"}


def test_page_text_is_not_shuffled(spark, tmp_path, plan_of):
    path = str(tmp_path / "pages")
    pages(spark, [("u", INDEX)]).write.parquet(path)
    links = extract.page_links(spark.read.parquet(path), fv.NOTE_LINK, ["href"], ["url", "pos"],
                               1, 5)
    plan = plan_of(links)
    shuffle = plan[plan.index("Exchange"):]
    assert "WindowGroupLimit" in shuffle and "Generate" in shuffle
    assert "html" not in plan[:plan.index("Generate")]
