"""A landing folder made of the test tables: what a run finds, with the faults it has to live with."""

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings import fixed_values as fv
from tidings.operators.notes import recent_pages
from tidings.plans import tables as t
from tidings.plans.daily import Layout
from tidings.shared import new_path
from tidings.sources.files import write_bytes

PRODUCT = "notes/aws/en/release-notes/product"
LAYOUT = Layout(releases="releases/*", repo_of_path=r"repo=([^=]+)/[^/]+$")

#: Repositories named by the configuration, the second one twice.
CONFIGURED = ["src1", "src2", "src2"]

#: Documents of which the post's own page has landed; the last page describes nothing.
DESCRIBED_POSTS = {1: '<meta name="description" lang="en" content="Post 1 &amp; its &lt;b&gt;page&lt;/b&gt;">',
                   2: '<meta content="Post 2" name="description">',
                   3: "<p>no description</p>"}

LATE_FEED = f"""<rss><channel><title>Late</title>
<item><title>Late &amp; last</title><link>{t.SITE}/late</link><pubDate>Fri, 03 Jul 2026 23:30:00 -0500</pubDate></item>
<item><title>No link</title><description>lost</description></item>
<item><link>{t.SITE}/no-title</link></item>
</channel></rss>"""

#: A document that names a compression it doesn't have.
UNREADABLE = b"this is no archive"

ERROR_PAGE = b'{"message": "API rate limit exceeded"}'
CUT_PAGE = b'[{"full_name": "src0", "archived": false},\n {"full_na'


def land(spark: SparkSession, sf_dir: str, notes_as_of: str) -> str:
    """Write the folder and return its path."""
    root = new_path(spark, "landing")
    _blog(spark, sf_dir, root)
    _releases(spark, sf_dir, root)
    _repos(spark, sf_dir, root)
    _notes(spark, sf_dir, root, notes_as_of)
    return root


def rss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed entries."""
    stamp = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"),
                                     (F.col("doc_id") % 200).cast("int")),
                          "EEE, dd MMM yyyy '23:30:00 -0500'")
    return t.document_entries(spark, sf_dir).select(
        "title", F.col("url").alias("link"), F.col("summary").alias("description"),
        stamp.alias("pubDate"), F.col("tags").alias("category"))


def _blog(spark, sf_dir, root) -> None:
    (rss_rows(spark, sf_dir).write.format("xml").option("rootTag", "channel").option("rowTag", "item")
     .save(f"{root}/blog/feed.xml"))
    write_bytes(spark, f"{root}/blog/late.xml", LATE_FEED.encode())
    write_bytes(spark, f"{root}/blog/broken.xml/part-0.xml.gz", UNREADABLE)
    for doc, html in DESCRIBED_POSTS.items():
        name = quote(f"{t.SITE}/post/{doc}", safe="")
        write_bytes(spark, f"{root}/posts/{name}.html", html.encode())


def _releases(spark, sf_dir, root) -> None:
    """A folder of feeds per repository; the content is html, text and xhtml by turns."""
    body = F.translate("summary", "&<", "+(")
    kind = F.element_at(F.array(*map(F.lit, ("html", "text", "xhtml"))), (F.col("doc_id") % 3 + 1).cast("int"))
    is_xhtml = F.col("kind") == "xhtml"
    text = F.when(F.col("kind") == "html", t.text_of("<p>", F.col("body"), "</p>Signed-off-by: someone")).when(
        F.col("kind") == "text", F.col("body"))
    content = F.struct(
        F.col("kind").alias("_type"), text.alias("_VALUE"),
        F.when(is_xhtml, F.struct(F.array("body").alias("p"))).alias("div"))
    link = F.array(F.struct(F.concat(F.lit(f"{t.SITE}/release/"), "doc_id").alias("_href"),
                            F.lit("alternate").alias("_rel")))
    entries = t.document_entries(spark, sf_dir).withColumn("body", body).withColumn("kind", kind)
    (entries.select("repo", "title", F.lit("2026-05-01T23:30:00-05:00").alias("updated"),
                    link.alias("link"), content.alias("content"))
     .write.partitionBy("repo").format("xml").option("rootTag", "feed").option("rowTag", "entry")
     .save(f"{root}/releases"))


def _repos(spark, sf_dir, root) -> None:
    """Nations as repositories: pages of one array each, lines, an error object, a page cut short."""
    nations = t.table(spark, sf_dir, "nation").select(
        t.text_of("src", F.col("n_nationkey")).alias("full_name"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") % 5 == 4).alias("archived"),
        (F.col("n_nationkey") % 7 == 3).alias("fork"), F.col("n_regionkey").alias("region"))
    one = F.to_json(F.struct("full_name", "archived", "fork"))
    for region in range(3):
        rows = F.array_join(F.sort_array(F.collect_list(one)), ",\n  ")
        page = nations.where(F.col("region") == region).agg(t.text_of("\n[\n  ", rows, "\n]").alias("value"))
        page.coalesce(1).write.text(f"{root}/repos/page{region}.json")
    nations.where("region >= 3").drop("region").write.json(f"{root}/repos/lines.json")
    write_bytes(spark, f"{root}/repos/error.json", ERROR_PAGE)
    write_bytes(spark, f"{root}/repos/cut.json", CUT_PAGE)


def _notes(spark, sf_dir, root, as_of) -> None:
    """The index page and the month pages of the recent months, in parts of bounded size."""
    (t.index_pages(spark, sf_dir).select("html").write.option("maxRecordsPerFile", 500)
     .text(f"{root}/{PRODUCT}/index.html"))
    recent = recent_pages(t.month_pages(spark, sf_dir), as_of)
    months = recent.select("year", "month").distinct().collect()        # as many as are recent
    for row in months:
        name = fv.MONTH_NAMES[row["month"] - 1].lower()
        (recent.where((F.col("year") == row["year"]) & (F.col("month") == row["month"])).select("html")
         .write.option("maxRecordsPerFile", 100).text(f"{root}/{PRODUCT}/{row['year']}/{name}.html"))


def configured(spark: SparkSession) -> DataFrame:
    rows = [(name, "configuration", i) for i, name in enumerate(CONFIGURED)]
    return spark.createDataFrame(rows, "full_name string, origin string, pos bigint")
