"""RSS and Atom scans over folders of landed feed documents.

One scan reads all documents. A record that is not well-formed, or has no title or link, does not
stop the others: it is kept in `_corrupt` / left out of the entries, and counted in the status of its
document (`staging`). Entries keep their order of appearance: a document is read by one task from front to back,
so `pos` ascends within `origin` however the files are spread over tasks.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidings.functions.dates import feed_date
from tidings.functions.text import blank_to_null, drop_trailer_lines, strip, with_plain_text
from tidings.schema import ATOM_ENTRY, RSS_ENTRY
from tidings.sources.reading import origin, without

#: `<owner>/<repository>/releases.atom`, the layout of landed release feeds.
REPO_OF_PATH = r"([^/]+/[^/]+)/releases\.atom$"


def read_records(reader, path: str, row_tag: str, schema, skip: list[str] = ()) -> DataFrame:
    """Records of all documents under `path` but those in `skip`, with `origin`, their document.

    `reader` is `spark.read`, or `spark.readStream` for the documents landed since the last run.
    """
    records = (
        reader.format("xml").schema(schema)
        .option("rowTag", row_tag)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .load(path))
    return without(records, skip).select("*", origin().alias("origin"))


def numbered(records: DataFrame) -> DataFrame:
    """Add `pos`, ascending within each document."""
    return records.withColumn("pos", F.monotonically_increasing_id())


def scan_xml(spark: SparkSession, path: str, row_tag: str, schema,
             skip: list[str] = ()) -> DataFrame:
    """Records of all documents under `path`, with `origin` and `pos`."""
    return numbered(read_records(spark.read, path, row_tag, schema, skip))


def is_entry(title: Column, url: Column) -> Column:
    return title.isNotNull() & blank_to_null(url).isNotNull()


def scan_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS documents -> (title, url, published, summary, tags, origin, pos).

    The link may be a permalink guid. `published` is the UTC date of pubDate, else of dc:date;
    `summary` is the description, else content:encoded, still the feed's own markup.
    """
    return rss_entries(scan_xml(spark, path, "item", RSS_ENTRY))


def rss_url() -> Column:
    """The link of a record, else its guid if that is a permalink."""
    permalink = F.when(F.lower(F.coalesce("guid._isPermaLink", F.lit("true"))) == "true",
                       blank_to_null(strip(F.col("guid._VALUE"))))
    return F.coalesce(blank_to_null(strip(F.col("link"))), permalink)


def rss_usable() -> Column:
    """Whether a record becomes an entry."""
    return F.col("_corrupt").isNull() & is_entry(F.col("title"), rss_url())


def rss_entries(records: DataFrame) -> DataFrame:
    tags = F.transform(F.coalesce("category", F.array().cast("array<string>")), strip)
    entries = records.select(
        F.col("title"), rss_url().alias("url"),
        feed_date(F.coalesce("pubDate", "`dc:date`")).alias("published"),
        F.coalesce(blank_to_null(F.col("description")), F.col("`content:encoded`"))
        .alias("summary"), tags.alias("tags"), "origin", "pos")
    return entries.where(is_entry(F.col("title"), F.col("url")))


def scan_atom(spark: SparkSession, path: str, repo_of_path: str = REPO_OF_PATH) -> DataFrame:
    """Atom documents -> (repo, title, url, published, summary, origin, pos).

    The repository is named by the document's path. The summary is the entry's summary, else its
    content, be it text, html or xhtml, as plain text without commit trailers.
    """
    return atom_entries(scan_xml(spark, path, "entry", ATOM_ENTRY), repo_of_path)


def atom_url() -> Column:
    """The first alternate link of a record; a link is one unless it says otherwise."""
    alternate = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate"))
                         == "alternate")
    return strip(F.get(F.transform(alternate, lambda x: x["_href"]), F.lit(0)))


def atom_usable() -> Column:
    """Whether a record becomes an entry."""
    return F.col("_corrupt").isNull() & is_entry(F.col("title"), atom_url())


def atom_entries(records: DataFrame, repo_of_path: str = REPO_OF_PATH) -> DataFrame:
    entries = records.select(
        F.regexp_extract(F.url_decode("origin"), repo_of_path, 1).alias("repo"),
        strip(F.col("title")).alias("title"),
        atom_url().alias("url"),
        feed_date(F.coalesce("updated", "published")).alias("published"),
        F.coalesce(blank_to_null(F.col("summary")), F.col("content")).alias("markup"), "origin", "pos")
    entries = entries.where(is_entry(F.col("title"), F.col("url")))
    plain = with_plain_text(entries, "markup", "summary").drop("markup")
    return plain.withColumn("summary", drop_trailer_lines(F.col("summary")))
