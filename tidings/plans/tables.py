"""Derived views over the test tables: the inputs of the catalog's queries.

Each is a lazy projection of a whole table. `oracle.py` states the same views in SQL.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings import fixed_values as fv
from tidings.functions.dates import sort_key
from tidings.functions.text import url_id

SITE = "https://example.com"
DAY = "yyyy-MM-dd"

#: Rules and hints that suit the tables' prose; they overlap on purpose, so that order matters.
PROSE_RULES = [
    ("Romance", ["que", "des", "avec", "los"]),
    ("German", ["und", "der", "ein"]),
    ("English", ["the", "and", "ing"]),
]
PROSE_FALLBACK = "Other"
PROSE_HINTS = {"src3": "Hinted A", "src7": "Hinted B", "src11": "Hinted A"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; how it is split is left to `spark.sql.files.maxPartitionBytes`."""
    return table(spark, sf_dir, name)


def text_of(*parts):
    """Concatenate columns, given as Column, and literals, given as str."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items seen over and over: one per event, keyed by user, type and day."""
    day = F.date_format("ts", DAY)
    url = text_of(SITE, "/users/", F.col("user_id"), "/", F.col("event_type"), "/", day)
    return table(spark, sf_dir, "events").select(
        url_id(url).alias("id"), url.alias("url"), day.alias("run_date"),
        F.when(F.col("event_type") != "error", day).alias("published"),
        F.col("event_type").alias("source"), F.col("event_id").alias("ord"))


def first_seen_items(spark: SparkSession, sf_dir: str, before: str | None = None,
                     since: str | None = None) -> DataFrame:
    """Sightings of a period, as items with the columns of the merge."""
    seen = sightings(spark, sf_dir)
    if before:
        seen = seen.where(F.col("run_date") < before)
    if since:
        seen = seen.where(F.col("run_date") >= since)
    return seen.select(
        "id", "url", "source", "published", F.lit(None).cast("string").alias("first_seen"), "ord")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated items, one per order; some lack `published` and some lack both dates."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", DAY)
    url = text_of(SITE, "/orders/", key)
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        url_id(url).alias("id"), F.col("o_orderpriority").alias("source"),
        text_of("Orders · ", F.col("o_orderpriority")).alias("source_label"),
        text_of("Order ", key).alias("title"), url.alias("url"),
        F.when(key % 50 == 0, F.lit(None)).when(key % 50 == 1, F.lit("")).otherwise(day)
        .alias("published"),
        F.when(key % 50 == 1, F.lit(None)).otherwise(day).alias("first_seen"),
        F.when(status == "P", F.lit("")).otherwise(
            text_of("Customer ", F.col("o_custkey"), " status ", status)).alias("summary"),
        F.lit(fv.FALLBACK_CATEGORY).alias("category"),
        F.array(status).alias("tags"), key.alias("ord"))


def with_sk(items: DataFrame) -> DataFrame:
    return items.withColumn("sk", sort_key(F.col("published"), F.col("first_seen")))


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages with release-note links, one page per order.

    Each links its order twice. The first link has an empty title (1-URGENT), an unknown month
    (2-HIGH), or no quotes and an upper-case month; the second has markup and entities in its
    title.
    """
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    year, month = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MMMM")
    base = "/aws/en/release-notes/product/"
    href = text_of(base, year, "/", F.lower(month), "#order-", key)
    first = (F.when(priority == "1-URGENT",
                    text_of("<a class=x href='", href, "'> <!-- none --> </a>"))
             .when(priority == "2-HIGH",
                   text_of('<a href="', base, year, '/smarch#order-', key, '">Lost</a>'))
             .otherwise(text_of("<A HREF=", base, year, "/", F.upper(month), "#order-", key,
                                ">Upper &amp; bare</A>")))
    second = text_of('<li><a href="', href, '" id="l">Order <b>', key, "</b> &quot;", priority,
                     "&quot;\n</a></li>")
    return texts(spark, sf_dir, "orders").select(
        key.alias("origin"), text_of("<nav>", first, second, "</nav>").alias("html"))


def month_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month pages (year, month, origin, html) with sections of orders, one page per order.

    By status the section has a valid date line, one with an unknown month, or none; a heading
    without an id does not split, and the order's heading is repeated without a date.
    """
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    line = (F.when(status == "F", F.date_format("o_orderdate", "MMMM d, yyyy"))
            .when(status == "P", F.date_format("o_orderdate", "'Smarch' d, yyyy"))
            .otherwise(F.lit("No date")))
    heading = text_of('<h2 class="t" id="order-', key, '">Order</h2>')
    body = text_of("<p>", line, "</p><h2>no id</h2><ul><li>Total ", F.col("o_custkey"),
                   "</li><li>Status &amp; ", status, "</li></ul>")
    again = F.when(F.col("o_orderpriority") == "5-LOW",
                   text_of(heading, "<p>Repeated ", key, "</p>")).otherwise(F.lit(""))
    return texts(spark, sf_dir, "orders").select(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        key.alias("origin"),
        text_of("<h1>Page</h1>", heading, body, again, "<h2 id='end'>End</h2>tail")
        .alias("html"))


def described_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a description tag put in front: either attribute order, empty, or none."""
    page = F.col("page_id")
    text = text_of("Page ", page, " &lt;b&gt; &amp;amp; more")
    tag = (F.when(page % 4 == 0, text_of('<meta name="description" lang="x" content="', text,
                                         '">'))
           .when(page % 4 == 1, text_of('<META content="', text, '" name="description">'))
           .when(page % 4 == 2, F.lit('<meta name="description" x content="">'))
           .otherwise(F.lit("")))
    return texts(spark, sf_dir, "pages").select(
        "page_id", text_of(SITE, "/post/", page).alias("url"),
        text_of(tag, F.col("html")).alias("html"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as feed entries with an undated title that needs stripping."""
    doc = F.col("doc_id")
    return texts(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("repo"),
        text_of("\u00a0 Document ", doc, " in ", F.col("lang"), "\n").alias("title"),
        text_of(SITE, "/post/", doc).alias("url"),
        F.lit(None).cast("string").alias("published"),
        F.col("text").alias("summary"),
        F.when(F.col("lang") == "en", F.array("lang", "source")).alias("tags"))


def repo_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Configured (regions, and each nation's region again) and discovered (nations) names."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    configured = region.select(
        F.col("r_name").alias("full_name"), F.lit("r").alias("origin"),
        F.col("r_regionkey").cast("long").alias("pos")
    ).unionByName(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("full_name"), F.lit("s").alias("origin"),
        F.col("n_nationkey").cast("long").alias("pos")))
    discovered = nation.select(
        F.col("n_name").alias("full_name"), F.lit("n").alias("origin"),
        F.col("n_nationkey").cast("long").alias("pos")
    ).unionByName(region.select(
        F.col("r_name").alias("full_name"), F.lit("n").alias("origin"),
        (F.col("r_regionkey") + 100).cast("long").alias("pos")))
    return configured, discovered
