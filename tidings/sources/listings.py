"""Repository listings and the list of repositories to watch."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidings.functions.text import strip
from tidings.schema import REPO_LISTING
from tidings.sources.reading import empty, is_missing, only, origin, without

LISTED = StructType([*REPO_LISTING.fields, StructField("origin", StringType()),
                     StructField("pos", LongType())])


def read_listing(spark: SparkSession, path: str, skip: list[str] = ()) -> DataFrame:
    """All records of landed listing pages (full_name, archived, fork, _corrupt, origin, pos).

    A page holds either one JSON array, over any number of lines, or a JSON value a line; which it is shows
    the first character that is not blank. So a first, cheap scan looks at the pages' beginnings, and each of the
    two readers then gets its own pages. Their names come to the driver, as the names of all files do that a scan
    reads. What is no repository (an error object, a page cut short) is a record too, without a name.
    """
    lines = without(spark.read.text(path), skip)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"),
                     F.monotonically_increasing_id().alias("line"))
    begun = lines.select(origin().alias("origin"), place.alias("place"),
                         F.substring(strip(F.col("value")), 1, 1).alias("first")).where("first != ''")
    heads = begun.groupBy("origin").agg(F.min_by("first", "place").alias("first")).collect()
    pages = {True: [], False: []}
    for head in heads:
        pages[head["first"] == "["].append(head["origin"])
    reader = spark.read.schema(REPO_LISTING).option("columnNameOfCorruptRecord", "_corrupt")
    parts = [only(reader.json(path, multiLine=arrays), names) for arrays, names in pages.items()]
    return parts[0].select("*", origin().alias("origin"), _pos()).unionByName(
        parts[1].select("*", origin().alias("origin"), _pos()))


def _pos() -> Column:
    return F.monotonically_increasing_id().alias("pos")


def listing_usable() -> Column:
    """Whether a record is a repository."""
    return F.col("_corrupt").isNull() & F.col("full_name").isNotNull()


def scan_repo_listing(spark: SparkSession, path: str) -> DataFrame:
    """Landed listing pages of either form -> (full_name, origin, pos).

    All pages are read at once. Archived repositories, forks and what has no name are left out; a missing flag
    counts as false. No pages, no repositories.
    """
    try:
        return active_repos(read_listing(spark, path))
    except AnalysisException as error:
        if is_missing(error):
            return active_repos(empty(spark, LISTED))
        raise


def active_repos(listing: DataFrame) -> DataFrame:
    flagged = F.coalesce("archived", F.lit(False)) | F.coalesce("fork", F.lit(False))
    return listing.where(listing_usable() & ~flagged).select("full_name", "origin", "pos")


def repo_union(configured: DataFrame, discovered: DataFrame) -> DataFrame:
    """Distinct repositories in order: the configured ones, then newly discovered ones.

    Both inputs are (full_name, origin, pos). The result keeps the place of the first mention, as
    (side, origin, pos).
    """
    both = (configured.withColumn("side", F.lit(0))
            .unionByName(discovered.withColumn("side", F.lit(1))))
    first = both.groupBy("full_name").agg(F.min(F.struct("side", "origin", "pos")).alias("p"))
    return first.select("full_name", "p.side", "p.origin", "p.pos")


def of_repos(entries: DataFrame, repos: DataFrame) -> DataFrame:
    """Feed entries of the watched repositories, in the order of the repository list.

    `origin` becomes the repository's place, so that entries sort by repository, then position.
    """
    place = F.concat_ws("/", F.col("side"), F.col("r.origin"), F.lpad(F.col("r.pos"), 19, "0"))
    r = repos.withColumnRenamed("full_name", "repo").alias("r")
    return (entries.alias("e").join(r, "repo")
            .select("repo", "title", "url", "published", "summary",
                    place.alias("origin"), F.col("e.pos").alias("pos")))
