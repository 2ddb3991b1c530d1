"""Views and feed rows over the item stores."""

from pyspark.sql import Column, DataFrame, functions as F

from tidings import fixed_values as fv
from tidings.functions.dates import iso_date, rfc2822, sort_key
from tidings.functions.text import blank_to_null
from tidings.operators.retention import newest, with_sort_key
from tidings.schema import ORDER_COLUMNS


def latest_update(items: DataFrame) -> DataFrame:
    """The items discovered by the most recent run: all that share the newest first_seen.

    The maximum is over the full set, before any other filter.
    """
    last = items.agg(F.max("first_seen")).scalar()
    return items.where(F.col("first_seen") == last)


def filter_source_date(items: DataFrame, sources: list[str] | None = None,
                       start: str | None = None, end: str | None = None) -> DataFrame:
    """Items of some sources within an inclusive range of ISO dates.

    On the archive the range is also put as a range of months, which prunes partitions.
    """
    if sources:
        items = items.where(F.col("source").isin(sources))
    day = F.substring(sort_key(F.col("published"), F.col("first_seen")), 1, 10)
    if start:
        items = items.where(day >= start)
    if end:
        items = items.where((day <= end) & (day != ""))
    if "month" in items.columns and start:
        items = items.where(F.col("month") >= start[:7])
    if "month" in items.columns and end:
        items = items.where(F.col("month") <= end[:7])
    return items


def feed_entries(items: DataFrame, limit: int = fv.FEED_ITEMS,
                 order: list[str] = ORDER_COLUMNS) -> DataFrame:
    """The newest items as feed rows; an absent description or date stays null."""
    top = newest(with_sort_key(items), limit, order)
    return top.select(
        F.concat(F.lit("["), F.col("source_label"), F.lit("] "), F.col("title")).alias("title"),
        F.col("url").alias("link"),
        F.col("url").alias("guid"),
        blank_to_null(F.col("summary")).alias("description"),
        rfc2822(blank_to_null(F.col("sk"))).alias("pubDate"))


def newest_first(order: list[str] = ORDER_COLUMNS) -> list[Column]:
    """The order of published items: newest first, ties in insertion order."""
    return [F.desc(sort_key(F.col("published"), F.col("first_seen"))), *map(F.asc, order)]


def site_items(items: DataFrame, generated_at: str) -> DataFrame:
    """The items as published, stamped with the time of the build."""
    return items.withColumn("generated_at", F.lit(generated_at))


def with_dates(items: DataFrame) -> DataFrame:
    """Add `published_date` and `first_seen_date`, the ISO strings as DATE; impossible -> null."""
    return (items.withColumn("published_date", iso_date(F.col("published")))
            .withColumn("first_seen_date", iso_date(F.col("first_seen"))))
