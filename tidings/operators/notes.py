"""Release-note enrichment: link list plus the sections of the recent month pages."""

from pyspark.sql import DataFrame, functions as F

from tidings import fixed_values as fv
from tidings.functions.dates import (
    in_recent_months, last_day_iso, month_name, month_number,
)
from tidings.functions.text import blank_to_null
from tidings.operators.extract import page_sections, section_bodies

KEYS = ["year", "month", "slug"]


def month_pages(pages: DataFrame, url_pattern: str = fv.MONTH_PAGE_URL) -> DataFrame:
    """The pages whose URL names a month, with `year` and `month`."""
    named = (pages.where(F.col("url").rlike(url_pattern))
             .withColumn("year", F.regexp_extract("url", url_pattern, 1).cast("int"))
             .withColumn("month", month_number(F.regexp_extract("url", url_pattern, 2))))
    return named.where(F.col("month").isNotNull())


def recent_pages(pages: DataFrame, as_of: str, count: int = fv.RECENT_MONTHS) -> DataFrame:
    """Only the month pages worth parsing: a predicate on literals, no join."""
    return pages.where(in_recent_months(F.col("year"), F.col("month"), as_of, count))


def month_sections(pages: DataFrame, order: list[str],
                   heading: str = fv.SECTION_HEADING) -> DataFrame:
    """Body and exact date per (year, month, slug) of month pages (year, month, html, order).

    Of a repeated heading the last body counts, and the last exact date there is: a later heading
    without a date does not erase one. Both are map-side combined aggregates.
    """
    sections = section_bodies(page_sections(pages, heading))
    place = F.struct(*order, "pos")
    dated = F.when(F.col("exact_date").isNotNull(), place)
    return sections.groupBy(*KEYS).agg(
        F.max_by("body", place).alias("body"), F.max_by("exact_date", dated).alias("exact_date"))


def with_fallbacks(links: DataFrame, summary_format: str = fv.NOTES_SUMMARY_FORMAT) -> DataFrame:
    """Add summary, published and tags to links (year, month, body, exact_date).

    Without a body the summary is a generated sentence; without an exact date the item is dated to
    the last day of its month and tagged so.
    """
    sentence = F.format_string(summary_format, month_name(F.col("month")), F.col("year"))
    exact = F.col("exact_date")
    return (
        links
        .withColumn("summary", F.coalesce(blank_to_null(F.col("body")), sentence))
        .withColumn("published", F.coalesce(exact, last_day_iso(F.col("year"), F.col("month"))))
        .withColumn("tags", F.when(exact.isNotNull(), F.array().cast("array<string>"))
                    .otherwise(F.array(F.lit(fv.APPROX_DATE_TAG)))))


def enrich_links(links: DataFrame, sections: DataFrame) -> DataFrame:
    """Links with summary, published and tags; links without a section fall back."""
    return with_fallbacks(links.join(sections, KEYS, "left"))
