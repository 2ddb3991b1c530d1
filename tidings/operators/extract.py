"""Extraction from HTML: anchors, headed sections, meta descriptions.

All of it is per row, so a page is parsed where it is read. What is extracted is exploded and the
page text dropped before anything shuffles.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tidings import fixed_values as fv
from tidings.functions.dates import drop_leading_date, leading_date, month_number
from tidings.functions.text import blank_to_null, clean_title, with_plain_text
from tidings.operators.dedupe import keep_first


def with_matches(df: DataFrame, text: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """One row per match of `pattern` in `text`: its position `pos` and the named groups.

    `text` is dropped.
    """
    others = [c for c in df.columns if c != text]
    found = df.select(
        *others, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0))
        .alias("pos", "__match"))
    parts = [F.regexp_extract("__match", pattern, i).alias(name) for name, i in groups.items()]
    return found.select(*others, F.col("pos").cast("long").alias("pos"), *parts)


def with_titles(links: DataFrame, inner: str = "inner") -> DataFrame:
    """Replace the inner HTML by a clean `title` and drop the links left without one."""
    titled = links.withColumn("title", clean_title(F.col(inner))).drop(inner)
    return titled.where(F.col("title") != "")


def page_links(pages: DataFrame, pattern: str, keys: list[str], order: list[str],
               href: int = 1, inner: int = 2) -> DataFrame:
    """Links of any pages: the first of each `keys`, then only those with a title.

    The order matters: a first link without a title hides a later one to the same place.
    """
    links = with_matches(pages, "html", pattern, {"href": href, "inner": inner})
    return with_titles(keep_first(links, keys, order))


def note_links(pages: DataFrame, base_url: str, order: list[str],
               pattern: str = fv.NOTE_LINK) -> DataFrame:
    """Release-note links (year, month, slug, title, url) of index pages (html, order columns)."""
    parts = {"path": 1, "year_text": 2, "month_name": 3, "slug": 4, "inner": 5}
    links = (
        with_matches(pages, "html", pattern, parts)
        .withColumn("month", month_number(F.col("month_name")))
        .where(F.col("month").isNotNull())
        .withColumn("year", F.col("year_text").cast("int"))
        .withColumn("url", F.concat(F.lit(base_url), F.col("path")))
        .drop("path", "year_text", "month_name"))
    return with_titles(keep_first(links, ["url"], [*order, "pos"]))


def page_sections(pages: DataFrame, heading: str = fv.SECTION_HEADING, slug_group: int = 1,
                  last_chars: int = fv.LAST_SECTION_CHARS) -> DataFrame:
    """One row per headed section: `pos`, `slug` and its HTML `section`; `html` is dropped.

    A section ends where the next heading starts. The last one has no such end and is bounded to
    `last_chars` characters.
    """
    others = [c for c in pages.columns if c != "html"]
    html = F.col("html")
    staged = pages.select(
        *others,
        F.regexp_extract_all(html, F.lit(heading), slug_group).alias("__slugs"),
        F.split(html, heading, -1).alias("__texts"))
    count = F.size("__slugs")
    exploded = staged.select(
        *others, count.alias("__count"),
        F.posexplode(F.arrays_zip(
            F.col("__slugs").alias("slug"),
            F.slice("__texts", F.lit(2), count).alias("text"))).alias("pos", "__part"))
    text = F.col("__part.text")
    is_last = F.col("pos") == F.col("__count") - 1
    return exploded.select(
        *others, F.col("pos").cast("long").alias("pos"), F.col("__part.slug").alias("slug"),
        F.when(is_last, F.substring(text, 1, last_chars)).otherwise(text).alias("section"))


def section_bodies(sections: DataFrame, max_chars: int = fv.SUMMARY_MAX_CHARS) -> DataFrame:
    """Turn `section` HTML into a plain `body`, moving a leading date line to `exact_date`."""
    plain = with_plain_text(sections, "section", "__body", max_chars).drop("section")
    return (plain.withColumn("exact_date", leading_date(F.col("__body")))
            .withColumn("body", drop_leading_date(F.col("__body"))).drop("__body"))


def meta_description(html: Column) -> Column:
    """Content of the first description meta tag, in either attribute order; empty -> null."""
    def content(group: int) -> Column:
        return blank_to_null(F.regexp_extract(html, fv.META_DESCRIPTION, group))

    return F.coalesce(content(1), content(2))


def with_post_summary(entries: DataFrame, posts: DataFrame) -> DataFrame:
    """Replace the teaser `summary` by the description of the entry's own page, if it has one.

    `posts` is (url, html), one row per url. It is reduced to the description before the join, so
    no page text is shuffled. Entries without a page, and pages without a usable description, keep
    the cleaned teaser.
    """
    described = posts.select("url", meta_description(F.col("html")).alias("__meta"))
    described = with_plain_text(described.where(F.col("__meta").isNotNull()), "__meta",
                                "__description").select("url", "__description")
    teaser = with_plain_text(entries, "summary", "__teaser")
    joined = teaser.join(described, "url", "left")
    return (joined.withColumn("summary", F.coalesce(
        blank_to_null(F.col("__description")), F.col("__teaser")))
        .drop("__description", "__teaser").select(*entries.columns))
