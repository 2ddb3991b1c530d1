"""Normalization of source rows to the item schema."""

from pyspark.sql import Column, DataFrame, functions as F

from tidings import fixed_values as fv
from tidings.functions.text import strip, url_id
from tidings.operators.classify import Rules, item_text, with_category
from tidings.schema import ITEM_COLUMNS


def to_items(df: DataFrame, *, source: Column, source_label: Column, title: Column, url: Column,
             published: Column, summary: Column, tags: Column | None = None,
             hint: Column | None = None, carry: tuple[str, ...] = (),
             rules: Rules = fv.CATEGORY_RULES,
             hints: dict[str, str] = fv.REPO_CATEGORY_HINTS) -> DataFrame:
    """One item per row of `df`, plus the `carry` columns. A pure projection."""
    no_tags = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    staged = df.select(
        url_id(url).alias("id"),
        source.alias("source"),
        source_label.alias("source_label"),
        strip(title).alias("title"),
        url.alias("url"),
        published.alias("published"),
        none.alias("first_seen"),
        strip(F.coalesce(summary, F.lit(""))).alias("summary"),
        (no_tags if tags is None else F.coalesce(tags, no_tags)).alias("tags"),
        (none if hint is None else hint).alias("__hint"),
        *carry,
    )
    known = None if hint is None else F.col("__hint")
    text = item_text(F.col("title"), F.col("summary"))
    return with_category(staged, text, known, rules, hints).select(*ITEM_COLUMNS, *carry)


def blog_items(entries: DataFrame, carry: tuple[str, ...] = (), **rules) -> DataFrame:
    """Blog entries (title, url, published, summary, tags) as items."""
    return to_items(
        entries, source=F.lit(fv.SOURCE_BLOG), source_label=F.lit(fv.LABEL_BLOG),
        title=F.col("title"), url=F.col("url"), published=F.col("published"),
        summary=F.col("summary"), tags=F.col("tags"), carry=carry, **rules)


def release_items(entries: DataFrame, carry: tuple[str, ...] = (), **rules) -> DataFrame:
    """Repository releases (repo, title, url, published, summary) as items."""
    repo = F.col("repo")
    return to_items(
        entries, source=F.lit(fv.SOURCE_RELEASES),
        source_label=F.concat(F.lit(fv.LABEL_RELEASES_PREFIX), repo),
        title=F.concat(repo, F.lit(": "), F.col("title")), url=F.col("url"),
        published=F.col("published"), summary=F.col("summary"), tags=F.array(repo), hint=repo,
        carry=carry, **rules)


def note_items(notes: DataFrame, carry: tuple[str, ...] = (), **rules) -> DataFrame:
    """Release notes (title, url, published, summary, tags) as items."""
    return to_items(
        notes, source=F.lit(fv.SOURCE_NOTES), source_label=F.lit(fv.LABEL_NOTES),
        title=F.col("title"), url=F.col("url"), published=F.col("published"),
        summary=F.col("summary"), tags=F.col("tags"), carry=carry, **rules)
