"""Published outputs."""

from pyspark.sql import DataFrame

from tidings import fixed_values as fv
from tidings.operators.publish import feed_entries, newest_first, site_items
from tidings.schema import ITEM_COLUMNS, ORDER_COLUMNS


def write_site(items: DataFrame, path: str, generated_at: str) -> None:
    """The published items as JSON lines, each stamped with `generated_at`; null fields as null.

    Newest first, file by file in the order of their names; ties in insertion order, if the items carry
    their places.
    """
    order = [c for c in ORDER_COLUMNS if c in items.columns]
    ordered = items.orderBy(*newest_first(order)).select(*ITEM_COLUMNS)
    (site_items(ordered, generated_at).write.mode("overwrite")
     .option("ignoreNullFields", "false").json(path))


def write_feed(items: DataFrame, path: str, limit: int = fv.FEED_ITEMS) -> None:
    """The newest items as one XML document of RSS <item> rows below <channel>.

    Null fields are left out and text is escaped by the writer. One file, because it is one
    document of at most `limit` rows.
    """
    (feed_entries(items, limit).coalesce(1).write.mode("overwrite").format("xml")
     .option("rootTag", "channel").option("rowTag", "item").save(path))
