"""Merge of a fresh batch into the live store."""

from pyspark.sql import DataFrame, functions as F

from tidings.operators.dedupe import keep_first, last_value_first_place
from tidings.operators.ledger import assign_first_seen, new_items
from tidings.operators.retention import with_sort_key
from tidings.schema import ORDER_COLUMNS


def merge(existing: DataFrame, fresh: DataFrame, ledger: DataFrame, as_of: str,
          order: list[str] = ORDER_COLUMNS) -> DataFrame:
    """All items after a run, one row per id, with `sk` and `known`.

    An item that is already live stays untouched. Of the others the first occurrence in the batch
    counts, and its first-seen date comes from the ledger if it was ever encountered before. Both
    inputs carry `order`, and the existing items' places come before the fresh ones'.

    Deduplication is the first step, so every join below sees an id once per side: a hot id cannot
    skew them.
    """
    stored = last_value_first_place(existing, ["id"], order)
    first = keep_first(fresh, ["id"], order)
    dated = assign_first_seen(new_items(first, stored), ledger, as_of)
    return with_sort_key(stored.withColumn("known", F.lit(True)).unionByName(dated))
