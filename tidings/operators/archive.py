"""The month-partitioned archive."""

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from tidings.functions.dates import month_bucket, sort_key
from tidings.operators.dedupe import last_value_first_place
from tidings.schema import ORDER_COLUMNS


def with_month(items: DataFrame) -> DataFrame:
    """Add the archive `month` of each item (needs `sk`)."""
    return items.withColumn("month", month_bucket(F.col("sk")))


def touched_months(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """The part of the archive in the months that `incoming` touches.

    The months are reduced to distinct values first; on a table partitioned by month the semi join
    becomes partition pruning at run time. They are few however many rows there are, and broadcast, so that no
    archived row is sent to its month.
    """
    months = incoming.where(F.col("month") > "").select("month").distinct()
    return archive.join(F.broadcast(months), "month", "left_semi")


def content_digest(items: DataFrame, columns: list[str]) -> Column:
    """A 64-bit digest of some columns. Missing values count, and where a list has them."""
    parts = []
    for c in columns:
        is_list = isinstance(items.schema[c].dataType, ArrayType)
        parts += [F.to_json(c) if is_list else F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts)


def with_digest(items: DataFrame, order: list[str] = ORDER_COLUMNS) -> DataFrame:
    """Add `digest`, of all that an archived item is but its key and its place."""
    content = [c for c in items.columns if c not in (*order, "month", "id", "digest")]
    return items.withColumn("digest", content_digest(items, content))


def news(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """(month, id, held): what `incoming` would change in the archive, and whether it is there already.

    `index` is (month, id, digest) of the archive, `incoming` carries a digest. Only these three columns of
    either side are read and joined, and of the index only the months of `incoming`: a source that sends its
    whole history again costs a narrow scan, and no text travels. An archived item without a digest counts as
    changed.
    """
    batch = incoming.select("month", "id", "digest")
    held = touched_months(index, batch).select(
        "month", "id", F.col("digest").alias("__digest"), F.lit(True).alias("held"))
    both = batch.join(held, ["month", "id"], "left")
    return both.where(~F.col("digest").eqNullSafe(F.col("__digest"))).select(
        "month", "id", F.coalesce("held", F.lit(False)).alias("held")).distinct()


def upsert_parts(archive: DataFrame, incoming: DataFrame, order: list[str] = ORDER_COLUMNS,
                 index: DataFrame | None = None, places: DataFrame | None = None,
                 unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """The two halves of `upsert`: archived rows that stay as they are, and rows of `incoming`.

    `places` are the keys and places of those archived rows that `incoming` overwrites, if they are known. Written
    before, they tell Spark their size: with few of them, or none, neither half is shuffled. With `unique`,
    `incoming` has one row per (month, id).
    """
    keys = ["month", "id"]
    batch = incoming if unique else last_value_first_place(incoming, keys, order)
    if places is None:
        places = ((archive if index is None else index)
                  .join(batch.select(*keys), keys, "left_semi").select(*keys, *order))
        untouched = archive.join(batch.select(*keys), keys, "left_anti")
    else:
        untouched = archive.join(places.select(*keys), keys, "left_anti")
    replaced = batch.join(places.select(*keys, F.struct(*order).alias("__place")), keys, "left")
    placed = [F.coalesce(F.col("__place")[c], F.col(c)).alias(c) for c in order]
    others = [c for c in archive.columns if c not in keys and c not in order]
    return untouched, replaced.select(*keys, *others, *placed)


def upsert(archive: DataFrame, incoming: DataFrame, order: list[str] = ORDER_COLUMNS,
           index: DataFrame | None = None) -> DataFrame:
    """Archive rows overwritten and extended by `incoming`, per (month, id).

    Both frames have the same columns; `archive` has one row per (month, id), as this function
    leaves it. An overwritten row keeps its place in the month. `index` has the archive's keys and places,
    if they can be had without the archive.

    The archive is only filtered by the batch's keys, and its places are looked up in a second,
    narrow scan. So with a batch that Spark can broadcast no archived row is shuffled or sorted;
    with a larger one the joins are on (month, id), which spreads a month that holds a third of
    the archive like any other.
    """
    untouched, written = upsert_parts(archive, incoming, order, index)
    return untouched.unionByName(written)


def new_count(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row `new_count`: incoming (month, id) pairs the archive does not hold yet."""
    pairs = incoming.select("month", "id").distinct()
    return (pairs.join(archive.select("month", "id"), ["month", "id"], "left_anti")
            .agg(F.count("*").alias("new_count")))


def manifest(archive: DataFrame) -> DataFrame:
    """Item count per month, newest month first; `undated` sorts before all months."""
    return (archive.groupBy("month").agg(F.count("*").alias("count"))
            .orderBy(F.desc("month")))


def month_items(archive: DataFrame, month: str) -> DataFrame:
    """The items of one month, newest first; prunes to one partition."""
    return archive.where(F.col("month") == month).orderBy(
        F.desc(sort_key(F.col("published"), F.col("first_seen"))), *ORDER_COLUMNS)
