"""Age and size retention of the merged items.

The cap needs only one row, the last one that fits: with it, live and archive are two sides of a
predicate. No anti join of the whole table, and the two sides cannot overlap or lose a row.

That row is selected by counting, the same way whatever the cap: items per day, a running sum, and the same
again within the day it ends in, by the rest of the key, until one row is left. No step sorts items, and a day
or a document that holds most of them is counted like any other.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from tidings.functions.dates import cutoff, sort_key
from tidings.schema import ORDER_COLUMNS
from tidings.shared import materialize, scratch

LIVE, ARCHIVE = "live", "archive"

#: A whole number is selected by its upper, middle and lower bits: (shift, mask).
DIGITS = ((42, -1), (21, (1 << 21) - 1), (0, (1 << 21) - 1))


class Edge(NamedTuple):
    """The last item that is kept: its sort key and its place, in the order of the place's columns."""
    sk: str
    place: tuple


def with_sort_key(items: DataFrame) -> DataFrame:
    return items.withColumn("sk", sort_key(F.col("published"), F.col("first_seen")))


def newest(items: DataFrame, n: int, order: list[str] = ORDER_COLUMNS) -> DataFrame:
    """The newest n items, newest first, ties in insertion order (a distributed top-n, for small n)."""
    return items.orderBy(F.desc("sk"), *order).limit(n)


def _boundary(keys: DataFrame, n: int, groups: dict[str, Column], newest_first: set[str]):
    """The group in which the n-th row lies, and how many rows of it are still to be counted.

    `groups` are the columns to group by, in order of rank. Counts are combined before they are shuffled;
    the running sum is over one row a group.
    """
    rank = [F.desc(c) if c in newest_first else F.asc(c) for c in groups]
    counts = keys.groupBy(*[e.alias(c) for c, e in groups.items()]).agg(F.count("*").alias("__rows"))
    upto = F.sum("__rows").over(Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, 0))
    row = (counts.withColumn("__upto", upto).where(F.col("__upto") >= n)
           .orderBy("__upto").limit(1).first())
    return row, n - (row["__upto"] - row["__rows"])


def nth_newest(items: DataFrame, n: int, order: list[str] = ORDER_COLUMNS) -> Edge | None:
    """The n-th newest item, or the last one if there are fewer; None of no items.

    One row a step comes to the driver. The steps: the day; the whole sort key with all columns of the place but
    the last; the last one, a number, by its bits.
    """
    with scratch(items.sparkSession, "keys") as folder:
        return _nth_newest(materialize(items.select("sk", *order), "keys", folder), n, order)


def _nth_newest(keys: DataFrame, n: int, order: list[str]) -> Edge | None:
    n = min(n, keys.count())
    if not n:
        return None
    found = {}

    def step(rows, n, groups, newest_first=frozenset()):
        row, n = _boundary(rows, n, groups, set(newest_first))
        for c, e in groups.items():
            found[c] = row[c]
            rows = rows.where(e.eqNullSafe(F.lit(row[c])))
        return rows, n

    rows, n = step(keys, n, {"__day": F.substring("sk", 1, 10)}, {"__day"})
    rows, n = step(rows, n, {c: F.col(c) for c in ("sk", *order[:-1])}, {"sk"})
    last = order[-1]
    if isinstance(keys.schema[last].dataType, IntegralType):
        for i, (shift, mask) in enumerate(DIGITS):
            digit = F.shiftright(F.col(last).cast("long"), shift).bitwiseAND(F.lit(mask).cast("long"))
            rows, n = step(rows, n, {f"__digit{i}": digit})
        parts = [None if found[f"__digit{i}"] is None else found[f"__digit{i}"] << shift
                 for i, (shift, _) in enumerate(DIGITS)]
        found[last] = None if parts[0] is None else sum(parts)
    else:
        step(rows, n, {last: F.col(last)})
    return Edge(found["sk"], tuple(found[c] for c in order))


def in_window(as_of: str, max_age_days: int | None) -> Column:
    """Age test on `sk`; zero or None disables it. Undated items are always too old."""
    return F.col("sk") >= cutoff(as_of, max_age_days) if max_age_days else F.lit(True)


def last_kept(items: DataFrame, as_of: str, max_items: int, max_age_days: int | None,
              order: list[str] = ORDER_COLUMNS) -> Edge | None:
    """The last item that both the age test and the cap let through, None if there is none."""
    return nth_newest(items.where(in_window(as_of, max_age_days)), max_items, order)


_UNKNOWN = object()


def with_placement(items: DataFrame, as_of: str, max_items: int | None,
                   max_age_days: int | None, order: list[str] = ORDER_COLUMNS,
                   last: Edge | None = _UNKNOWN) -> DataFrame:
    """Add `placement`: live or archive. `items` carries `sk` and has one row per id.

    With a cap, the last kept item is looked up at once, unless `last` is the result of `last_kept`.
    """
    stays = in_window(as_of, max_age_days)
    if max_items:
        if last is _UNKNOWN:
            last = last_kept(items, as_of, max_items, max_age_days, order)
        stays = stays & fits(items, last, order)
    return items.withColumn("placement", F.when(stays, F.lit(LIVE)).otherwise(F.lit(ARCHIVE)))


def fits(items: DataFrame, last: Edge | None, order: list[str]) -> Column:
    """Whether an item comes no later than the last one that is kept."""
    if last is None:
        return F.lit(False)
    place = F.struct(*[F.lit(x).cast(items.schema[c].dataType).alias(c)
                       for c, x in zip(order, last.place, strict=True)])
    return (F.col("sk") > last.sk) | ((F.col("sk") == last.sk) & (F.struct(*order) <= place))


def live_items(items: DataFrame, as_of: str, max_items: int | None, max_age_days: int | None,
               order: list[str] = ORDER_COLUMNS) -> DataFrame:
    """Only the live side, newest first."""
    placed = with_placement(items, as_of, max_items, max_age_days, order)
    return (placed.where(F.col("placement") == LIVE).drop("placement")
            .orderBy(F.desc("sk"), *order))


def archive_items(items: DataFrame, as_of: str, max_items: int | None, max_age_days: int | None,
                  order: list[str] = ORDER_COLUMNS) -> DataFrame:
    """Only the archive side."""
    placed = with_placement(items, as_of, max_items, max_age_days, order)
    return placed.where(F.col("placement") == ARCHIVE).drop("placement")
