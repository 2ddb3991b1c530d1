"""Keep-first and keep-last per key.

`row_number() = 1` is planned as a partial group limit before the shuffle: each map task sends at
most one row per key, so a key that holds a third of the table costs one row per task, not a third
of the shuffle. The columns nobody reads later are still pruned from the scan.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F


def _only_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; `order` has to be a total order within the key."""
    return _only_first(df, keys, [F.asc(c) for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _only_first(df, keys, [F.desc(c) for c in order])


def last_value_first_place(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the values of its last row, standing at the place of its first row.

    This is what overwriting an entry of an ordered collection does. Both parts are aggregates, so
    they combine on the map side.
    """
    values = [c for c in df.columns if c not in keys and c not in order]
    place = F.struct(*order)
    kept = df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), place).alias("__last"), F.min(place).alias("__place"))
    return kept.select(*keys, "__last.*", "__place.*").select(*df.columns)
