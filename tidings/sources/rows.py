"""The items of a run, written once and picked by number.

A run decides by a few columns which items go where. The items themselves, which are most of the bytes, are written to a
folder of the run, each with a number, and come out of it when a store is written. The files are buckets by the task that
wrote them: a join with chosen numbers sends the numbers to the items, and no item is shuffled to be picked.
"""

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from tidings.sources import files

#: The number of an item, and the task that wrote it.
ROW, PART = "__row", "__part"

#: Buckets by the task meet chosen numbers that are dealt by the task only, although both are joined by number too.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

#: Buckets at least. With fewer than shuffle partitions Spark would rather shuffle the items.
MIN_BUCKETS = 32

#: Bytes of a month in the file of one task from which on that task writes the month as it is; parts of so many
#: tasks at most are named in a scan.
SETTLED_BYTES, MAX_NAMED = 4 << 20, 1000


class Rows:
    """Numbered rows in a folder. `close` forgets the table; who gave the folder deletes it."""

    def __init__(self, frame: DataFrame, folder: str):
        self.spark = frame.sparkSession
        self.name = f"tidings_rows_{uuid.uuid4().hex}"
        self.columns = frame.columns
        buckets = max(MIN_BUCKETS, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        numbered = with_part(frame.withColumn(ROW, F.monotonically_increasing_id()))
        schema = T.StructType([*frame.schema.fields, T.StructField(ROW, T.LongType()),
                               T.StructField(PART, T.IntegerType())])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        location = files.qualified(self.spark, folder).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet OPTIONS (compression 'zstd') "
                       f"CLUSTERED BY ({PART}) INTO {buckets} BUCKETS LOCATION '{location}'")
        numbered.select(*schema.fieldNames()).write.insertInto(self.name)

    def all(self) -> DataFrame:
        """All rows with their numbers."""
        return self.spark.table(self.name)

    def pick(self, chosen: DataFrame) -> DataFrame:
        """The rows that `chosen`, which has been written, names by ROW, each with the columns of `chosen` in place of
        its own. To be written within `settings(spark, IN_PLACE)`. Only files with chosen rows are read, if they are
        few."""
        own = [c for c in self.columns if c not in chosen.columns]
        there = with_part(chosen)
        mine = self.all().select(PART, ROW, *own)
        parts = [r[0] for r in there.select(PART).distinct().limit(MAX_NAMED + 1).collect()]
        if len(parts) <= MAX_NAMED:
            mine = mine.where(F.col(PART).isin(parts))
        return mine.join(there, [PART, ROW]).drop(PART, ROW)

    def settled(self, chosen: DataFrame, column: str) -> DataFrame:
        """(PART, `column`): the groups of `chosen` that take up SETTLED_BYTES of their task's file. There are no more
        than the files have room for."""
        each = self.all().groupBy(PART).agg((F.max("_metadata.file_size") / F.count("*")).alias("__each"))
        groups = with_part(chosen).groupBy(PART, column).agg(F.count("*").alias("__rows"))
        return (groups.join(each, PART).where(F.col("__rows") * F.col("__each") >= SETTLED_BYTES)
                .select(PART, column))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def with_part(chosen: DataFrame) -> DataFrame:
    """Add the task that wrote a row, which is the upper half of its number."""
    return chosen.withColumn(PART, F.shiftright(ROW, 33).cast("int"))
