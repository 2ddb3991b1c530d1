"""Failure isolation between sources."""

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.sources.reading import empty, is_missing

STATUS = "source string, status string, detail string"


def isolate(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]],
            schema) -> tuple[dict[str, DataFrame], DataFrame]:
    """Run each reader; one that fails yields an empty frame and the others go on.

    Returns the frames and a status table (source, status, detail), status being ok, missing or
    failed. Readers only plan their scans, so what can fail here is a missing or unreadable
    location; malformed records are isolated one by one by the scans themselves.
    """
    frames, rows = {}, []
    for name, reader in readers.items():
        try:
            frames[name] = reader()
            rows.append((name, "ok", ""))
        except PySparkException as error:
            frames[name] = empty(spark, schema)
            rows.append((name, "missing" if is_missing(error) else "failed",
                         error.getCondition() or type(error).__name__))
    return frames, spark.createDataFrame(rows, STATUS)


def record_status(records: DataFrame, complete) -> DataFrame:
    """Per document (`origin`): records read, and how many were unusable (not `complete`)."""
    usable = F.coalesce(complete, F.lit(False))
    return records.groupBy("origin").agg(
        F.count("*").alias("records"), F.count_if(~usable).alias("unusable"))
