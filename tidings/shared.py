"""The shared folder of the session, and materializing an intermediate frame in it."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidings.sources import files

#: The shuffle files of a job go when the job ends, not when the driver happens to collect its garbage. No frame
#: may be executed twice under it.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` as the cluster names it.

    Only a local master may fall back to a temporary folder, because there the driver and the
    executors are one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "tidings-shared")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tidings/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder in the shared folder for what is needed no longer than the block; it is deleted in the end, also of a
    block that fails."""
    folder = new_path(spark, name)
    try:
        yield folder
    finally:
        files.delete(spark, folder)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings within a block."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, name: str, folder: str | None = None, **options) -> DataFrame:
    """Write `df` to the shared folder, or to a folder in it, once and return the frame that reads it back.

    Used where one result has several consumers. Unlike cached blocks the files survive the loss
    of executors, and unlike an RDD checkpoint they stay columnar, so each consumer still prunes
    columns and pushes filters down.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}" if folder else new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
