"""Files of the shared storage, by Hadoop's file system interface: listing and deleting, which readers and
writers of frames don't offer. Works on whatever storage Spark reads."""

from urllib.parse import unquote

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def children(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder, with the time of their last change in milliseconds; none if it isn't there."""
    system, where = _located(spark, path)
    if not system.exists(where):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in system.listStatus(where)}


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, whatever the working directory of who reads it."""
    system, where = _located(spark, path)
    return system.makeQualified(where).toString()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder and what is in it; nothing happens if it isn't there."""
    system, where = _located(spark, path)
    system.delete(where, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file of its own name, over any that is there."""
    system, where = _located(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def partition_value(name: str) -> str | None:
    """The value in the name of a partition's folder."""
    value = unquote(name.partition("=")[2])
    return None if value == "__HIVE_DEFAULT_PARTITION__" else value
