"""Reading what may not be there."""

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def origin() -> Column:
    """The document that a row of a scan comes from."""
    return F.col("_metadata.file_path")


def is_missing(error: Exception) -> bool:
    return isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"


def empty(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_or_empty(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                  **options) -> DataFrame:
    """`path` with a given schema (nothing is inferred); a missing path is an empty table."""
    reader = spark.read.format(fmt).schema(schema).options(**options)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if is_missing(error):
            return empty(spark, schema)
        raise


def spellings(documents: list[str]) -> list[str]:
    """The ways Spark writes a file's name: errors and scans differ in a local scheme's slashes and in escapes."""
    found = set()
    for name in documents:
        for plain in (name, unquote(name)):
            found.update((plain, re.sub(r"^file:/+", "file:/", plain), re.sub(r"^file:/+", "file:///", plain)))
    return sorted(found)


def without(scan: DataFrame, documents: list[str]) -> DataFrame:
    """A scan that leaves some documents out. They are ruled out by name when files are listed, so that
    they are not opened."""
    return scan.where(~origin().isin(spellings(documents))) if documents else scan


def only(scan: DataFrame, documents: list[str]) -> DataFrame:
    """A scan of some documents, as `origin` names them."""
    return scan.where(origin().isin(spellings(documents)) if documents else F.lit(False))
