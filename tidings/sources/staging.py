"""Staging: every input of a run is read by a job of its own and written to the shared folder.

Only what was written whole is merged, so an input that fails while it is read, not only one that can't be
opened, leaves the others as they are. A document that can't be read (a broken archive, a lost block) is left
out and named; the other documents of the input are read again without it. What was read is counted per
document, from the staged rows.
"""

import re
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidings.shared import materialize
from tidings.sources.reading import empty, is_missing, origin, spellings
from tidings.sources.status import record_status

#: Unreadable documents of one input that are left out one by one; with more, the input has failed.
MAX_UNREADABLE = 20

OK, MISSING, FAILED = "ok", "missing", "failed"
INPUT = "input string, status string, detail string"
DOCUMENT = "input string, document string, status string, records bigint, unusable bigint"

_UNREADABLE = re.compile(r"\[FAILED_READ_FILE[^\]]*\] Encountered error while reading file (\S+?)\.\s")


def unreadable_document(error: Exception) -> str | None:
    """The document that a failed read names, if it names one."""
    found = _UNREADABLE.search(str(error))
    return found.group(1) if found else None


def _detail(error: Exception) -> str:
    named = error.getCondition() if isinstance(error, PySparkException) else None
    return named or (re.findall(r"\[([A-Z_.]+)\]", str(error)) or [type(error).__name__])[0]


class Staged(NamedTuple):
    rows: DataFrame
    status: str
    detail: str
    unreadable: list[str]


def stage(spark: SparkSession, name: str, read: Callable[[list[str]], DataFrame],
          schema: StructType) -> Staged:
    """Write what `read` gives and return the frame that reads it back; an empty one if that fails.

    `read` gets the documents to leave out. A failure of the plan or of the job is caught and reported; other
    errors, such as those of this program, are not.
    """
    unreadable: list[str] = []
    while True:
        try:
            return Staged(materialize(read(unreadable), f"staged-{name}"), OK, "", unreadable)
        except (PySparkException, Py4JError) as error:
            document = unreadable_document(error)
            if document and document not in unreadable and len(unreadable) < MAX_UNREADABLE:
                unreadable.append(document)
                continue
            status = MISSING if is_missing(error) else FAILED
            return Staged(empty(spark, schema), status, _detail(error), unreadable)


class Staging:
    """The inputs of a run, staged one after the other, and their status."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.inputs: dict[str, Staged] = {}
        self._documents: list[DataFrame] = []

    def records(self, name: str, location: str, read: Callable[[list[str]], DataFrame],
                usable: Column, schema: StructType) -> DataFrame:
        """Stage the records (with `origin`) of the documents under `location`."""
        staged = self.inputs[name] = stage(self.spark, name, read, schema)
        if staged.status == OK:
            self._documents.append(self._document_status(name, location, staged, usable))
        return staged.rows

    def _document_status(self, name: str, location: str, staged: Staged, usable: Column) -> DataFrame:
        # Names of files only: no content is read.
        listed = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(location)
                  .select(origin().alias("origin")))
        counted = listed.join(record_status(staged.rows, usable), "origin", "left")
        status = (F.when(F.col("origin").isin(spellings(staged.unreadable)), F.lit("unreadable"))
                  .when(F.col("records").isNull(), F.lit("empty")).otherwise(F.lit(OK)))
        none = F.lit(0).cast("bigint")
        return counted.select(
            F.lit(name).alias("input"), F.col("origin").alias("document"), status.alias("status"),
            F.coalesce("records", none).alias("records"), F.coalesce("unusable", none).alias("unusable"))

    def input_status(self) -> DataFrame:
        """(input, status, detail)."""
        return self.spark.createDataFrame(
            [(name, x.status, x.detail) for name, x in self.inputs.items()], INPUT)

    def document_status(self) -> DataFrame:
        """(input, document, status, records, unusable): `unreadable` ones were left out, `empty` ones hold no
        record, and of the others some records may be unusable."""
        whole = self.spark.createDataFrame([], DOCUMENT)
        for part in self._documents:
            whole = whole.unionByName(part)
        return whole
