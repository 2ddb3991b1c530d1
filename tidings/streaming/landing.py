"""Incremental runs: Structured Streaming keeps track of which landed files were merged.

The run itself is the batch run; its state is the stores, so the stream needs no state of its own.
The run log keeps the number of each merged batch beside the id of its stream, so a batch that is
replayed although its run had finished is left out. One whose run had not finished is run again. A new
checkpoint, also one under an old path, is a new stream, whose batches count from 0 and are all merged.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidings import fixed_values as fv
from tidings.plans.daily import daily_run, union_sources
from tidings.sources.feeds import numbered
from tidings.sources.store import Store


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream, which its checkpoint was given when it was made."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def merge_new_files(records: DataFrame, to_items: Callable[[DataFrame], DataFrame], store: Store,
                    checkpoint: str, as_of: str, max_items: int | None = fv.MAX_ITEMS,
                    max_age_days: int | None = fv.MAX_AGE_DAYS) -> None:
    """Merge what landed since the last call into the store, then stop.

    `records` is `feeds.read_records` on `spark.readStream`; `to_items` turns a batch of numbered
    records into items with (origin, pos). `checkpoint` is a folder that all executors share and that outlives the run.
    """
    def run(batch: DataFrame, number: int) -> None:
        stream = stream_id(batch.sparkSession, checkpoint)
        if store.has_merged(batch.sparkSession, stream, number):
            return
        fresh = union_sources({"landed": to_items(numbered(batch))})
        daily_run(batch.sparkSession, store, fresh, as_of, max_items, max_age_days,
                  stream=(stream, number))

    query = (records.writeStream.foreachBatch(run)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
