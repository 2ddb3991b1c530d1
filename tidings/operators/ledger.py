"""First-seen tracking: the ledger (id, first_seen) of every item ever encountered."""

from pyspark.sql import DataFrame, functions as F


def new_items(fresh: DataFrame, live: DataFrame) -> DataFrame:
    """Fresh items that are not live yet. Ids are reduced first, so that none weighs much."""
    return fresh.join(live.select("id").distinct(), "id", "left_anti")


def assign_first_seen(items: DataFrame, ledger: DataFrame, as_of: str) -> DataFrame:
    """Set `first_seen` from the ledger, else to the run date; `known` tells which.

    The ledger only grows while a batch stays small, so it is first cut to the ids of the batch.
    With a batch that Spark can broadcast the ledger is never shuffled; with a large one the
    aggregate and the second join reuse the partitioning of the first. The aggregate keeps the
    batch from being multiplied should an id be recorded twice.
    """
    recorded = (ledger.join(items.select("id").distinct(), "id", "left_semi")
                .groupBy("id").agg(F.min("first_seen").alias("__recorded")))
    columns = [c for c in items.columns if c != "first_seen"]
    return (items.select(*columns).join(recorded, "id", "left")
            .withColumn("first_seen", F.coalesce("__recorded", F.lit(as_of)))
            .withColumn("known", F.col("__recorded").isNotNull())
            .select(*items.columns, "known"))


def ledger_additions(dated: DataFrame) -> DataFrame:
    """Ledger rows to append after `assign_first_seen`: no second look at the ledger needed."""
    return dated.where(~F.col("known")).select("id", "first_seen")


def rebuild_ledger(sightings: DataFrame) -> DataFrame:
    """The ledger from the whole history (id, run_date).

    Dates are compared as DATE, a fixed-width value, so this is a hash aggregate with map-side
    combine; the minimum of strings would be a sort.
    """
    earliest = F.min(F.col("run_date").cast("date"))
    return (sightings.groupBy("id").agg(earliest.alias("first_seen"))
            .withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd")))
