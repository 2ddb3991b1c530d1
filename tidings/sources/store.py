"""The stores: live items, first-seen ledger, month archive, run log.

Layout below one root folder:

    live/<batch>/       items of one run; never rewritten
    ledger-<g>-<n>/     (id, first_seen) in n buckets by id, append only; generation g
    archive/            items by version and month; an upsert writes the months it touches anew,
                        as one version, and leaves all earlier files as they are
    commits/            (version, month, count, at) of every finished upsert
    manifest/           item count per month, JSON
    runs/               one row per finished run, append only

The run log is the commit record: readers take the live folder that the last finished run names.
If a run dies half way, the log still points at the previous live folder, and running again gives
the same result, because the archive upsert and the ledger append are idempotent.

The archive has a commit record of its own: a month is what the last version that names it holds.
The record of a version is one file, written after its months, so that readers see all of an
upsert or nothing of it, and an upsert that died is written over by the next. One writer at a time
is assumed. A version that was replaced stays for `retain_hours`, for readers that were planned before,
and goes with the next `vacuum`, which every run ends with.

The ledger is joined where it lies: its files are buckets of a table that each session registers for the
folder, so a batch too large to be broadcast is shuffled to the buckets, and the ledger never is. A vacuum
writes a ledger of many files anew, sorted, as the next generation; the last generation that was finished counts.

Each archived item has a digest of its content in a column of its own. (month, id, digest) and the places
are the archive's index: a narrow scan of the same files, committed with them.
"""

import hashlib
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.operators import archive as ar
from tidings.operators.publish import newest_first
from tidings.schema import (
    ARCHIVE_INDEX, ARCHIVED_ITEM, COMMIT, ITEM, ITEM_COLUMNS, LEDGER, ORDER_COLUMNS, RUN, STORED_ITEM, VERSIONED_ITEM,
)
from tidings.shared import LEAN, materialize, scratch, settings
from tidings.sources import files
from tidings.sources.reading import empty, read_or_empty


#: Files of the commit record, and files per bucket of the ledger, beyond which a vacuum writes them anew.
MAX_COMMIT_FILES, MAX_BUCKET_FILES = 10, 10

#: How items and the ledger are compressed; files that were compressed otherwise are read as well.
CODEC = "zstd"


@dataclass(frozen=True)
class Store:
    root: str
    retain_hours: float = 7 * 24
    #: Buckets of a new ledger, 32 or the shuffle partitions of the session that makes it if there are more. With
    #: fewer buckets than shuffle partitions Spark would rather shuffle the ledger too.
    ledger_buckets: int | None = None

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def runs(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, self.path("runs"), RUN)

    def last_run(self, spark: SparkSession):
        """The row of the last finished run, or None."""
        return self.runs(spark).orderBy(F.desc("batch")).limit(1).first()

    def live(self, spark: SparkSession) -> DataFrame:
        """Live items as of the last finished run; `newest_first` is the order they were written in."""
        last = self.last_run(spark)
        if last is None:
            return empty(spark, STORED_ITEM)
        return spark.read.schema(STORED_ITEM).parquet(last["live_path"])

    def _ledgers(self, spark: SparkSession) -> list[tuple[int, int]]:
        """(generation, buckets) of the ledgers that were finished."""
        found = []
        for name in files.children(spark, self.root):
            parts = re.fullmatch(r"ledger-(\d+)-(\d+)", name)
            if parts and "_SUCCESS" in files.children(spark, self.path(name)):
                found.append((int(parts[1]), int(parts[2])))
        return sorted(found)

    def _ledger_table(self, spark: SparkSession, generation: int, buckets: int) -> str:
        """The name of the bucketed table over a ledger's folder, registered anew if this session doesn't
        know it, with the files that are there now."""
        path = files.qualified(spark, self.path(f"ledger-{generation}-{buckets}"))
        name = "tidings_ledger_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, first_seen STRING) USING parquet "
                  f"CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{location}'")
        spark.catalog.refreshTable(name)
        return name

    def ledger(self, spark: SparkSession) -> DataFrame:
        """(id, first_seen) of every item ever encountered; an id may be there twice."""
        ledgers = self._ledgers(spark)
        if ledgers:
            return spark.table(self._ledger_table(spark, *ledgers[-1]))
        return read_or_empty(spark, self.path("ledger"), LEDGER)     # as an earlier version wrote it

    def commits(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, self.path("commits"), COMMIT)

    def months(self, spark: SparkSession) -> DataFrame:
        """(month, version, count) of the archive as of the last finished upsert."""
        return self.commits(spark).groupBy("month").agg(
            F.max_by("version", "version").alias("version"),
            F.max_by("count", "version").alias("count"))

    def _archive_files(self, spark: SparkSession) -> DataFrame | None:
        """The files in force, one version per calendar month, or None.

        The versions are looked up first: only their folders are listed, and of those only the months
        in force are kept when the scan is planned.
        """
        current = self.months(spark).select("version", "month").collect()
        if not current:
            return None
        root = self.path("archive")
        rows = spark.read.schema(VERSIONED_ITEM).option("basePath", root).parquet(
            *[f"{root}/version={v}" for v in sorted({r["version"] for r in current})])
        named = F.concat_ws("|", F.col("version").cast("string"), F.coalesce("month", F.lit("")))
        return rows.where(named.isin([f"{r['version']}|{r['month'] or ''}" for r in current]))

    def archive(self, spark: SparkSession) -> DataFrame:
        """The archive as of the last finished upsert."""
        rows = self._archive_files(spark)
        return empty(spark, ARCHIVED_ITEM) if rows is None else rows.select(*ARCHIVED_ITEM.fieldNames())

    def archive_index(self, spark: SparkSession) -> DataFrame:
        """Key, digest and place of what is archived; of the files only these columns are read."""
        rows = self._archive_files(spark)
        return empty(spark, ARCHIVE_INDEX) if rows is None else rows.select(*ARCHIVE_INDEX.fieldNames())

    def write_live(self, items: DataFrame, batch: int) -> str:
        """Newest first, ties in insertion order: the files of the folder in the order of their names."""
        path = self.path(f"live/{batch:012d}")
        (items.select(*STORED_ITEM.fieldNames()).orderBy(*newest_first()).write.mode("overwrite")
         .parquet(path, compression=CODEC))
        return path

    def append_ledger(self, additions: DataFrame) -> None:
        """Append to the buckets, one file a bucket. A run that dies and is run again may append ids twice."""
        spark = additions.sparkSession
        rows = additions.select(*LEDGER.fieldNames())
        ledgers = self._ledgers(spark)
        if ledgers:
            self._write_ledger(rows, *ledgers[-1])
        else:
            self._write_ledger(self.ledger(spark).unionByName(rows), 0, self._buckets(spark))

    def _buckets(self, spark: SparkSession) -> int:
        return self.ledger_buckets or max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def _write_ledger(self, rows: DataFrame, generation: int, buckets: int) -> None:
        name = self._ledger_table(rows.sparkSession, generation, buckets)
        rows.repartition(buckets, "id").sortWithinPartitions("id").write.insertInto(name)

    def compact_ledger(self, spark: SparkSession) -> None:
        """Write the ledger anew: an id once, a sorted file a bucket, in more buckets if the session has more shuffle
        partitions. Readers of the old files go on."""
        ledgers = self._ledgers(spark)
        if ledgers:
            generation, buckets = ledgers[-1][0], max(ledgers[-1][1], self._buckets(spark))
            files.delete(spark, self.path(f"ledger-{generation + 1}-{buckets}"))      # of a run that died
            once = self.ledger(spark).groupBy("id").agg(F.min("first_seen").alias("first_seen"))
            self._write_ledger(once, generation + 1, buckets)

    def upsert_archive(self, incoming: DataFrame, keys: DataFrame | None = None,
                       settled: DataFrame | None = None) -> None:
        """Merge `incoming` (with `month`) into its months; other months are not read or written.

        `keys` are the (month, id) of `incoming`, if they have been written and each has one row only. Then more of
        the incoming rows may come as `settled`: those that lie by month, and are written as they lie. The keys and
        places of what is overwritten are written first, so Spark knows how many they are. With few of them no
        archived row is shuffled: rows that stay are written by who read them, from files that lie by month
        already, and only what is new is gathered by month.
        """
        spark = incoming.sparkSession
        incoming = ar.with_digest(incoming.select(*ARCHIVED_ITEM.fieldNames()))
        if (incoming if keys is None else keys).isEmpty():
            return
        last = self.commits(spark).agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        path = self.path(f"archive/version={version}")
        with scratch(spark, "upsert") as folder, settings(spark, LEAN):
            unique = keys is not None
            if not unique:
                keys = materialize(incoming.select("month", "id").distinct(), "keys", folder)
            places = materialize(
                ar.touched_months(self.archive_index(spark), keys).join(keys, ["month", "id"], "left_semi")
                .select("month", "id", *ORDER_COLUMNS), "places", folder)
            rows = self._archive_files(spark)
            if rows is None:
                rows = empty(spark, VERSIONED_ITEM)
            held = ar.touched_months(rows.select(*incoming.columns), keys)
            untouched, written = ar.upsert_parts(held, incoming, places=places, unique=unique)
            write_archive(written, path)
            add_to_archive(untouched, path)
            if settled is not None:
                settled = ar.with_digest(settled.select(*ARCHIVED_ITEM.fieldNames()))
                add_to_archive(ar.upsert_parts(held, settled, places=places, unique=True)[1], path)
        counts = spark.read.schema(ARCHIVED_ITEM).parquet(path).groupBy("month").agg(
            F.count("*").alias("count"))
        self._append_commits(counts.select(
            F.lit(version).cast("long").alias("version"), "month", "count",
            F.lit(int(time.time() * 1000)).cast("long").alias("at")))

    def _append_commits(self, rows: DataFrame) -> None:
        """As one file, so that all of the rows are there or none."""
        (rows.select(*COMMIT.fieldNames()).coalesce(1).write.mode("append")
         .parquet(self.path("commits")))

    def vacuum(self, spark: SparkSession, retain_hours: float | None = None) -> list[str]:
        """Delete what was replaced over `retain_hours` ago, and write the commit record as one file.

        A month's version goes if its successor was committed before that time: readers planned since then
        have been reading the successor. A version that died before its commit isn't touched. The commit
        record is written anew, with what is left, before the old files of it go; rows that are there twice
        in between change nothing. Returns the folders deleted. Only names and the record itself come to the
        driver: one row per month and version on disk.
        """
        hours = self.retain_hours if retain_hours is None else retain_hours
        before = int((time.time() - hours * 3600) * 1000)
        log = list(files.children(spark, self.path("commits")))
        rows = [tuple(r) for r in self.commits(spark).distinct().collect()]
        by_month: dict = {}
        for row in sorted(rows, key=lambda r: r[0]):
            by_month.setdefault(row[1], []).append(row)
        keep, gone = [], []
        for months in by_month.values():
            for row, later in zip(months, [*months[1:], None], strict=True):
                (keep if later is None or (later[3] or 0) >= before else gone).append(row)
        deleted = [self._drop_month(spark, row[0], row[1]) for row in gone]
        if gone or len([x for x in log if x.endswith(".parquet")]) > MAX_COMMIT_FILES:
            self._append_commits(spark.createDataFrame(sorted(keep, key=repr), COMMIT))
            for name in log:
                files.delete(spark, self.path(f"commits/{name}"))
        return ([x for x in deleted if x] + self._vacuum_live(spark, before)
                + self._vacuum_ledger(spark, before))

    def _vacuum_ledger(self, spark: SparkSession, before: int) -> list[str]:
        """Compact a ledger of many files; earlier generations go when their successor is old enough."""
        ledgers = self._ledgers(spark)
        if ledgers and len(files.children(spark, self.path("ledger-%d-%d" % ledgers[-1]))) > (
                MAX_BUCKET_FILES * ledgers[-1][1]):
            self.compact_ledger(spark)
            ledgers = self._ledgers(spark)
        gone = []
        for earlier, later in zip(ledgers, ledgers[1:], strict=False):
            finished = files.children(spark, self.path("ledger-%d-%d" % later))["_SUCCESS"]
            if finished < before:
                gone.append(self.path("ledger-%d-%d" % earlier))
                files.delete(spark, gone[-1])
        return gone

    def _drop_month(self, spark: SparkSession, version: int, month: str | None) -> str | None:
        folder = self.path(f"archive/version={version}")
        names = [x for x in files.children(spark, folder) if x.startswith("month=")]
        for name in names:
            if files.partition_value(name) == month:
                files.delete(spark, f"{folder}/{name}")
                if len(names) == 1:
                    files.delete(spark, folder)
                return f"{folder}/{name}"
        return None

    def _vacuum_live(self, spark: SparkSession, before: int) -> list[str]:
        """Live folders of earlier runs whose successor is finished and old enough."""
        last = self.last_run(spark)
        if last is None:
            return []
        batches = sorted(files.children(spark, self.path("live")).items())
        current = last["live_path"].rsplit("/", 1)[1]
        gone = [f"{self.path('live')}/{name}"
                for (name, _), (later, changed) in zip(batches, batches[1:], strict=False)
                if later <= current and changed < before]
        for path in gone:
            files.delete(spark, path)
        return gone

    def write_manifest(self, spark: SparkSession) -> None:
        """Counts per month, newest first, from the commit record: no archived item is read."""
        counts = self.months(spark).select("month", "count").orderBy(F.desc("month"))
        counts.coalesce(1).write.mode("overwrite").json(self.path("manifest"))

    def has_merged(self, spark: SparkSession, stream: str, stream_batch: int) -> bool:
        """Whether a finished run has merged this batch of this stream."""
        return not self.runs(spark).where(
            (F.col("stream") == stream) & (F.col("stream_batch") == stream_batch)).isEmpty()

    def append_run(self, run: DataFrame) -> None:
        run.select(*RUN.fieldNames()).coalesce(1).write.mode("append").parquet(self.path("runs"))


def write_archive(items: DataFrame, path: str) -> None:
    """Write items by month into a folder of their own.

    The rebalance hint gathers each month into as few files as its size calls for: small months
    get one file, and AQE splits a month that outgrows the advisory partition size instead of
    sending it through one task.
    """
    (items.hint("rebalance", "month").write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("month").parquet(path, compression=CODEC))


def add_to_archive(items: DataFrame, path: str) -> None:
    """Add items that were read by month, as they were read: small files that one task reads become one file of
    each month, and no file is split further than its row groups."""
    items.write.mode("append").partitionBy("month").parquet(path, compression=CODEC)


# --- JSON interchange ---------------------------------------------------------------------------

def read_items_json(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """Items from JSON lines, as `write_items_json` leaves them, or, with `arrays`, from documents
    that hold an array of items each; missing = empty.

    They get places (batch 0) in the order of appearance.
    """
    items = read_or_empty(spark, path, ITEM, "json", multiLine=arrays)
    return items.select(
        "*", F.lit(0).cast("long").alias("batch"), F.input_file_name().alias("origin"),
        F.monotonically_increasing_id().alias("pos"))


def read_ledger_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Ledger from a JSON object {id: first_seen} per file; missing = empty.

    The object has an entry, or several, a line, as JSON is written with an indent; a line break never stands
    within a string. Every line is parsed for itself, so many tasks read an object of any size.
    An entry that is spread over lines is an error, not a loss. `whole` reads objects of any form, each in one
    row.
    """
    def entries(text):
        return F.from_json(text, "map<string,string>")

    lines = read_or_empty(spark, path, "value string", "text", wholetext=whole)
    if whole:
        return lines.select(F.explode(entries(F.col("value"))).alias("id", "first_seen"))
    text = F.btrim("value", F.lit(" \t\r"))
    inner = F.regexp_replace(F.regexp_replace(text, r"^\{", ""), r",$", "")
    inner = F.when(inner.rlike(r"^\s*\}?$"), F.lit("")).otherwise(inner)
    parsed = entries(F.concat(F.lit("{"), inner, F.lit("}")))
    # The braces of the object around the entries: one that closes it may follow the last entry.
    parsed = F.when(inner == "", F.create_map().cast("map<string,string>")).otherwise(parsed)
    broken = F.raise_error(F.concat(F.lit("no whole entries in the line: "), F.substring("value", 1, 200)))
    checked = F.when(parsed.isNull() | F.exists(F.map_values(parsed), lambda x: x.isNull()),
                     broken.cast("map<string,string>")).otherwise(parsed)
    return lines.select(F.explode(checked).alias("id", "first_seen"))


def write_items_json(items: DataFrame, path: str) -> None:
    """Items as JSON lines in UTF-8, non-ASCII characters as they are, null fields as null."""
    (items.select(*ITEM_COLUMNS).write.mode("overwrite").option("ignoreNullFields", "false")
     .json(path))
