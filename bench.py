"""Wall time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores). Each query is executed to the end by
the noop sink, so that no column is pruned and nothing is collected. Before it is timed, a query runs once
over the smallest tables, so that the time isn't that of compiling it; short ones are timed three times and the
median counts. The text queries are timed a second time over copies of their tables in several
files (`split`), because a table in one file is one task.
"""

import json
import os
import re
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from tidings.plans import catalog

HEADLINE = [
    "url_id", "html_to_text", "categorize_taxonomy", "normalize_items", "page_links",
    "note_links", "month_sections", "enrich_links", "enrich_summary", "dedupe_first",
    "dedupe_last", "seen_ledger", "assign_first_seen", "merge_live", "merge_archive",
    "retention_live", "retention_archive", "retention_large_cap", "archive_upsert",
    "archive_manifest", "latest_update", "feed_top_n", "scan_rss", "scan_atom", "daily_run",
]
TEXT = ["html_to_text", "categorize_taxonomy", "normalize_items", "note_links", "month_sections",
        "enrich_links", "enrich_summary", "scan_rss"]
TEXT_TABLES = ["documents", "pages", "orders"]
SMALLEST = "/root/testdata/sf0.001"
#: Seconds below which a query is timed three times.
SHORT = 3.0


def session(cpus: str, scratch: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate())


def timed(query, spark: SparkSession, sf_dir: str) -> float:
    def once() -> float:
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    first = once()
    return round(statistics.median([first, once(), once()]) if first < SHORT else first, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="tidings-bench-")
    spark = session(cpus, scratch)
    spark.sparkContext.setLogLevel("ERROR")
    for table in TEXT_TABLES:
        (spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(int(cpus))
         .write.parquet(f"{scratch}/tables/{table}.parquet"))
    queries, seconds, split = catalog.queries(), {}, {}
    for name in HEADLINE:
        if os.path.isdir(SMALLEST):
            queries[name](spark, SMALLEST).write.format("noop").mode("overwrite").save()
        seconds[name] = timed(queries[name], spark, sf_dir)
        if name in TEXT:
            split[name] = timed(queries[name], spark, f"{scratch}/tables")
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "split": split,
        "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
