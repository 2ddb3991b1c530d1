"""Landed HTML pages."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidings.sources.reading import origin, without


def scan_pages(spark: SparkSession, path: str, root: str, base_url: str) -> DataFrame:
    """HTML files -> (url, html), one row per file.

    Files mirror the site below the folder `root`, the last of this name in `path`:
    `<root>/a/b.html` is the page `<base_url>/a/b`. A page may also be a folder of parts,
    `<root>/a/b.html/part-...`, each a row of its own.
    """
    return read_pages(spark, path, root, base_url).drop("origin")


def read_pages(spark: SparkSession, path: str, root: str, base_url: str,
               skip: list[str] = ()) -> DataFrame:
    """The pages with `origin`, their file; files in `skip` are left out."""
    files = without(spark.read.text(path, wholetext=True, recursiveFileLookup=True), skip)
    folder = re.sub(r"^[a-z0-9]+:/*(?=/)", "", path)
    folder = folder[:folder.rindex(f"/{root}") + len(root) + 1]
    place = F.regexp_extract(
        F.url_decode("_metadata.file_path"), rf"\Q{folder}\E(/.*?)(?:\.html?(?:/part-[^/]*)?)?$", 1)
    return files.select(F.concat(F.lit(base_url.rstrip("/")), place).alias("url"),
                        F.col("value").alias("html"), origin().alias("origin"))
