"""Listing files and giving them ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.operators.groups import numbered

EXTENSIONS = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "mpg", "mpeg", "wmv", "ts")


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, size_bytes, modified) below the roots; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def discover_items(listing: DataFrame, roots: list[str], depth: int = -1, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Rows of a listing with one of the extensions, at most so many folders below a root (0: in the root, -1: any), each path in any case once."""
    path = F.col("path")
    inside = F.lit(False)
    for root in roots:
        base = root.rstrip("/") + "/"
        folders = F.size(F.split(F.substring(path, F.lit(len(base) + 1), F.length(path)), "/")) - 1
        inside = inside | (path.startswith(base) & (F.lit(depth < 0) | (folders <= depth)))
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kept = listing.where(inside & suffix.isin(*[e.lower() for e in extensions]))
    return kept.groupBy(F.lower("path").alias("_key")).agg(F.min_by(F.struct(*listing.columns), "path").alias("r")).select("r.*")


def assign_item_ids(items: DataFrame, name: str = "item_id") -> DataFrame:
    """Dense ids from 0 in the order of paths."""
    return numbered(items, ["path"], "_number").withColumn(name, F.col("_number") - 1).drop("_number")
