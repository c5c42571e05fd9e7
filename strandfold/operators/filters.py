"""Filters over items and matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.params import TOLERANCE


def min_duration(items: DataFrame, least: float) -> DataFrame:
    return items.where(F.col("duration_seconds") >= least)


def short_items_out(items: DataFrame, matches: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Items of the least duration or more, and the matches between them."""
    kept = min_duration(items, least)
    ends = kept.select("item_id")
    left = matches.join(ends.withColumnRenamed("item_id", "a_id"), "a_id", "left_semi")
    return kept, left.join(ends.withColumnRenamed("item_id", "b_id"), "b_id", "left_semi").select(*matches.columns)


def min_duplicate_percent(matches: DataFrame, percent: float, scanned_at: float | None = None) -> DataFrame:
    """Matches with a side duplicated at least so far; missing percents are 100 for exact and 0 for other matches.

    scanned_at: the threshold of the scan; asking for less than it needs a new scan and is an error.
    """
    if scanned_at is not None and percent + TOLERANCE < scanned_at:
        raise ValueError(f"matches were scanned at {scanned_at} percent; {percent} needs a new scan")
    missing = F.when(F.col("kind") == "exact", 100.0).otherwise(0.0)
    most = F.greatest(F.coalesce("a_duplicated_percent", missing), F.coalesce("b_duplicated_percent", missing))
    return matches.where(most + TOLERANCE >= percent)
