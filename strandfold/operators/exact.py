"""Byte-exact copies: equal size first, then equal digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANGES = "array<struct<start: int, end: int>>"
MATCH_COLUMNS = ["a_id", "b_id", "kind", "overlap_seconds", "a_duplicated_percent", "b_duplicated_percent", "confidence", "a_sample_ranges", "b_sample_ranges"]


def same_size_suspects(items: DataFrame) -> DataFrame:
    """Items whose size comes more than once; only they need a digest."""
    many = items.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size_bytes")
    return items.join(many, "size_bytes", "left_semi")


def hashed_suspects(items: DataFrame, contents: DataFrame, content: str = "content") -> DataFrame:
    """Suspects with sha256 of their contents (item_id, content): sizes are compared first, and only what they leave is hashed."""
    suspects = same_size_suspects(items.drop("sha256"))
    return suspects.join(contents.select("item_id", content), "item_id").withColumn("sha256", F.sha2(content, 256)).drop(content)


def exact_groups(items: DataFrame) -> DataFrame:
    """(size_bytes, sha256, anchor, n) of digests that come more than once; anchor is the least id."""
    return items.groupBy("size_bytes", "sha256").agg(F.min("item_id").alias("anchor"), F.count(F.lit(1)).alias("n")).where("n > 1")


def exact_matches(items: DataFrame) -> DataFrame:
    """A star from each group's least id, wholly duplicated on both sides."""
    star = items.join(exact_groups(items).select("size_bytes", "sha256", "anchor"), ["size_bytes", "sha256"]).where("item_id <> anchor")
    first = items.select(F.col("item_id").alias("anchor"), F.col("duration_seconds").alias("anchor_duration"))
    none = F.array().cast(RANGES)
    return star.join(first, "anchor").select(
        F.col("anchor").alias("a_id"), F.col("item_id").alias("b_id"), F.lit("exact").alias("kind"),
        F.round(F.least("duration_seconds", "anchor_duration"), 3).alias("overlap_seconds"),
        F.lit(100.0).alias("a_duplicated_percent"), F.lit(100.0).alias("b_duplicated_percent"), F.lit(1.0).alias("confidence"),
        none.alias("a_sample_ranges"), none.alias("b_sample_ranges"),
    )


def exact_pair_keys(items: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(a, b) of all pairs in a digest group. Given candidate pairs, only those among them, found by their ends' digests: no group is expanded."""
    keyed = items.join(exact_groups(items).select("size_bytes", "sha256", "anchor"), ["size_bytes", "sha256"]).select("item_id", "anchor")
    left, right = keyed.select(F.col("item_id").alias("a"), "anchor"), keyed.select(F.col("item_id").alias("b"), "anchor")
    if pairs is None:
        return left.join(right, "anchor").where("a < b").select("a", "b")
    return pairs.join(left, "a").join(right.withColumnRenamed("anchor", "other"), "b").where("anchor = other").select("a", "b")
