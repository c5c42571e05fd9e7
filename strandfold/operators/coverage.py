"""Ranges of time bins, and how much of an item others cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.functions import kernels as K
from strandfold.operators.components import connected_components
from strandfold.operators.exact import RANGES


def compress_ranges(bins: DataFrame, keys: list[str], at: str = "bin") -> DataFrame:
    """(keys, start, end): greatest inclusive ranges of each key's distinct bins."""
    island = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
    return bins.select(*keys, at).distinct().withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("_island")


def expand_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bin) of (keys, start, end)."""
    return ranges.select(*keys, F.explode(F.sequence("start", "end")).alias("bin"))


def normalize_coverage(ranges: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, start, end): ranges one bin apart join; a start at bin 1 goes to 0, an end one short of the last bin to the last.

    ranges: greatest ranges with the number n of bins of their key.
    """
    order = Window.partitionBy(*keys).orderBy("start")
    new = F.when(F.col("start") - F.lag("end").over(order) <= 2, 0).otherwise(1)
    grouped = ranges.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy(*keys, n, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(
        *keys, F.when(F.col("start") <= 1, 0).otherwise(F.col("start")).alias("start"), F.when(F.col("end") >= F.col(n) - 2, F.col(n) - 1).otherwise(F.col("end")).alias("end")
    )


def normalize_array(bins: Column, n: Column) -> Column:
    """The same on a sorted array of distinct bins, as bins."""
    last = n.cast("int") - 1
    filled = F.flatten(F.transform(bins, lambda x, k: F.when(F.get(bins, k + 1) - x == 2, F.array(x, x + 1)).otherwise(F.array(x))))
    first = F.when(F.array_min(bins) <= 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    end = F.when(F.array_max(bins) >= last - 1, F.array(last)).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.concat(first, filled, end)))


def ranges_of_array(bins: Column) -> Column:
    """Array of {start, end} of a sorted array of distinct bins."""
    starts = F.filter(bins, lambda x, k: (k == 0) | (x - F.get(bins, k - 1) > 1))
    ends = F.filter(bins, lambda x, k: F.coalesce(F.get(bins, k + 1) - x > 1, F.lit(True)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end"))).cast(RANGES)


def bins_of_ranges(ranges: Column) -> Column:
    return F.flatten(F.transform(ranges, lambda r: F.sequence(r["start"], r["end"])))


def sides(matches: DataFrame) -> DataFrame:
    """(match_id, kind, item_id, other_id, ranges, percent): every match once from each end."""
    cols = {"a": "b", "b": "a"}
    rows = [
        matches.select(
            "match_id", "kind", F.col(f"{x}_id").alias("item_id"), F.col(f"{y}_id").alias("other_id"),
            F.coalesce(F.col(f"{x}_sample_ranges"), F.array().cast(RANGES)).alias("ranges"), F.col(f"{x}_duplicated_percent").alias("percent"),
        )
        for x, y in cols.items()
    ]
    return rows[0].unionByName(rows[1])


def relation_bins(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """(match_id, item_id, other_id, kind, bin): the bins of each side; an exact match covers all. counts: (item_id, n)."""
    known = sides(matches).join(counts, "item_id")
    every = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n").cast("int") - 1))
    bins = F.when(F.col("kind") == "exact", every).otherwise(F.array_distinct(bins_of_ranges(F.col("ranges"))))
    return known.select("match_id", "item_id", "other_id", "kind", F.explode(bins).alias("bin"))


def item_counts(items: DataFrame, interval: float) -> DataFrame:
    """(item_id, n): detailed samples, or what the duration holds."""
    return items.select("item_id", K.sample_count(F.col("detailed_sample_count"), F.col("duration_seconds"), interval).alias("n"))


def exact_classes(items: DataFrame, matches: DataFrame) -> DataFrame:
    """(item_id, class_id): the least id reachable by exact matches, for every item."""
    edges = matches.where("kind = 'exact'")
    found = connected_components(edges, "a_id", "b_id").select(F.col("node").alias("item_id"), F.col("component").alias("class_id"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("class_id", "item_id").alias("class_id"))


def exact_sources(asked: DataFrame, keepers: DataFrame, classes: DataFrame) -> DataFrame:
    """(scope, item_id, source, n_sources) of asked items with a kept exact copy other than themselves.

    The copies of a class are told by one of them, the least or for that one the greatest, and their number:
    a class of n copies gives n rows, not n * (n - 1).
    """
    ends = keepers.join(classes, "item_id").groupBy("scope", "class_id").agg(F.min("item_id").alias("low"), F.max("item_id").alias("high"), F.countDistinct("item_id").alias("n"))
    kept = keepers.select("scope", "item_id", F.lit(1).alias("itself")).distinct()
    own = asked.join(classes, "item_id").join(ends, ["scope", "class_id"]).join(kept, ["scope", "item_id"], "left")
    n = F.col("n") - F.coalesce("itself", F.lit(0))
    return own.where(n > 0).select("scope", "item_id", F.when(F.col("low") == F.col("item_id"), F.col("high")).otherwise(F.col("low")).alias("source"), n.alias("n_sources"))


def covered_by(asked: DataFrame, keepers: DataFrame, matches: DataFrame, items: DataFrame, interval: float, classes: DataFrame | None = None) -> DataFrame:
    """(scope, item_id, covered_percent, sources, n_sources) of asked (scope, item_id) under keepers (scope, item_id).

    A keeper reachable over exact matches, also through items that are not kept, covers all; sources then
    names one such keeper and n_sources counts them. Else the direct matches to keepers cover the union of
    their bins, and sources names all of these keepers.
    """
    classes = exact_classes(items, matches) if classes is None else classes
    exact = exact_sources(asked, keepers, classes).select("scope", "item_id", "source", F.col("n_sources").alias("n_exact"))
    counts = item_counts(items, interval)
    direct = relation_bins(matches.where("kind <> 'exact'"), counts).select("item_id", "other_id", "bin")
    scoped = asked.join(direct, "item_id").join(keepers.select("scope", F.col("item_id").alias("other_id")), ["scope", "other_id"], "left_semi")
    part = scoped.groupBy("scope", "item_id").agg(F.countDistinct("bin").alias("bins"), F.array_sort(F.collect_set("other_id")).alias("part_sources"))
    joined = asked.join(counts, "item_id").join(exact, ["scope", "item_id"], "left").join(part, ["scope", "item_id"], "left")
    percent = F.least(F.lit(100.0), 100.0 * F.coalesce("bins", F.lit(0)) / F.col("n"))
    sources = F.when(F.col("source").isNotNull(), F.array("source")).otherwise(F.coalesce("part_sources", F.array().cast("array<long>")))
    return joined.select(
        "scope", "item_id", F.when(F.col("source").isNotNull(), 100.0).otherwise(percent).alias("covered_percent"),
        sources.alias("sources"), F.coalesce("n_exact", F.size(sources)).cast("long").alias("n_sources"),
    )


def duplicate_time_ranges(matches: DataFrame, items: DataFrame, interval: float) -> DataFrame:
    """(item_id, start_seconds, end_seconds): merged ranges that any match duplicates, in seconds, within the duration."""
    bins = relation_bins(matches, item_counts(items, interval)).select("item_id", "bin")
    ranges = compress_ranges(bins, ["item_id"]).join(items.select("item_id", "duration_seconds"), "item_id")
    return ranges.where(F.col("start") * interval < F.col("duration_seconds")).select(
        "item_id", F.round(F.greatest(F.lit(0.0), F.col("start") * interval), 3).alias("start_seconds"),
        F.round(F.least("duration_seconds", (F.col("end") + 1) * interval), 3).alias("end_seconds"),
    )


def duplicated_seconds(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("item_id").agg(F.sum(F.col("end_seconds") - F.col("start_seconds")).alias("seconds"))
