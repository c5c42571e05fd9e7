"""What may be removed from a group without losing anything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.functions import kernels as K
from strandfold.operators.coverage import exact_classes, item_counts, relation_bins
from strandfold.operators.groups import group_coverage
from strandfold.operators.places import placed
from strandfold.params import TOLERANCE

STRATEGIES = ("delete-shallower", "delete-shorter-name", "delete-numbered-name", "delete-fully-covered")


def contained_counts(members: DataFrame, used: DataFrame, matches: DataFrame, items: DataFrame, interval: float, min_coverage: float) -> DataFrame:
    """(group_id, item_id, contained): members that an item covers at least min_coverage of, while they cover less of it."""
    counts = item_counts(items, interval)
    classes = exact_classes(items, matches)
    bins = relation_bins(matches, counts).join(used, "match_id").groupBy("group_id", "item_id", "other_id").agg(F.countDistinct("bin").alias("bins"), F.bool_or(F.col("kind") == "exact").alias("exact"))
    percent = F.when(F.col("exact"), 100.0).otherwise(F.least(F.lit(100.0), 100.0 * F.col("bins") / F.col("n")))
    covered = durable(bins.join(counts, "item_id").select("group_id", "item_id", "other_id", (percent + TOLERANCE).alias("c")), "covered")
    back = covered.select("group_id", F.col("item_id").alias("other_id"), F.col("other_id").alias("item_id"), F.col("c").alias("back"))
    inside = covered.join(back, ["group_id", "item_id", "other_id"]).where((F.col("c") >= min_coverage) & (F.col("back") < min_coverage))
    found = inside.groupBy("group_id", F.col("other_id").alias("item_id")).agg(F.count(F.lit(1)).alias("contained"))
    return members.join(found, ["group_id", "item_id"], "left").select("group_id", "item_id", F.coalesce("contained", F.lit(0)).alias("contained"))


def strategy_columns(strategy: str | Callable[[DataFrame], list[Column]], roots: list[str]) -> Callable[[DataFrame], list[Column]]:
    """The ordering columns of a strategy; a function of the same kind is taken as it is."""
    if callable(strategy):
        return strategy
    path = F.col("path")
    first = {
        "delete-shallower": [K.relative_folder_depth(path, F.array(*map(F.lit, roots)) if roots else F.array().cast("array<string>"))],
        "delete-shorter-name": [F.length(K.file_name(path))],
        "delete-numbered-name": [F.when(K.mixed_alphanumeric_name(path), 0).otherwise(1)],
        "delete-fully-covered": [F.col("contained"), -F.col("covered_percent")],
    }
    if strategy not in first:
        raise ValueError(f"not a strategy: {strategy}")
    return lambda rows: [*first[strategy], K.quality_key(F.col("width"), F.col("height"), F.col("size_bytes"), F.col("duration_seconds"), path)]


def removal_priority(members: DataFrame, used: DataFrame, matches: DataFrame, items: DataFrame, strategy, interval: float, min_coverage: float, roots: list[str] = ()) -> DataFrame:
    """(group_id, item_id, place): the order in which members are tried for removal."""
    rows = members.join(items.select("item_id", "path", "width", "height", "size_bytes", "duration_seconds"), "item_id")
    if strategy == "delete-fully-covered":
        rows = rows.join(contained_counts(members, used, matches, items, interval, min_coverage), ["group_id", "item_id"])
        rows = rows.join(group_coverage(members, used, matches, items, interval).select("group_id", "item_id", "covered_percent"), ["group_id", "item_id"])
    by = [c.alias(f"_by{k}") for k, c in enumerate(strategy_columns(strategy, list(roots))(rows))]
    told = placed(rows.select("group_id", "item_id", *by), "group_id", [F.col(f"_by{k}") for k in range(len(by))] + [F.col("item_id")])
    return told.select("group_id", "item_id", (F.col("place") + 1).cast("int").alias("place"))


def recommend_removals(members: DataFrame, used: DataFrame, matches: DataFrame, items: DataFrame, strategy, interval: float, min_coverage: float, roots: list[str] = ()) -> DataFrame:
    """(group_id, item_id, place): members removed in the strategy's order while those left cover them; one always stays.

    The walk through a group's order is taken in rounds over all groups at once. Of exact copies all but the
    last in order go: whenever one of them is tried, the last is still there. The others depend on direct
    matches only, with the group's others that come before them; those that come later are there when they
    are tried. An item is settled in a round if the bins of those that surely stay suffice to remove it, or
    those of all that may stay don't suffice, which holds at the latest when all before it are settled. Bins
    are rows, and no group meets in a task.
    """
    order = durable(removal_priority(members, used, matches, items, strategy, interval, min_coverage, roots), "order")
    if min_coverage <= TOLERANCE:  # anything may go but what is tried last
        last = order.groupBy("group_id").agg(F.max("place").alias("last"))
        return order.join(last, "group_id").where("place < last").select("group_id", "item_id", "place")
    classes = exact_classes(items, matches)
    who = order.join(classes, "item_id").join(item_counts(items, interval), "item_id")
    last = who.groupBy("group_id", "class_id").agg(F.max("place").alias("last"))
    who = durable(who.join(last, ["group_id", "class_id"]).select("group_id", "item_id", "place", "n", (F.col("place") < F.col("last")).alias("copy")), "who")
    copies, left = who.where("copy").select("group_id", "item_id", "place"), who.where("not copy").drop("copy")
    bins = relation_bins(matches.where("kind <> 'exact'"), item_counts(items, interval)).where("item_id <> other_id").join(used, "match_id")
    bins = bins.select("group_id", "item_id", "other_id", "bin").distinct()
    other = who.select("group_id", F.col("item_id").alias("other_id"), F.col("place").alias("other_place"), "copy")
    met = bins.join(left, ["group_id", "item_id"]).join(other, ["group_id", "other_id"])
    # A copy that comes earlier is gone, one that comes later is there, as is any other that comes later.
    met = durable(met.where((F.col("other_place") > F.col("place")) | ~F.col("copy")).withColumn("sure", F.col("other_place") > F.col("place")), "met")
    key = ["group_id", "item_id"]
    sure = met.where("sure").select(*key, "bin").distinct()
    maybe = durable(met.where("not sure").select(*key, "other_id", "bin").join(sure, [*key, "bin"], "left_anti"), "maybe")
    held = sure.groupBy(*key).agg(F.count(F.lit(1)).alias("sure"))
    open_ = durable(left.join(held, key, "left").withColumn("sure", F.coalesce("sure", F.lit(0))), "open")
    gone = []
    while True:
        more = maybe.select(*key, "bin").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("more"))
        enough = lambda n: F.least(F.lit(100.0), 100.0 * n / F.col("n")) + TOLERANCE >= min_coverage
        told = open_.join(more, key, "left").withColumn("more", F.coalesce("more", F.lit(0)))
        told = durable(told.withColumn("goes", F.when(enough(F.col("sure")), True).when(~enough(F.col("sure") + F.col("more")), False)).drop("more"), "told")
        gone.append(told.where("goes").select("group_id", "item_id", "place"))
        open_ = told.where("goes is null").drop("goes")
        if open_.isEmpty():
            break
        waiting = maybe.join(open_.select(*key), key, "left_semi")
        fate = told.where("goes is not null").select("group_id", F.col("item_id").alias("other_id"), "goes")
        met = durable(waiting.join(fate, ["group_id", "other_id"], "left"), "met")
        stays = met.where("not goes").select(*key, "bin").distinct()
        maybe = durable(met.where("goes is null").select(*key, "other_id", "bin").join(stays, [*key, "bin"], "left_anti"), "maybe")
        gained = stays.groupBy(*key).agg(F.count(F.lit(1)).alias("gained"))
        open_ = durable(open_.join(gained, key, "left").withColumn("sure", F.col("sure") + F.coalesce("gained", F.lit(0))).drop("gained"), "open")
    for rows in gone:
        copies = copies.unionByName(rows)
    return placed(copies.withColumnRenamed("place", "tried"), "group_id", [F.col("tried")]).select("group_id", "item_id", (F.col("place") + 1).cast("int").alias("place"))


def strategy_decisions(members: DataFrame, removals: DataFrame, method: str) -> DataFrame:
    """(group_id, keeper_ids, removal_order, method): keepers are the members that no removal names."""
    group = members.groupBy("group_id").agg(F.array_sort(F.collect_set("item_id")).alias("all"))
    gone = removals.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("place", "item_id"))).getField("item_id").alias("removal_order"))
    joined = group.join(gone, "group_id", "left").withColumn("removal_order", F.coalesce("removal_order", F.array().cast("array<long>")))
    return joined.select("group_id", F.array_except("all", "removal_order").alias("keeper_ids"), "removal_order", F.lit(method).alias("method"))
