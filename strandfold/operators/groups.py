"""Clip-coherent duplicate groups.

Groups are two tables: members (group_id, item_id) and matches (group_id, match_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.operators.components import connected_components
from strandfold.operators.coverage import covered_by, exact_classes, sides
from strandfold.operators.places import SPAN, placed, running


def reject_unknown_refs(items: DataFrame, matches: DataFrame) -> DataFrame:
    """The matches, if every end is a known item; else an error that names some."""
    known = items.select("item_id")
    unknown = sides(matches).join(known, "item_id", "left_anti").select("match_id", "item_id").limit(5).collect()
    if unknown:
        raise KeyError(f"matches of unknown items: {[(r.match_id, r.item_id) for r in unknown]}")
    return matches


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 1 in an order, without gathering them in one task."""
    placed = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_before") + place).cast("long")).drop("_part", "_before")


def clip_components(matches: DataFrame, classes: DataFrame) -> DataFrame:
    """(match_id, component) of perceptual matches: two are one component if on one exact class they share a bin; a side without ranges shares with all of its class.

    A class is swept over its spans by start, in sorted ranges and stretches: the greatest end so far tells
    where an island begins, and the island's first match is carried along it. No task needs a whole class.
    """
    own = classes.select(F.col("item_id"), "class_id")
    p = matches.where("kind <> 'exact'")
    ends = p.join(own.withColumnsRenamed({"item_id": "a_id", "class_id": "ca"}), "a_id").join(own.withColumnsRenamed({"item_id": "b_id", "class_id": "cb"}), "b_id")
    left = ends.select("match_id", F.col("ca").alias("class_id"), F.col("a_sample_ranges").alias("ranges"))
    right = ends.where("ca <> cb").select("match_id", F.col("cb").alias("class_id"), F.col("b_sample_ranges").alias("ranges"))
    spans = left.unionByName(right).select("match_id", "class_id", F.explode_outer("ranges").alias("r")).select("match_id", "class_id", "r.start", "r.end")
    return connected_components(island_edges(spans)).select(F.col("node").alias("match_id"), "component")


def island_edges(spans: DataFrame, span: int = SPAN) -> DataFrame:
    """(a, b): the match of each of spans (class_id, match_id, start, end) and the first match of its island; a null start reaches over its whole class."""
    swept = placed(spans, "class_id", [F.col("start").asc_nulls_first(), F.col("end"), F.col("match_id")])
    wild = F.when(F.col("start").isNull(), 1)  # those come first, so all others of the class come after them
    seen = durable(running(swept, "class_id", "place", {"reach": (F.max, F.col("end")), "wild": (F.max, wild)}, before=True, span=span), "swept")
    new = (F.col("place") == 0) | (F.col("wild").isNull() & F.coalesce(F.col("start") > F.col("reach"), F.lit(True)))
    first = F.when(new, F.struct("place", "match_id"))
    return running(seen, "class_id", "place", {"first": (F.max, first)}, span=span).select(F.col("match_id").alias("a"), F.col("first.match_id").alias("b"))


def expand_aliases(matches: DataFrame, classes: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, item_id) and (component, match_id): every member of a class that a component uses, and the exact matches of those classes."""
    part = sides(matches.where("kind <> 'exact'")).join(components, "match_id").join(classes, "item_id").select("component", "class_id").distinct()
    members = part.join(classes, "class_id").select("component", "item_id")
    exact = matches.where("kind = 'exact'").join(classes.withColumnRenamed("item_id", "a_id"), "a_id").select("class_id", "match_id")
    return members, components.select("component", "match_id").unionByName(part.join(exact, "class_id").select("component", "match_id"))


def exact_only(matches: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, item_id) of classes of two or more that no perceptual match touches."""
    used = sides(matches.where("kind <> 'exact'")).join(classes, "item_id").select("class_id").distinct()
    many = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class_id")
    return classes.join(many, "class_id", "left_semi").join(used, "class_id", "left_anti").select("class_id", "item_id")


def duplicate_groups(items: DataFrame, matches: DataFrame, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """members (group_id, item_id) and matches (group_id, match_id), numbered by least member, size and members; no set is gathered."""
    classes = durable(exact_classes(items, matches), "classes") if classes is None else classes
    members, used = expand_aliases(matches, classes, clip_components(matches, classes))
    alone = exact_only(matches, classes)
    exact = matches.where("kind = 'exact'").join(classes.withColumnRenamed("item_id", "a_id"), "a_id")
    tag = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).cast("long").alias("id")).alias("source")
    members = members.select(tag(0, "component"), "item_id").unionByName(alone.select(tag(1, "class_id"), "item_id"))
    used = used.select(tag(0, "component"), "match_id").unionByName(
        exact.join(alone.select("class_id").distinct(), "class_id").select(tag(1, "class_id"), "match_id")
    )
    members = durable(members, "sources")
    same = durable(same_sets(members), "sets")
    groups = numbered_sets(members, same.where("source = head").select(F.col("head").alias("set"), "least", "n"))
    groups = durable(groups.select(F.col("set").alias("head"), "group_id"), "groups")
    own = same.join(groups, "head").select("source", "head", "group_id")
    return (
        members.join(own.where("source = head"), "source").select("group_id", "item_id"),
        own.join(used, "source").select("group_id", "match_id").distinct(),
    )


def same_sets(members: DataFrame) -> DataFrame:
    """(source, head, least, n): sources of members (source, item_id; each pair once) that have the same items share a head, the least of them.

    A set is told by its size, its least item and two digests that no order sways, all of them sums made before
    the shuffle; that the digests' equals are equal is verified by counting the items they have in common, and
    sources that differ all the same stay apart.
    """
    digest = [F.bit_xor(F.xxhash64(F.lit(k), "item_id")).alias(f"d{k}") for k in (1, 2)]
    sets = durable(members.groupBy("source").agg(F.min("item_id").alias("least"), F.count(F.lit(1)).alias("n"), *digest), "digests")
    told = ["least", "n", "d1", "d2"]
    heads = durable(sets.groupBy(*told).agg(F.min("source").alias("head"), F.count(F.lit(1)).alias("of")).where("of > 1"), "heads")
    like = durable(sets.join(heads, told).where("source <> head").select("source", "head", "n"), "like")
    theirs = members.join(like, "source").select("source", "head", "n", "item_id")
    heads_ = members.join(like.select("head").distinct(), members["source"] == F.col("head"), "left_semi").select(F.col("source").alias("head"), "item_id")
    equal = theirs.join(heads_, ["head", "item_id"]).groupBy("source", "head", "n").agg(F.count(F.lit(1)).alias("both")).where("both = n").select("source", "head")
    return sets.join(equal, "source", "left").select("source", F.coalesce("head", "source").alias("head"), "least", "n")


def numbered_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """sets (set, least, n) with group_id from 1, in the order of least item, size and items; members: (source, item_id) of them, each pair once.

    Only sets that agree in least item and size need their items compared. Their items, in order, are
    ranked by pairs, then pairs of pairs, each round leaving half of the rows, until a set has one rank.
    """
    ties = sets.groupBy("least", "n").agg(F.count(F.lit(1)).alias("of")).where("of > 1 and n > 1").select("least", "n")
    tied = durable(sets.join(ties, ["least", "n"]).select("set", "n"), "ties")
    longest = tied.agg(F.max("n").alias("n")).first()["n"] or 0
    ordered = sets.withColumn("order", F.lit(0).cast("long"))
    if longest:
        rows = placed(members.join(tied.select(F.col("set").alias("source")), "source", "left_semi"), "source", [F.col("item_id")])
        rows = durable(rows.select(F.col("source").alias("set"), "place", F.col("item_id").alias("rank")), "ranks")
        while longest > 1:
            at = F.shiftright("place", 1).alias("place")
            first, second = F.max(F.when(F.col("place") % 2 == 0, F.col("rank"))), F.max(F.when(F.col("place") % 2 == 1, F.col("rank")))
            pairs = durable(rows.groupBy("set", at).agg(first.alias("x"), second.alias("y")), "pairs")
            ranks = numbered(pairs.select("x", "y").distinct(), [F.col("x"), F.col("y").asc_nulls_first()], "rank")
            same = (pairs["x"] == ranks["x"]) & pairs["y"].eqNullSafe(ranks["y"])
            rows = durable(pairs.join(ranks, same).select("set", "place", "rank"), "ranks")
            longest = -(-longest // 2)
        ordered = sets.join(rows.select("set", F.col("rank").alias("order")), "set", "left")
    return numbered(ordered, ["least", "n", "order"], "group_id")


def linked_groups(members: DataFrame, seeds: DataFrame) -> DataFrame:
    """(group_id) of all groups reachable from the seeds (group_id) over shared items."""
    first = members.groupBy("item_id").agg(F.min("group_id").alias("first"))
    found = connected_components(members.join(first, "item_id").select("group_id", "first"), "group_id", "first")
    reached = found.join(seeds.select(F.col("group_id").alias("node")), "node", "left_semi").select("component").distinct()
    return found.join(reached, "component", "left_semi").select(F.col("node").alias("group_id"))


def group_coverage(members: DataFrame, used: DataFrame, matches: DataFrame, items: DataFrame, interval: float) -> DataFrame:
    """(group_id, item_id, covered_percent, sources, n_sources): each member under all the others, by the group's own matches."""
    classes = durable(exact_classes(items, matches), "classes")
    kept = members.withColumnRenamed("group_id", "scope")
    # The others of a group: direct matches have another member at their other end, and an exact copy needs another id.
    return covered_by(kept, kept, matches, items, interval, classes).withColumnRenamed("scope", "group_id")


def group_summary(members: DataFrame, used: DataFrame) -> DataFrame:
    """(group_id, n_items, n_matches)."""
    n = used.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_matches"))
    return members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_items")).join(n, "group_id", "left").select("group_id", "n_items", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def top_members(rows: DataFrame, by: list[Column], most: int) -> DataFrame:
    """(group_id, item_id, place): the first members of each group in an order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("group_id").orderBy(*by))).where(F.col("place") <= most).select("group_id", "item_id", "place")


def group_search(members: DataFrame, items: DataFrame, decided: DataFrame, status: str, text: str) -> DataFrame:
    """(group_id) of groups with a review status (all, unresolved, decided) whose number or a member's name or path holds the text, in any case."""
    groups = members.select("group_id").distinct()
    if status != "all":
        groups = groups.join(decided.select("group_id"), "group_id", "left_semi" if status == "decided" else "left_anti")
    named = members.join(items.select("item_id", "path"), "item_id")
    hit = named.where(F.contains(F.lower("path"), F.lit(text.lower())) | F.contains(F.col("group_id").cast("string"), F.lit(text.lower())))
    return groups.join(hit.select("group_id").distinct(), "group_id", "left_semi")
