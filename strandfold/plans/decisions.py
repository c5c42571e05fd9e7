"""Decisions on groups, the removals they plan, and what becomes of them.

decisions: (group_id, keeper_ids, removal_order, method). Output tables tell what to do; nothing is moved here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.operators.coverage import covered_by
from strandfold.operators.groups import duplicate_groups
from strandfold.params import TOLERANCE

NONE = "array<long>"


def keepers(decisions: DataFrame) -> DataFrame:
    return decisions.select(F.explode("keeper_ids").alias("item_id")).distinct()


def requested(decisions: DataFrame) -> DataFrame:
    """(group_id, place, item_id) of all removals asked for."""
    return decisions.select("group_id", F.posexplode("removal_order").alias("place", "item_id"))


def requested_removals(decisions: DataFrame) -> DataFrame:
    """(item_id, group_id, place): what some set removes and none keeps, as first asked."""
    first = requested(decisions).groupBy("item_id").agg(F.min(F.struct("group_id", "place")).alias("f"))
    return first.select("item_id", "f.group_id", "f.place").join(keepers(decisions), "item_id", "left_anti")


def build_actions(decisions: DataFrame, matches: DataFrame, items: DataFrame, interval: float, min_coverage: float, classes: DataFrame | None = None) -> DataFrame:
    """(item_id, group_id, place, covered_percent, sources, n_sources): removals that all kept items together cover, by all matches. classes: exact_classes, if known."""
    all_ = F.lit(0).alias("scope")
    asked = requested_removals(decisions)
    covered = covered_by(asked.select(all_, "item_id"), keepers(decisions).select(all_, "item_id"), matches, items, interval, classes)
    safe = covered.where((F.size("sources") > 0) & (F.col("covered_percent") + TOLERANCE >= min_coverage))
    return asked.join(safe, "item_id").select("item_id", "group_id", "place", F.round("covered_percent", 2).alias("covered_percent"), "sources", "n_sources")


def default_decisions(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions, and for every other group one that keeps its members but those removed elsewhere."""
    gone = requested(decisions).select("item_id").distinct()
    open_ = members.join(decisions.select("group_id"), "group_id", "left_anti")
    kept = open_.join(gone, "item_id", "left_anti").groupBy("group_id").agg(F.array_sort(F.collect_set("item_id")).alias("k"))
    rest = open_.select("group_id").distinct().join(kept, "group_id", "left").select(
        "group_id", F.coalesce("k", F.array().cast(NONE)).alias("keeper_ids"), F.array().cast(NONE).alias("removal_order"), F.lit("web-unresolved-kept").alias("method")
    )
    return decisions.select("group_id", "keeper_ids", "removal_order", "method").unionByName(rest)


def sync_shared_choices(members: DataFrame, log: DataFrame, until: int | None = None) -> DataFrame:
    """(group_id, item_id, keep) of reviewed groups from a log (seq, group_id, item_id, keep).

    The last word on an item holds in every reviewed group it is in; members nobody spoke of are kept.
    A group is reviewed once the log names it; until cuts the log, which undoes what came later.
    """
    log = log if until is None else log.where(F.col("seq") <= until)
    reviewed = members.join(log.select("group_id").distinct(), "group_id", "left_semi")
    last = log.groupBy("item_id").agg(F.max_by("keep", "seq").alias("keep"))
    return reviewed.join(last, "item_id", "left").select("group_id", "item_id", F.coalesce("keep", F.lit(True)).alias("keep"))


def removal_files(choices: DataFrame) -> DataFrame:
    """(item_id) removed in some reviewed group and kept in none."""
    return choices.groupBy("item_id").agg(F.bool_or("keep").alias("kept")).where("not kept").select("item_id")


def infer_legacy_decisions(members: DataFrame, actions: DataFrame) -> DataFrame:
    """Decisions of a plan that holds only actions (place, item_id): a group's removals in their order, unless nothing would be left."""
    met = members.join(actions, "item_id", "left")
    group = met.groupBy("group_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("place").isNull(), F.col("item_id")))).alias("keeper_ids"),
        F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "item_id")))).getField("item_id").alias("removal_order"),
    )
    return group.where((F.size("keeper_ids") > 0) & (F.size("removal_order") > 0)).withColumn("method", F.lit("edited:legacy-plan"))


def plan_rematch(stored: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions stored by path (method, group_paths, keeper_paths, removal_paths), for today's groups of the same set of paths.

    Placeholders are ignored; a decision with unknown paths or keepers outside its group is dropped; a
    removal order that is not the rest of the group is made anew in the order of ids.
    """
    named = members.join(items.select("item_id", "path"), "item_id")
    groups = named.groupBy("group_id").agg(
        F.array_sort(F.collect_set("path")).alias("paths"), F.map_from_entries(F.collect_list(F.struct("path", "item_id"))).alias("ids"), F.array_sort(F.collect_set("item_id")).alias("all")
    )
    real = stored.where(F.element_at(F.split("method", ":"), -1) != "web-unresolved-kept").withColumn("paths", F.array_sort(F.array_distinct("group_paths")))
    met = real.join(groups, "paths")
    known = lambda c: F.size(F.array_except(c, "paths")) == 0
    fine = met.where(known("keeper_paths") & known("removal_paths"))
    look = lambda c: F.transform(c, lambda p: F.try_element_at(F.col("ids"), p))
    kept = fine.withColumns({"keeper_ids": F.array_sort(F.array_distinct(look("keeper_paths"))), "asked": look("removal_paths")})
    rest = F.array_except("all", "keeper_ids")
    same = F.array_sort(F.array_distinct("asked")) == F.array_sort(rest)
    return kept.select("group_id", "keeper_ids", F.when(same, F.col("asked")).otherwise(rest).alias("removal_order"), F.concat(F.lit("edited:"), "method").alias("method"))


def drift_check(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    """(item_id, status) of plan rows (item_id, size_bytes, mtime_ns): ok, changed or missing."""
    now = inventory.select("item_id", F.col("size_bytes").alias("_s"), F.col("mtime_ns").alias("_m"))
    same = (F.col("size_bytes") == F.col("_s")) & (F.col("mtime_ns") == F.col("_m"))
    status = F.when(F.col("_s").isNull(), "missing").when(same, "ok").otherwise("changed")
    return plan.join(now, "item_id", "left").select("item_id", status.alias("status"))


def validate_plan(actions: DataFrame, decisions: DataFrame, plan_items: DataFrame, inventory: DataFrame, strict: bool = False, by_set: bool = True) -> DataFrame:
    """(item_id, group_id, status) of actions (item_id, sources): ready, refused or skipped.

    A missing target is skipped and a changed one refused; strict refuses also where a covering item that
    sources names has changed or is missing. By set, an action belongs to the least group that asks for it, and one refused
    target refuses the whole group.
    """
    state = drift_check(plan_items.select("item_id", "size_bytes", "mtime_ns"), inventory)
    own = requested(decisions).groupBy("item_id").agg(F.min("group_id").alias("group_id"))
    rows = actions.select("item_id", "sources").join(state, "item_id", "left").join(own, "item_id", "left")
    bad = F.coalesce(F.col("status"), F.lit("missing")) == "changed"
    if strict:
        source = actions.select("item_id", F.explode("sources").alias("source")).join(state.withColumnsRenamed({"item_id": "source", "status": "s"}), "source", "left")
        unsafe = source.where("s is null or s <> 'ok'").select("item_id").distinct().withColumn("unsafe", F.lit(True))
        rows = rows.join(unsafe, "item_id", "left")
        bad = bad | F.coalesce("unsafe", F.lit(False))
    rows = rows.withColumn("bad", bad)
    refused = F.max("bad").over(Window.partitionBy("group_id")) if by_set else F.col("bad")
    status = F.when(refused, "refused").when(F.coalesce("status", F.lit("missing")) == "missing", "skipped").otherwise("ready")
    return rows.select("item_id", "group_id", status.alias("status"))


def retire_resolved(items: DataFrame, matches: DataFrame, members: DataFrame, decisions: DataFrame, resolved: DataFrame):
    """(items, matches, members, group matches, decisions) after removals (item_id) are done.

    A set is complete when all it asked for is resolved. Hidden are the resolved items, and members of
    complete sets that are in no other set. What is left is grouped anew; an open decision goes to the
    groups within its old members that are left, the least old group first. Sets are compared by counts of joined rows.
    """
    resolved = durable(resolved, "resolved")
    asked = requested(decisions).join(resolved.withColumn("done", F.lit(True)), "item_id", "left")
    complete = asked.groupBy("group_id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all")).where("all").select("group_id")
    active = members.join(complete, "group_id", "left_anti").select("item_id").distinct()
    idle = members.join(complete, "group_id", "left_semi").select("item_id").distinct().join(active, "item_id", "left_anti")
    hidden = durable(resolved.select("item_id").union(idle).distinct(), "hidden")
    left = items.join(hidden, "item_id", "left_anti")
    ends = lambda m, c: m.join(hidden.withColumnRenamed("item_id", c), c, "left_anti")
    kept_matches = durable(ends(ends(matches, "a_id"), "b_id").select(*matches.columns), "matches")
    new_members, new_matches = duplicate_groups(left, kept_matches)
    rest = members.join(resolved, "item_id", "left_anti").join(complete, "group_id", "left_anti").join(decisions.select("group_id"), "group_id", "left_semi")
    rest = durable(rest.select(F.col("group_id").alias("old_id"), "item_id"), "rest")
    now = new_members.groupBy("group_id").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n"))
    # A group can only be within an old set that holds its least member; it is if they have all of its members in common.
    near = durable(now.join(rest, "item_id").select("group_id", "old_id", "n"), "near")
    shared = near.join(new_members, "group_id").join(rest, ["old_id", "item_id"])
    within = shared.groupBy("group_id", "old_id", "n").agg(F.count(F.lit(1)).alias("both")).where("both = n")
    heirs = durable(within.groupBy("group_id").agg(F.min("old_id").alias("old_id")), "heirs")
    left_of = heirs.join(decisions.withColumnRenamed("group_id", "old_id"), "old_id")

    def carried_(column: str) -> DataFrame:
        """(group_id, at, item_id) of a decision's items that its heir has."""
        return left_of.select("group_id", F.posexplode(column).alias("at", "item_id")).join(new_members, ["group_id", "item_id"], "left_semi")

    keep = carried_("keeper_ids").groupBy("group_id").agg(F.array_sort(F.collect_set("item_id")).alias("keeper_ids"))
    remove = carried_("removal_order").groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("at", "item_id"))).getField("item_id").alias("removal_order"))
    none = F.array().cast(NONE)
    carried = left_of.select("group_id", "method").join(keep, "group_id", "left").join(remove, "group_id", "left").select(
        "group_id", F.coalesce("keeper_ids", none).alias("keeper_ids"), F.coalesce("removal_order", none).alias("removal_order"), "method"
    )
    return left, kept_matches, new_members, new_matches, carried


def actionable_sets(members: DataFrame, decisions: DataFrame) -> DataFrame:
    """(group_id) of decided groups that keep fewer than their members."""
    n = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return decisions.join(n, "group_id").where(F.size("keeper_ids") < F.col("n")).select("group_id")


def reclaim_bytes(actions: DataFrame, items: DataFrame) -> DataFrame:
    """(bytes) of the removed items, each once."""
    return actions.select("item_id").distinct().join(items.select("item_id", "size_bytes"), "item_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
