"""Reports and plans as lines of JSON, and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandfold.operators.groups import numbered

RANGE = "array<struct<start: int, end: int>>"
PARTS = {
    "files": "item_id long, path string, size_bytes long, mtime_ns long, duration_seconds double, width long, height long, codec string, detailed_sample_count long",
    "matches": f"match_id long, a_id long, b_id long, kind string, overlap_seconds double, a_duplicated_percent double, b_duplicated_percent double, confidence double, a_sample_ranges {RANGE}, b_sample_ranges {RANGE}",
    "settings": "schema_version int, settings map<string, string>",
    "summary": "name string, value double",
    "failures": "path string, error string, cached boolean",
}
#: Part files keep no order, so matches carry their place.
WRITTEN = PARTS | {"matches": PARTS["matches"] + ", place long"}
PLAN = {
    "decisions": "group_id long, method string, keeper_paths array<string>, removal_paths array<string>",
    "actions": "item_id long, path string, size_bytes long, mtime_ns long, covered_percent double, sources array<long>, n_sources long",
}


def write_parts(path: str, parts: dict[str, str], **tables: DataFrame) -> None:
    """Each table as lines of JSON in as many files as it has partitions, under its name."""
    for name, table in tables.items():
        table.select(*T.StructType.fromDDL(parts[name]).names).write.mode("overwrite").json(f"{path}/{name}")


def read_parts(spark: SparkSession, path: str, parts: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in parts.items()}


def write_report(path: str, items: DataFrame, matches: DataFrame, settings: dict[str, str], summary: DataFrame | None = None, failures: DataFrame | None = None) -> None:
    """A report as lines of JSON: files, matches in the order of sort_matches, settings, summary (one row of counts) and failures."""
    spark, none = items.sparkSession, F.array().cast(RANGE)
    ranges = {c: F.coalesce(c, none) for c in ("a_sample_ranges", "b_sample_ranges")}
    order = [F.greatest("a_duplicated_percent", "b_duplicated_percent").desc(), F.col("a_id"), F.col("b_id")]
    told = spark.range(1).select(F.lit(1).alias("schema_version"), F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]).alias("settings"))
    counts = spark.createDataFrame([], PARTS["summary"])
    if summary is not None:
        each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in summary.columns])
        counts = summary.select(F.explode(each).alias("s")).select("s.*")
    failed = spark.createDataFrame([], PARTS["failures"]) if failures is None else failures
    write_parts(path, WRITTEN, files=items, matches=numbered(matches.withColumns(ranges), order, "place"), settings=told, summary=counts, failures=failed)


def report_parts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All sections of a report by name; matches are in the order they were written in."""
    parts = read_parts(spark, path, WRITTEN)
    return parts | {"matches": parts["matches"].orderBy("place").drop("place")}


def load_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(items, matches, settings) of a report."""
    parts = report_parts(spark, path)
    return parts["files"], parts["matches"], parts["settings"].select("settings").first()["settings"] or {}


def write_plan(path: str, decisions: DataFrame, actions: DataFrame, items: DataFrame) -> None:
    """A plan as lines of JSON: decisions by path, and actions with the state their files were in."""
    state = items.select("item_id", "path", "size_bytes", "mtime_ns")
    write_parts(path, PLAN, decisions=plan_rows(decisions, items), actions=actions.join(state, "item_id"))


def load_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(decisions by path, actions) of a plan."""
    parts = read_parts(spark, path, PLAN)
    return parts["decisions"], parts["actions"]


def plan_rows(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """(group_id, method, keeper_paths, removal_paths): decisions by path, for a plan that outlives ids."""
    paths = items.select("item_id", "path")
    named = lambda c, n: decisions.select("group_id", F.posexplode(c).alias("pos", "item_id")).join(paths, "item_id").groupBy("group_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "path"))).getField("path").alias(n)
    )
    none = F.array().cast("array<string>")
    joined = decisions.select("group_id", "method").join(named("keeper_ids", "keeper_paths"), "group_id", "left").join(named("removal_order", "removal_paths"), "group_id", "left")
    return joined.select("group_id", "method", F.coalesce("keeper_paths", none).alias("keeper_paths"), F.coalesce("removal_paths", none).alias("removal_paths"))


def item_public(items: DataFrame) -> DataFrame:
    """Items as reports show them."""
    return items.select("item_id", "path", "size_bytes", F.round("duration_seconds", 3).alias("duration_seconds"), "width", "height", "codec", "sha256", "detailed_sample_count")


def scan_summary(items: DataFrame, short: DataFrame, candidates: DataFrame, likely: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of counts."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = one(items, "scanned")
    for df, name in ((short, "short_filtered"), (candidates, "candidate_pairs"), (likely, "verified_pairs"), (matches, "duplicate_pairs")):
        out = out.join(F.broadcast(one(df, name)))  # one row each
    return out


def session_summary(members: DataFrame, used: DataFrame, items: DataFrame, decided: DataFrame) -> DataFrame:
    """(groups, grouped_items, matches, decided, total_bytes): each item's bytes once."""
    files = members.select("item_id").distinct().join(items.select("item_id", "size_bytes"), "item_id").agg(F.count(F.lit(1)).alias("grouped_items"), F.sum("size_bytes").alias("total_bytes"))
    parts = [members.agg(F.countDistinct("group_id").alias("groups")), used.agg(F.countDistinct("match_id").alias("matches")), decided.agg(F.countDistinct("group_id").alias("decided"))]
    for part in parts:
        files = files.join(F.broadcast(part))  # one row each
    return files.select("groups", "grouped_items", "matches", "decided", "total_bytes")
