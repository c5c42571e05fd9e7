"""Places of rows in sorted groups, and running values over them, without any task seeing a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandfold.durable import durable

SPAN = 12


def placed(rows: DataFrame, group: str, order: list[Column], size: str = "size") -> DataFrame:
    """rows with their place (from 0) in their group in an order, and the group's size (a column of that name), by sorted ranges and their heads."""
    order = [F.col(group), *order]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    ranged = durable(ranged.withColumn("_part", F.shiftright("_row", 33)), "placed")
    runs = ranged.groupBy("_part", group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))  # one row a partition and group
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_part")) - F.col("_n")
    runs = durable(runs.select("_part", group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias(size)), "runs")
    return ranged.join(runs, ["_part", group]).withColumn("place", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def running(rows: DataFrame, group: str, place: str, values: dict, before: bool = False, span: int = SPAN) -> DataFrame:
    """rows with running aggregates, in the order of an integer place within a group, of all rows up to each one (before: without itself).

    values: by name F.max or F.bit_xor and a Column of rows. A group is cut in stretches of 2 ** span places; what
    stands before a stretch comes from the stretches' own aggregates.
    """
    cut = rows.withColumns({f"_{n}": c for n, (_, c) in values.items()}).withColumn("_cut", F.shiftright(place, span))
    inside = Window.partitionBy(group, "_cut").orderBy(place).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    long = cut.where("_cut > 0").select(group).distinct()
    parts = cut.join(long, group, "left_semi").groupBy(group, "_cut").agg(*[f(f"_{n}").alias(f"_{n}") for n, (f, _) in values.items()])
    earlier = Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_cut", *[f(f"_{n}").over(earlier).alias(f"_before_{n}") for n, (f, _) in values.items()]).where("_cut > 0")
    met = cut.withColumns({n: f(f"_{n}").over(inside) for n, (f, _) in values.items()}).join(durable(parts, "stretches"), [group, "_cut"], "left")
    nought = F.lit(0).cast("long")
    both = {
        n: F.coalesce(n, nought).bitwiseXOR(F.coalesce(f"_before_{n}", nought)) if f is F.bit_xor else F.greatest(n, f"_before_{n}")
        for n, (f, _) in values.items()
    }
    return met.withColumns(both).drop("_cut", *[f"_{n}" for n in values], *[f"_before_{n}" for n in values])
