"""Verification of candidate pairs by their samples' distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.functions import kernels as K
from strandfold.operators.cells import over_matches
from strandfold.operators.tokens import drop_uninformative
from strandfold.params import Params


def sample_pairs(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """(a, b, i, j, ts_a, ts_b, distance): informative samples of both items that share a token, each pair of samples once.

    Rows of the index carry their sample's hashes, so the distance is taken in the join itself. A pair of samples
    that shares several tokens is told at the first of them only.
    """
    regional = "regions" in samples.columns
    tokens = F.array_distinct(K.sample_tokens(F.col("dhash"), F.col("ahash"), F.col("regions") if regional else None))
    usable = drop_uninformative(samples).withColumn("tokens", tokens)
    whole = F.struct("dhash", "ahash", "mean", *(["regions", "tokens"] if regional else []))
    index = usable.withColumn("whole", whole).select("item_id", "pos", "ts", "whole", F.explode("tokens").alias("token"))
    side = lambda item, pos, ts, sample: index.select(F.col("item_id").alias(item), F.col("pos").alias(pos), F.col("ts").alias(ts), F.col("whole").alias(sample), "token")
    met = pairs.join(side("a", "i", "ts_a", "x"), "a").join(side("b", "j", "ts_b", "y"), ["b", "token"])
    x, y = F.col("x"), F.col("y")
    if regional:
        first = F.col("token") == F.array_min(F.array_intersect("x.tokens", "y.tokens"))
        distance = K.sample_distance("x", "y")
    else:
        first = F.shiftright("token", 16) == K.first_band(x, y)
        distance = K.whole_distance(x["dhash"], x["ahash"], x["mean"], y["dhash"], y["ahash"], y["mean"])
    return met.where(first).select("a", "b", "i", "j", "ts_a", "ts_b", distance.cast("int").alias("distance"))


def within(points: DataFrame, distance: int) -> DataFrame:
    return points.where(F.col("distance") <= distance)


def matching_points(pairs: DataFrame, samples: DataFrame, distance: int) -> DataFrame:
    """(a, b, i, j, distance) at most so far apart."""
    return within(sample_pairs(pairs, samples), distance).select("a", "b", "i", "j", "distance")


def bucket_support(points: DataFrame) -> DataFrame:
    """(a, b, bucket, n_left, n_right): distinct samples of each side by time shift, in buckets of two seconds, halves to even."""
    bucket = F.bround((F.col("ts_b") - F.col("ts_a")) / 2.0, 0).cast("long")
    return points.groupBy("a", "b", bucket.alias("bucket")).agg(F.countDistinct("i").alias("n_left"), F.countDistinct("j").alias("n_right"))


def _sides(own, i, j, ts_a, ts_b) -> tuple[np.ndarray, ...]:
    """Of matches of pairs `own`, (own, bucket, n_left, n_right), as bucket_support tells."""
    bucket = np.rint((ts_b - ts_a) / 2).astype(np.int64)
    width = bucket.max() - bucket.min() + 1
    at = own * width + (bucket - bucket.min())
    sides = []
    for pos in (i, j):
        span = pos.max() - pos.min() + 1
        told = np.sort(at * span + (pos - pos.min()))
        told = told[np.diff(told, prepend=-1) > 0] // span
        heads = np.flatnonzero(np.diff(told, prepend=-1))
        sides.append(np.diff(heads, append=len(told)))
    own, at = np.divmod(told[heads], width)
    return own, at + bucket.min(), *sides


def _buckets(a, b, own, i, j, ts_a, ts_b, distance) -> list[np.ndarray]:
    """bucket_support of the matches of some whole pairs."""
    own, *told = _sides(own, i, j, ts_a, ts_b)
    return [a[own], b[own], *told]


def _support(a, b, own, i, j, ts_a, ts_b, distance) -> list[np.ndarray]:
    """Of matches, (a, b, support) of each pair: the best of its buckets, by the lesser number of distinct samples of a side."""
    own, _, n_left, n_right = _sides(own, i, j, ts_a, ts_b)
    best = np.zeros(len(a), np.int64)
    np.maximum.at(best, own, np.minimum(n_left, n_right))
    met = np.flatnonzero(best)
    return [a[met], b[met], best[met]]


def near_support(pairs: DataFrame, samples: DataFrame, distance: int) -> DataFrame:
    """bucket_support of the pairs' matching points, counted where they are found: no point leaves its task."""
    return over_matches(pairs, drop_uninformative(samples), distance, _buckets, "a long, b long, bucket long, n_left long, n_right long")


def near_points(pairs: DataFrame, samples: DataFrame, distance: int) -> DataFrame:
    """matching_points of samples without regions, where samples meet in tasks and not in a join."""
    job = lambda a, b, own, i, j, ts_a, ts_b, distance: [a[own], b[own], i, j, distance]
    return over_matches(pairs, drop_uninformative(samples), distance, job, "a long, b long, i int, j int, distance int")


def verify_candidates(pairs: DataFrame, samples: DataFrame, items: DataFrame, p: Params) -> DataFrame:
    """(a, b) with a bucket that enough samples of both sides support: two, or one if the shorter item is below the least segment."""
    if "regions" in samples.columns:
        support = bucket_support(within(sample_pairs(pairs, samples), p.distance)).select("a", "b", F.least("n_left", "n_right").alias("support"))
    else:
        support = over_matches(pairs, drop_uninformative(samples), p.distance, _support, "a long, b long, support long")
    length = items.select("item_id", "duration_seconds")
    sized = support.join(length.select(F.col("item_id").alias("a"), F.col("duration_seconds").alias("la")), "a").join(
        length.select(F.col("item_id").alias("b"), F.col("duration_seconds").alias("lb")), "b"
    )
    needed = F.when(F.least("la", "lb") < p.min_segment, 1).otherwise(2)
    return sized.where(F.col("support") >= needed).select("a", "b").distinct()
