"""Scalar functions over samples, names and files, as Columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALL_ONES = -1  # the bit pattern of 64 ones
WHOLE_TOKENS = 8 << 16


def _flat(dhash: Column, ahash: Column) -> Column:
    return (dhash == 0) & ahash.isin(0, ALL_ONES)


def informative(dhash: Column, ahash: Column, regions: Column | None = None) -> Column:
    """False for flat samples: all gradients 0 and the average hash all 0 or all 1. One informative region suffices."""
    own = ~_flat(dhash, ahash)
    return own if regions is None else own | F.coalesce(F.exists(regions, lambda r: ~_flat(r["dhash"], r["ahash"])), F.lit(False))


def _bands(dhash: Column, ahash: Column, first: Column) -> list[Column]:
    """Eight 16-bit parts, each with its band number above it."""
    parts = [(dhash, k) for k in range(4)] + [(ahash, k) for k in range(4)]
    return [
        (F.shiftrightunsigned(h, 16 * k).bitwiseAND(0xFFFF) + (first + i) * 65536).cast("int") for i, (h, k) in enumerate(parts)
    ]


def sample_tokens(dhash: Column, ahash: Column, regions: Column | None = None) -> Column:
    """Array of the tokens of a sample: eight of the whole, eight more for each informative region at its place."""
    whole = F.array(*_bands(dhash, ahash, F.lit(0)))
    if regions is None:
        return whole
    tiles = F.transform(
        regions,
        lambda r, i: F.when(_flat(r["dhash"], r["ahash"]), F.array().cast("array<int>")).otherwise(
            F.array(*_bands(r["dhash"], r["ahash"], (i + 1) * 8))
        ),
    )
    return F.concat(whole, F.flatten(F.coalesce(tiles, F.array().cast("array<array<int>>"))))


def first_band(x: Column, y: Column) -> Column:
    """The first of the eight bands that two sample structs have alike; null if none."""
    alike = [(F.shiftrightunsigned(x[h].bitwiseXOR(y[h]), 16 * k).bitwiseAND(0xFFFF) == 0, n) for n, (h, k) in enumerate([("dhash", k) for k in range(4)] + [("ahash", k) for k in range(4)])]
    return F.coalesce(*[F.when(same, n) for same, n in alike])


def whole_distance(da: Column, aa: Column, ma: Column, db: Column, ab: Column, mb: Column) -> Column:
    """Differing bits of both hashes, and up to 8 for the difference of the means."""
    means = F.least(F.lit(8), F.floor(F.abs(ma.cast("int") - mb.cast("int")) / 16)).cast("int")
    return F.bit_count(da.bitwiseXOR(db)) + F.bit_count(aa.bitwiseXOR(ab)) + means


def sample_distance(a: str, b: str) -> Column:
    """Distance of two sample structs: of the wholes, or of the regions where at least seven of nine can be compared."""
    x, y = F.col(a), F.col(b)
    whole = whole_distance(x["dhash"], x["ahash"], x["mean"], y["dhash"], y["ahash"], y["mean"])
    zipped = F.arrays_zip(x["regions"].alias("p"), y["regions"].alias("q"))
    usable = F.filter(zipped, lambda t: ~_flat(t["p"]["dhash"], t["p"]["ahash"]) & ~_flat(t["q"]["dhash"], t["q"]["ahash"]))
    each = F.array_sort(F.transform(usable, lambda t: whole_distance(t["p"]["dhash"], t["p"]["ahash"], t["p"]["mean"], t["q"]["dhash"], t["q"]["ahash"], t["q"]["mean"])))
    best = F.aggregate(F.slice(each, 1, 7), F.lit(0), lambda s, d: s + d)
    regional = F.lit(4) + F.greatest(F.ceil(best / 7).cast("int"), F.try_element_at(each, F.lit(5)))
    nine = (F.size(x["regions"]) == 9) & (F.size(y["regions"]) == 9)
    return F.when(nine & (F.size(each) >= 7), F.least(whole, regional)).otherwise(whole)


def vector_dhash(v: Column, n: int = 64) -> Column:
    """Bit k is v[k] > v[k + 1], the first bit highest; the last bit is 0."""
    return F.shiftleft(
        F.aggregate(F.sequence(F.lit(0), F.lit(n - 2)), F.lit(0).cast("long"), lambda acc, k: F.shiftleft(acc, 1).bitwiseOR((F.get(v, k) > F.get(v, k + 1)).cast("long"))), 1
    )


def vector_average(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)


def vector_ahash(v: Column) -> Column:
    """Bit k is v[k] >= the average, the first bit highest."""
    mean = vector_average(v)
    return F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR((x.cast("double") >= mean).cast("long")))


def vector_mean(v: Column) -> Column:
    """The average of a vector in [-1, 1] as a grey value."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((vector_average(v) + 1) * 127.5))).cast("int")


def mixed(values: np.ndarray) -> np.ndarray:
    """The mixing function of the public splitmix64 generator."""
    x = values.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(T.LongType())
def splitmix64(values: pd.Series) -> pd.Series:
    """mixed() as a bit pattern in a long."""
    return pd.Series(mixed(values.to_numpy(np.int64)).view(np.int64))


def unsigned_order(x: Column) -> Column:
    """Orders bit patterns as unsigned numbers."""
    return x.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def safe_float(text: Column, default: float = 0.0) -> Column:
    """The number a text holds; the default if it is none or not finite."""
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(default)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative_folder_depth(path: Column, roots: Column) -> Column:
    """Folders between a file and the nearest root above it; without one, folders above the file."""
    under = F.filter(roots, lambda r: path.startswith(F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))
    depths = F.transform(under, lambda r: F.size(F.split(F.substring(path, F.length(F.rtrim(r, F.lit("/"))) + 2, F.length(path)), "/")) - 1)
    return F.coalesce(F.array_min(depths), F.greatest(F.lit(0), F.size(F.split(path, "/")) - 2))


def mixed_alphanumeric_name(path: Column) -> Column:
    """Whether the name before its last extension holds a letter and a digit."""
    stem = F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")
    return stem.rlike(r"\p{L}") & stem.rlike(r"\p{Nd}")


def quality_key(width: Column, height: Column, size: Column, duration: Column, path: Column) -> Column:
    """Struct by which lower quality comes first."""
    zero = F.lit(0).cast("long")
    return F.struct(
        (F.coalesce(width.cast("long"), zero) * F.coalesce(height.cast("long"), zero)).alias("pixels"),
        F.coalesce(size, zero).alias("bytes"), F.coalesce(duration, F.lit(0.0)).alias("duration"), F.coalesce(path, F.lit("")).alias("path"),
    )


def sample_count(detailed: Column, duration: Column, interval: float) -> Column:
    """Detailed samples, or as many as the duration holds, at least one."""
    return F.coalesce(F.when(detailed > 0, detailed.cast("long")), F.greatest(F.lit(1).cast("long"), F.ceil(duration / interval)))
