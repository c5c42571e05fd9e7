"""Tables of documents, vectors, events and pages as items, samples, bins and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.functions import kernels as K
from strandfold.functions import simhash
from strandfold.functions.pixels import FRAME_BYTES


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_items(docs: DataFrame) -> DataFrame:
    """One item per document; its duration is its number of sentences."""
    parts = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda s: F.btrim(s, F.lit(" "))), lambda s: F.length(s) >= 10)
    return docs.select(
        F.col("doc_id").alias("item_id"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"), F.col("doc_id").alias("mtime_ns"),
        F.size(parts).cast("double").alias("duration_seconds"), F.col("n_chars").cast("long").alias("width"), F.lit(1).cast("long").alias("height"),
        F.lit("text").alias("codec"), F.sha2("text", 256).alias("sha256"), F.size(parts).cast("long").alias("detailed_sample_count"),
    )


def document_samples(docs: DataFrame) -> DataFrame:
    """All sentences as samples; regions are empty."""
    return simhash.sentence_samples(docs)


def fast_pass(samples: DataFrame) -> DataFrame:
    """Samples chosen by content, as key frames are: those whose lowest 16 bits of dhash divide by 4."""
    return samples.where(F.col("dhash").bitwiseAND(0xFFFF) % 4 == 0)


def vector_samples(vectors: DataFrame) -> DataFrame:
    """Ten vectors make an item."""
    v = F.col("embedding")
    return vectors.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("item_id"), (F.col("vec_id") % 10).cast("int").alias("pos"),
        K.vector_dhash(v).alias("dhash"), K.vector_ahash(v).alias("ahash"), K.vector_mean(v).alias("mean"),
    )


def event_bins(events: DataFrame) -> DataFrame:
    """Distinct (item_id, bin): hours since 2024-01-01 in which a user was active."""
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    return events.select(F.col("user_id").alias("item_id"), hour.cast("int").alias("bin")).distinct()


def page_frames(pages: DataFrame) -> DataFrame:
    """(item_id, content) of pages as raw bytes, for sources.frames.load_frames."""
    return pages.select(F.col("page_id").alias("item_id"), F.encode("html", "UTF-8").alias("content"))


def load_frames(raw: DataFrame, interval: float = 3.0) -> DataFrame:
    """(item_id, pos, ts, pixels) of (item_id, content[, stamps]): frames of 648 bytes; a cut-off tail is ignored.

    Where stamps (array of seconds) are given the shorter of both counts; otherwise ts = pos * interval.
    """
    n = F.floor(F.octet_length("content") / FRAME_BYTES).cast("int")
    if "stamps" in raw.columns:
        n = F.when(F.col("stamps").isNull(), n).otherwise(F.least(n, F.size("stamps")))
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("pos")
    kept = ["item_id", "content", *(["stamps"] if "stamps" in raw.columns else [])]
    frames = raw.select(*kept, at)
    ts = F.col("pos") * interval
    if "stamps" in raw.columns:
        ts = F.coalesce(F.get("stamps", F.col("pos")), ts)
    return frames.select("item_id", "pos", ts.cast("double").alias("ts"), F.substring("content", F.col("pos") * FRAME_BYTES + 1, F.lit(FRAME_BYTES)).alias("pixels"))
