"""MinHash fingerprints of documents: signatures of five-word shingles under universal hash functions.

A fingerprint is PERMUTATIONS values of 16 bits in hexadecimal; the likeness of two is the share of
equal values, an estimate of the Jaccard similarity of their shingle sets.

Rows: null text counts as empty; empty texts share one fingerprint; a text of fewer than five words
has its whole word sequence as the one shingle; ties and repeated rows have equal fingerprints;
texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandfold.llm import near_dedup
from strandfold.llm import words as W

PERMUTATIONS = 64
BANDS = 16
BIN_ROWS, MOST_BINS = 8192, 100_000


def signatures(texts: pa.Array, permutations: int = PERMUTATIONS) -> np.ndarray:
    """n x permutations of 16 bits."""
    minhash = W.MinHash(permutations, seed=23)
    out = np.empty((len(texts), permutations), ">u2")
    i = 0
    for _, _, codes, bounds in W.word_codes(texts):
        for s in W.shingle_sets(codes, bounds):
            out[i] = minhash(s) >> np.uint32(16)
            i += 1
    return out


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", permutations: int = PERMUTATIONS) -> DataFrame:
    """docs with the column fingerprint; an existing one of that name is replaced."""
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() != name.lower()] + [T.StructField(name, T.StringType())])
    kept = schema.names[:-1]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [row.tobytes().hex() for row in signatures(W.as_strings(batch.column(text)), permutations)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(got, pa.string())], names=schema.names)

    return docs.mapInArrow(job, schema)


def likeness(a: str, b: str) -> F.Column:
    """The share of equal values of two fingerprint columns."""
    n = F.length(a) / 4
    same = F.expr(f"size(filter(sequence(0, int(length({a}) / 4) - 1), i -> substring({a}, 4 * i + 1, 4) = substring({b}, 4 * i + 1, 4)))")
    return same / n


def banded_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: documents that share a band of as many values as a fingerprint has, joined where whole shingle sets verify.

    Every text of a bucket is compared with every other whose group it has not joined yet, copies as one.
    """
    return near_dedup.near_duplicates(docs, doc_id, text, percent, bands, PERMUTATIONS // bands)


def _slots(ids: DataFrame, bins: int):
    """(slot, number of slots): slot(doc_id, hash) is a Column; slots ascend as ids descend and hashes ascend, null ids last.

    Ids are cut at approximate quantiles, at most bins - 1. An id that several quantiles fall on holds many
    rows, as null ids may: such rows have slots of their own, cut by their texts' hashes.
    """
    at = ", ".join(f"{k / bins!r}D" for k in range(1, bins))
    found = ids.agg(F.expr(f"percentile_approx(doc_id, array({at}), {10 * bins})" if at else "null").alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    cuts, often = np.unique(np.array(found["cuts"] or [], np.int64), return_counts=True)
    pieces = np.where(often > 1, often + 1, 0)[::-1]  # of the ids at cuts, by descending id
    nulls = min(MOST_BINS, -(-found["none"] // BIN_ROWS))
    base = np.arange(len(cuts) + 1) + np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
    shared = ids.sparkSession.sparkContext.broadcast((cuts, pieces, base, nulls))  # at most MOST_BINS cuts

    @F.pandas_udf("int")
    def slot(doc_id: pd.Series, missing: pd.Series, hashed: pd.Series) -> pd.Series:
        cuts, pieces, base, nulls = shared.value
        doc, part = doc_id.to_numpy(np.int64), hashed.to_numpy(np.int64) >> 31
        rank = len(cuts) - np.searchsorted(cuts, doc, side="right") if len(cuts) else np.zeros(len(doc), np.int64)
        # Ids of rank r are at least the cut of that rank, whose own slots come last.
        own = np.append(pieces, 0)[rank]
        equal = np.append(cuts[::-1], 0)[rank] == doc
        out = base[rank] + np.where(equal & (own > 0), 1 + (part * own >> 32), 0)
        return pd.Series(np.where(missing.to_numpy(bool), len(cuts) + 1 + pieces.sum() + (part * nulls >> 32), out).astype(np.int32))

    return lambda doc_id, hashed: slot(F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), hashed), int(len(cuts) + 1 + pieces.sum() + nulls)


def with_following(docs: DataFrame, bins: int) -> DataFrame:
    """Rows (bin, copy, doc_id, text) so dealt and sorted that within a bin each document stands before the next by descending id.

    A bin is one partition, a range of ids or a part of the rows of one id or of null; the first document of each
    is also put, with copy 1, after the end of the bin before it (the first bin's after the last). Null ids come
    last; equal ids are in the order of their texts' hashes. Only rows alike in id and text stay in one bin however
    many they are; a task streams over them.
    """
    spark = docs.sparkSession
    slot, slots = _slots(docs.select("doc_id"), bins)
    hashed = docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("hash"), "text")
    down = F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long"))
    rows = hashed.withColumns({"bin": slot(F.col("doc_id"), F.col("hash")), "down": down})
    heads = rows.groupBy("bin").agg(F.min(F.struct("down", "hash", "doc_id")).alias("h")).orderBy("bin").select("bin", "h.doc_id", "h.hash").collect()
    before = [(h["doc_id"], h["hash"], heads[k - 1]["bin"]) for k, h in enumerate(heads)]
    table = F.broadcast(spark.createDataFrame(before, "head long, head_hash long, bin int"))  # at most 3 * MOST_BINS rows
    firsts = hashed.join(table, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("hash") == F.col("head_hash")))
    copies = firsts.groupBy("bin", "doc_id").agg(F.min("text").alias("text"))
    rows = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumns({"copy": F.lit(1), "hash": F.lit(0).cast("long"), "down": F.lit(0).cast("long")}))
    return rows.repartitionById(slots, F.col("bin")).sortWithinPartitions("bin", "copy", "down", "hash", "text").select("bin", "copy", "doc_id", "text")


def edits(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint and next_fingerprint.

    The edited text has its last floor(n / 3) code points replaced by the first as many (or all) of
    the next document's, by descending id; the last is followed by the first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").count()
    bins = min(MOST_BINS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BIN_ROWS)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bin, id, text, fingerprint): the row that waits for its next
        for batch in batches:
            texts = W.as_strings(batch.column(3))
            for lo, hi in W.chunks(W.raw(texts)[1], 2 << 20):
                part = texts[lo:hi]
                own = [x.tobytes() for x in signatures(part)]
                out, edited = [], []
                for bin_, copy, doc, text, mark in zip(*(batch.column(k).slice(lo, hi - lo).to_pylist() for k in range(3)), part.to_pylist(), own, strict=True):
                    if last is not None and last[0] == bin_:
                        k = len(last[2]) // 3
                        edited.append(last[2][: len(last[2]) - k] + text[:k])
                        out.append((last[1], len(last[2]), last[3], mark))
                    last = None if copy else (bin_, doc, text, mark)
                if out:
                    marks = signatures(pa.array(edited, pa.large_string()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()),
                            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([x[2].hex() for x in out]),
                            pa.array([m.tobytes().hex() for m in marks]), pa.array([x[3].hex() for x in out]),
                        ],
                        names=names,
                    )

    return with_following(docs, bins).mapInArrow(job, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")
