"""Retrieval tokens of items: all of them, a bounded sample, and how often each comes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandfold.functions import kernels as K


def _regions(samples: DataFrame):
    return F.col("regions") if "regions" in samples.columns else None


def drop_uninformative(samples: DataFrame) -> DataFrame:
    """Flat samples go."""
    return samples.where(K.informative(F.col("dhash"), F.col("ahash"), _regions(samples)))


def item_tokens(samples: DataFrame) -> DataFrame:
    """Distinct (item_id, token) of the informative samples, dealt by item: hashes are shuffled, their tokens need not be again."""
    tokens = K.sample_tokens(F.col("dhash"), F.col("ahash"), _regions(samples))
    kept = ["item_id", "dhash", "ahash", *(["regions"] if "regions" in samples.columns else [])]
    return drop_uninformative(samples).select(*kept).repartition("item_id").select("item_id", F.explode(tokens).alias("token")).distinct()


def selected_tokens(tokens: DataFrame, limit: int) -> DataFrame:
    """At most `limit` tokens an item: half of the room, rounded up, for whole-sample tokens of least hash; the rest by least hash among all others."""
    ranked = tokens.withColumn("hash", K.unsigned_order(K.splitmix64(F.col("token").cast("long")))).repartition("item_id")  # once for both windows
    whole = F.col("token") < K.WHOLE_TOKENS
    kind = Window.partitionBy("item_id", "whole").orderBy("hash")
    reserve = (limit + 1) // 2
    marked = ranked.withColumn("whole", whole).withColumn("place", F.row_number().over(kind))
    marked = marked.withColumn("kept", F.col("whole") & (F.col("place") <= reserve))
    rest = Window.partitionBy("item_id").orderBy(F.col("kept").desc(), "hash")
    return marked.withColumn("n", F.row_number().over(rest)).where(F.col("n") <= limit).select("item_id", "token")


def _least(item: np.ndarray, token: np.ndarray, limit: int) -> np.ndarray:
    """Which of the rows, distinct and sorted by item, selected_tokens takes."""
    heads = np.flatnonzero(np.diff(item, prepend=-1))
    sizes = np.diff(heads, append=len(item))
    taken = np.repeat(sizes <= limit, sizes)
    many = np.flatnonzero(~taken)
    owner, whole, h = item[many], token[many] < K.WHOLE_TOKENS, K.mixed(token[many])

    def place(key: np.ndarray) -> np.ndarray:
        return np.arange(len(key)) - np.searchsorted(key, key)

    by = np.lexsort((h, ~whole, owner))
    kept = np.zeros(len(many), bool)
    kept[by] = whole[by] & (place(owner[by] * 2 + ~whole[by]) < (limit + 1) // 2)
    by = np.lexsort((h, ~kept, owner))
    taken[many[by]] = place(owner[by]) < limit
    return taken


def selected_lists(samples: DataFrame, limit: int) -> DataFrame:
    """(item_id, tokens): selected_tokens of item_tokens as sorted lists. A task streams over its items, of which it holds distinct tokens only."""
    tokens = K.sample_tokens(F.col("dhash"), F.col("ahash"), _regions(samples))
    kept = ["item_id", "dhash", "ahash", *(["regions"] if "regions" in samples.columns else [])]
    dealt = drop_uninformative(samples).select(*kept).repartition("item_id").sortWithinPartitions("item_id").select("item_id", tokens.alias("tokens"))

    def lists(ids: np.ndarray, item: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        taken = _least(item, token, limit)
        item, token = item[taken], token[taken]
        bounds = np.searchsorted(item, np.arange(len(ids) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(bounds), pa.array(token.astype(np.int32)))], names=["item_id", "tokens"])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the item that may go on in the next batch, and its tokens
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.concatenate([last, batch.column(0).to_numpy()])
            sizes = np.concatenate([np.full(len(last), len(left)), batch.column(1).value_lengths().to_numpy()])
            token = np.concatenate([left, batch.column(1).flatten().to_numpy()])
            ids, item = np.unique(own, return_inverse=True)
            told = np.sort(np.repeat(item, sizes) << 32 | token)
            told = told[np.diff(told, prepend=-1) > 0]
            item, token = told >> 32, told & 0xFFFFFFFF
            end = np.searchsorted(item, len(ids) - 1)
            last, left = ids[-1:], token[end:]
            yield lists(ids[:-1], item[:end], token[:end])
        yield lists(last, np.zeros(len(left), np.int64), left)

    return dealt.mapInArrow(job, "item_id long, tokens array<int>")


def token_frequencies(tokens: DataFrame) -> DataFrame:
    """(token, n): items that own it."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def drop_frequent(tokens: DataFrame, most: int) -> DataFrame:
    """Tokens that more than `most` items own go, whichever the items. They are broadcast: of whole samples there are 8 * 65,536 tokens at most, and as many more for each region."""
    frequent = token_frequencies(tokens).where(F.col("n") > most).select("token")
    return tokens.where("token is not null").join(F.broadcast(frequent), "token", "left_anti")
