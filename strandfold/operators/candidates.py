"""Candidate pairs from an inverted index of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.operators.cells import blocks, past_blocks, ragged, spans
from strandfold.operators.tokens import drop_frequent, token_frequencies
from strandfold.params import Params


def shared_token_counts(tokens: DataFrame) -> DataFrame:
    """(a, b, score) for a < b: tokens both own. Each token meets itself once, so a list of n owners makes n (n - 1) / 2 rows; cut frequent ones first."""
    left, right = tokens.select("token", F.col("item_id").alias("a")), tokens.select("token", F.col("item_id").alias("b"))
    return left.join(right, "token").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("score"))


def min_shared(counts: DataFrame, least: int) -> DataFrame:
    return counts.where(F.col("score") >= least)


def _first(item: np.ndarray, other: np.ndarray, score: np.ndarray, n: int, most: int) -> tuple[np.ndarray, ...]:
    """Of rows (item, other, score), numbers below n, those that are among the first `most` of their item: by score, then the greater other."""
    top = int(score.max(initial=0))
    key = np.sort((item * (top + 1) + (top - score)) * n + (n - 1 - other))
    item, rest = np.divmod(key, (top + 1) * n)
    heads = np.flatnonzero(np.diff(item, prepend=-1))
    kept = np.arange(len(item)) - np.repeat(heads, np.diff(heads, append=len(item))) < most
    score, other = np.divmod(rest[kept], n)
    return item[kept], n - 1 - other, top - score


class _Block:
    """Items that a task holds: who owns a token, and, given `most`, each one's first partners so far."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, most: int | None):
        self.ids, self.most = ids, most
        told = np.sort(tokens.astype(np.int64) << 32 | np.repeat(np.arange(len(ids)), sizes))
        self.owners = (told & 0xFFFFFFFF).astype(np.int32)
        self.starts = np.searchsorted(told >> 32, np.arange((told[-1] >> 32 if len(told) else 0) + 3))  # beyond the last token: none
        self.best = (np.zeros(0, np.int64),) * 3
        self.new: list[tuple[np.ndarray, ...]] = []
        self.least = np.zeros(len(ids), np.int64)  # what a partner must score

    def meet(self, ids: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(number of the item, number of the own one, score) of other items, of `least` or more; without `most` those with the lesser id only."""
        at = np.minimum(tokens, len(self.starts) - 2)
        first = self.starts[at]
        met = self.starts[at + 1] - first
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(met)])[bounds]
        item = np.repeat(np.arange(len(ids)), sizes)
        above = np.searchsorted(self.ids, ids, "right")
        for lo, hi in spans(np.diff(sums), 2_000_000):
            s = slice(bounds[lo], bounds[hi])
            a, b = np.repeat(item[s], met[s]), self.owners[ragged(first[s], met[s])]
            if self.most is None:
                rising = b >= above[a]
                a, b = a[rising], b[rising]
            keys = np.sort(a * len(self.ids) + b)
            heads = np.flatnonzero(np.diff(keys, prepend=-1))
            score = np.diff(heads, append=len(keys))
            enough = score >= least
            (a, b), score = np.divmod(keys[heads[enough]], max(1, len(self.ids))), score[enough]
            if self.most is not None:
                kept = (score >= self.least[b]) & (ids[a] != self.ids[b])
                a, b, score = a[kept], b[kept], score[kept]
            yield a, b, score

    def keep(self, ids: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> None:
        """Of what meet() gives for other items, the first partners of each own one."""
        a, b, score = (np.concatenate(c) for c in zip(*found, strict=True))
        b, a, score = _first(b, a, score, max(1, len(ids)), self.most)
        self.new.append((b, ids[a], score))
        if sum(len(x[0]) for x in self.new) > max(500_000, len(self.best[0])):
            self.sift()

    def sift(self) -> tuple[np.ndarray, ...]:
        item, other, score = (np.concatenate(c) for c in zip(self.best, *self.new, strict=True))
        by = np.lexsort((~other, -score, item))
        item, other, score = item[by], other[by], score[by]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.most - 1
        self.least[item[last]] = score[last]
        self.best, self.new = tuple(c[place < self.most] for c in (item, other, score)), []
        return self.best


def _counted(batches: Iterator[pa.RecordBatch], least: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b, score) of rows of past_blocks(). Given `most`, each pair comes from the block's end as (item, other, score), as far as it is among this end's first."""
    own = None
    for batch in batches:
        for k in range(batch.num_rows):
            *read, own_ids, own_sizes, own_tokens = (np.frombuffer(c[k].as_buffer(), t) for c, t in zip(batch.columns, (np.int64, np.int32, np.int32) * 2, strict=True))
            own = own or _Block(own_ids.copy(), own_sizes, own_tokens, most)
            found = [(np.zeros(0, np.int64),) * 3]
            for a, b, score in own.meet(*read, least):
                if most is None:
                    yield _pairs(read[0][a], own.ids[b], score)
                    continue
                found.append((a, b, score))
                if sum(len(f[0]) for f in found) > 2_000_000:
                    own.keep(read[0], found)
                    found = found[:1]
            if most is not None:
                own.keep(read[0], found)
    if own and most is not None:
        item, other, score = own.sift()
        for at in range(0, len(item), 1_000_000):
            yield _pairs(*(c[at : at + 1_000_000] for c in (own.ids[item], other, score)))


def _pairs(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["a", "b", "score"])


def token_lists(tokens: DataFrame) -> DataFrame:
    """(item_id, tokens), sorted, of tokens (item_id, token)."""
    return durable(tokens.where("item_id is not null").groupBy("item_id").agg(F.sort_array(F.collect_list(F.col("token").cast("int"))).alias("tokens")), "lists")


def pairs_sharing(tokens: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """shared_token_counts of `least` or more. A task holds a block of items and reads all others past it, so that no row is shuffled
    for a token that two items share; cut frequent tokens first.

    Given `most`, (a, b, score) with a pair from either end a, without those that `most` others come before."""
    lists = token_lists(tokens)
    return sharing(lists, lists, least, most)


def frequent_tokens(lists: DataFrame, max_frequency: int) -> DataFrame:
    """(token, n) that more than max_frequency items own."""
    return durable(token_frequencies(lists.select(F.explode("tokens").alias("token"))).where(F.col("n") > max_frequency), "frequent")


def sharing(held: DataFrame, read: DataFrame, least: int, most: int | None, frequent: DataFrame | None = None) -> DataFrame:
    """Pairs of items of `held` and `read` (item_id, tokens), distinct and sorted, that share `least` tokens that aren't `frequent`: (a, b, score) for a of `read` below b of `held`.

    Given `most`, (a, b, score) for a of `held`, without those that `most` others of `read` come before."""
    rows = held.agg(F.sum(F.size("tokens"))).first()[0] or 0
    n = blocks(held.sparkSession, rows)
    if frequent is not None:  # to each block, as a row; of whole samples there are 8 * 65,536 tokens at most
        held = held.union(frequent.agg(F.collect_list(F.col("token").cast("int")).alias("tokens")).select(F.lit(None).cast("long"), "tokens"))
    return past_blocks(held, read, n, lambda batches: _counted(batches, least, most), "a long, b long, score long")


def counts_of_lists(lists: DataFrame, max_frequency: int, least: int = 1) -> DataFrame:
    """shared_token_counts of `least` or more of (item_id, tokens) by the tokens that at most max_frequency items own."""
    return sharing(lists, lists, least, None, frequent_tokens(lists, max_frequency))


def best_pairs(tokens: DataFrame, least: int, per_item: int) -> DataFrame:
    """cap_candidates of the pairs that share `least` tokens or more; what is not among an end's best never leaves its task."""
    return ends(pairs_sharing(tokens, least, per_item))


def best_of_lists(lists: DataFrame, max_frequency: int, least: int, per_item: int) -> DataFrame:
    """best_pairs of (item_id, tokens) by the tokens that at most max_frequency items own."""
    return ends(sharing(lists, lists, least, per_item, frequent_tokens(lists, max_frequency)))


def cap_candidates(counts: DataFrame, per_item: int) -> DataFrame:
    """(a, b): of each item's partners the best by score, then the greater id; a pair stays if either end keeps it."""
    both = counts.select("a", "b", "score").unionAll(counts.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    order = Window.partitionBy("a").orderBy(F.col("score").desc(), F.col("b").desc())
    return ends(both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_item))


def ends(kept: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of pairs from either end."""
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidate_pairs(tokens: DataFrame, p: Params) -> DataFrame:
    """(a, b) of selected tokens: frequent ones cut, enough shared, the best of each item."""
    return best_pairs(drop_frequent(tokens, p.max_frequency), p.min_shared, p.per_item)


def without_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    return pairs.join(known, ["a", "b"], "left_anti")


def likely_items(pairs: DataFrame) -> DataFrame:
    """Distinct ids on either side."""
    return pairs.select(F.col("a").alias("item_id")).union(pairs.select("b")).distinct()
