"""Work on pairs of items: a task holds a block of items and reads all others past it, so that a pair meets in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.durable import durable

ROWS = 4_000_000  # of single tokens in a block
CHUNK = 2_000_000  # of single tokens that a task reads past its block at a time
SAMPLES = 500_000  # in a block of items, and read past it at a time
SAMPLE = {"pos": np.int32, "ts": np.float64, "dhash": np.int64, "ahash": np.int64, "mean": np.int16}


def blocks(spark: SparkSession, rows: int, most: int = ROWS) -> int:
    """Blocks so that there are two for each core, and none holds more than about `most` of rows."""
    return max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows / most))


def block(item: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(n)).cast("int")


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of sizes that sum up to `most`, or to more with one entry only."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1 and so on, sizes[k] of them, one k after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _packed(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, tokens) as bytes (ids, sizes, tokens) by id: one row of them all, or rows with about `most` tokens. Rows without an id hold tokens that don't count."""

    def row(given: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(given)
        gone = rows.filter(pc.is_null(rows.column("item_id"))).column("tokens").combine_chunks().flatten().to_numpy()
        rows = rows.filter(pc.is_valid(rows.column("item_id"))).sort_by("item_id").combine_chunks()
        lists = rows.column("tokens").combine_chunks()
        sizes, tokens = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        if len(gone):
            counts = ~np.isin(tokens, gone)
            sizes, tokens = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[counts], minlength=len(sizes)), tokens[counts]
        columns = (rows.column("item_id").to_numpy().astype(np.int64), sizes.astype(np.int32), tokens.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "sizes", "tokens"])

    given, n = [], 0
    for batch in batches:
        if batch.num_rows:
            given.append(batch)
            n += len(batch.column("tokens").flatten())
        if most and n >= most:
            yield row(given)
            given, n = [], 0
    if given:
        yield row(given)


def past_blocks(held: DataFrame, read: DataFrame, n: int, job: Callable, schema: str) -> DataFrame:
    """job over each of n blocks of `held` (item_id, tokens) and all of `read`, of which it gets batches of rows (ids, sizes, tokens, own_ids, own_sizes, own_tokens), the last three the block's.

    What is read is written once, in rows of about CHUNK tokens, and each task reads it from there; only `held` is shuffled, once, however many blocks there are.
    """
    packed = "ids binary, sizes binary, tokens binary"
    rows = read.agg(F.sum(F.size("tokens"))).first()[0] or 0
    chunks = durable(read.select("item_id", "tokens").coalesce(max(1, math.ceil(rows / ROWS))).mapInArrow(lambda batches: _packed(batches, CHUNK), packed), "chunks")
    dealt = held.where("item_id is not null").select(block(F.col("item_id"), n).alias("block"), "item_id", "tokens")
    dealt = dealt.union(held.where("item_id is null").select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))), "item_id", "tokens"))  # to each block
    own = dealt.repartitionById(n, F.col("block")).drop("block").mapInArrow(_packed, packed).toDF("own_ids", "own_sizes", "own_tokens")
    return chunks.coalesce(1).hint("shuffle_replicate_nl").crossJoin(own).mapInArrow(job, schema)


def _alike(x: np.ndarray) -> np.ndarray:
    """Where two hashes whose differing bits these are have a band, 16 bits, alike."""
    return (x - np.uint64(0x0001000100010001)) & ~x & np.uint64(0x8000800080008000) != 0


def matches(pairs: pa.Table, items: pa.Table, most: int, long: int = 1 << 24) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids a, ids b) of some whole pairs at a time, and their samples that share a token and are at most so far apart: (number of the pair, i, j, ts_a, ts_b, distance).

    Each sample of one side meets each of the other's, and the first hash leaves few of them; in pairs with over `long` of such meetings the
    side with fewer samples looks up the other's, band by band, and two samples are told at their first band alike.
    """
    lists = items.column("samples").combine_chunks()
    every, owner = lists.flatten(), np.repeat(items.column("item_id").to_numpy(), lists.value_lengths().to_numpy())
    by = np.argsort(owner, kind="stable")
    columns = [every.field(n).to_numpy(zero_copy_only=False)[by] for n in SAMPLE]
    known, sizes = np.unique(owner, return_counts=True)
    ends = [pairs.column(n).to_numpy() for n in ("a", "b")]
    there = np.flatnonzero(np.isin(ends[0], known) & np.isin(ends[1], known))
    yield from _matched(known, sizes, columns, *(np.searchsorted(known, x[there]) for x in ends), most, long)


def _matched(known: np.ndarray, size: np.ndarray, columns: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: int, long: int) -> Iterator[tuple[np.ndarray, ...]]:
    """matches() of pairs of numbers of items, whose ids, numbers of samples and samples one after the other are given."""
    pos, ts, dhash, ahash, mean = columns
    begin, item = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(len(size)), size)
    hashes, mean = np.stack([dhash, ahash]).view(np.uint64), mean.astype(np.int32)
    turned = size[a] > size[b]
    asks, asked = np.where(turned, b, a), np.where(turned, a, b)
    by = np.argsort(asked, kind="stable")
    turned, asks, asked = turned[by], asks[by], asked[by]
    meetings = size[asks] * size[asked]
    look = _looked_up(hashes, item, begin, np.flatnonzero(np.isin(item, asked[meetings > long]))) if (meetings > long).any() else None
    for lo, hi in spans(meetings, 1_000_000):
        if meetings[lo] > long:
            pair, x, y = look(asks[lo:hi], asked[lo:hi])
        else:
            pair, x, y = _met(hashes[0], begin, asks[lo:hi], asked[lo:hi], meetings[lo:hi], most)
        bits = [h.take(x) ^ h.take(y) for h in hashes]
        distance = np.bitwise_count(bits[0]).astype(np.int32) + np.bitwise_count(bits[1])
        near = np.flatnonzero((distance <= most) & (_alike(bits[0]) | _alike(bits[1])))
        own, x, y, distance = (c.take(near) for c in (pair, x, y, distance))
        distance += np.minimum(8, np.abs(mean.take(x) - mean.take(y)) // 16)
        if (distance > most).any():
            own, x, y, distance = (c[distance <= most] for c in (own, x, y, distance))
        if len(own):
            back = turned[lo:hi][own]
            i, j = np.where(back, y, x), np.where(back, x, y)
            low, high = (known[np.where(turned[lo:hi], *c)] for c in ((asked[lo:hi], asks[lo:hi]), (asks[lo:hi], asked[lo:hi])))
            yield low, high, own, pos[i].astype(np.int64), pos[j].astype(np.int64), ts[i], ts[j], distance


def _met(hashes: np.ndarray, begin: np.ndarray, asks: np.ndarray, asked: np.ndarray, meetings: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(number of the pair, x, y): samples of the pairs' two sides whose hashes differ in at most so many bits."""
    size, found = np.diff(begin), []
    wide = meetings >= 4096
    few = np.flatnonzero(~wide)
    if len(few):
        n, theirs = size[asks[few]], np.repeat(asked[few], size[asks[few]])
        x, width = ragged(begin[asks[few]], n), size[theirs]
        y = ragged(begin[theirs], width)
        hit = np.flatnonzero(np.bitwise_count(np.repeat(hashes[x], width) ^ hashes[y]) <= most)
        row = np.searchsorted(np.cumsum(width), hit, "right")
        found.append((np.repeat(few, n)[row], x[row], y[hit]))
    for k in np.flatnonzero(wide):
        p, q = (slice(begin[c[k]], begin[c[k] + 1]) for c in (asks, asked))
        step = max(1, 1_000_000 // size[asked[k]])
        for at in range(p.start, p.stop, step):
            hit = np.flatnonzero((np.bitwise_count(hashes[at : min(at + step, p.stop), None] ^ hashes[q]) <= most).ravel())
            x, y = np.divmod(hit, size[asked[k]])
            found.append((np.full(len(hit), k), x + at, y + q.start))
    pair, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    return pair, x, y


def _looked_up(hashes: np.ndarray, item: np.ndarray, begin: np.ndarray, rows: np.ndarray) -> Callable:
    """A function that gives (number of the pair, x, y) of the samples of pairs' two sides with a band alike, each at the first; rows: samples of items that are asked."""
    bands = [(hashes[k // 4] >> np.uint64(16 * (k % 4))).astype(np.uint16) for k in range(8)]
    orders = [rows[np.argsort(item[rows] * 65536 + band[rows])] for band in bands]
    keys = [item[order] * 65536 + band[order] for band, order in zip(bands, orders, strict=True)]

    def look(asks: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, ...]:
        n, found = np.diff(begin)[asks], []
        mine, pair = ragged(begin[asks], n), np.repeat(np.arange(len(asks)), n)
        for k in range(8):
            wanted = asked[pair] * 65536 + bands[k][mine]
            first = np.searchsorted(keys[k], wanted)
            n = np.searchsorted(keys[k], wanted, "right") - first
            at, y = np.repeat(np.arange(len(mine)), n), orders[k][ragged(first, n)]
            x, new = mine[at], np.ones(len(at), bool)
            for e in range(k):
                new &= bands[e][x] != bands[e][y]
            found.append((pair[at[new]], x[new], y[new]))
        pair, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        return pair, x, y

    return look


def _packed_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of bytes (ids, sizes, the columns of SAMPLE, a, b) of rows (item_id, the columns of SAMPLE, a, b) that hold a sample or a pair."""
    given = [b for b in batches if b.num_rows]
    if given:
        rows = pa.Table.from_batches(given)
        samples, pairs = rows.filter(pc.is_valid(rows.column("item_id"))), rows.filter(pc.is_valid(rows.column("a")))
        owner = samples.column("item_id").to_numpy()
        by = np.argsort(owner, kind="stable")
        ids, sizes = np.unique(owner, return_counts=True)
        columns = [ids, sizes.astype(np.int32), *(samples.column(n).to_numpy()[by].astype(t) for n, t in SAMPLE.items()), *(pairs.column(n).to_numpy().astype(np.int64) for n in ("a", "b"))]
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["ids", "sizes", *SAMPLE, "a", "b"])


def over_matches(pairs: DataFrame, samples: DataFrame, most: int, job: Callable, schema: str) -> DataFrame:
    """job, a function of the columns that matches() tells of some whole pairs, over all pairs (a, b); it returns a list of columns.

    A task holds a block's samples and the pairs that end in it, and reads the samples of all items past them from one written table, as
    past_blocks() does; so samples are shuffled twice, however many blocks there are, and no matching samples leave their task but by the job.
    """
    n = blocks(pairs.sparkSession, samples.count(), SAMPLES)
    kinds = {"item_id": "long", "pos": "int", "ts": "double", "dhash": "long", "ahash": "long", "mean": "smallint", "a": "long", "b": "long"}
    row = lambda rows, end: rows.select(block(F.col(end), n).alias("block"), *[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    packed = ", ".join(f"{c} binary" for c in ["ids", "sizes", *SAMPLE, "a", "b"])
    whole = lambda rows: rows.repartitionById(n, F.col("block")).drop("block").mapInArrow(_packed_samples, packed)
    chunks = durable(whole(row(samples, "item_id")).drop("a", "b"), "chunks")
    own = whole(row(samples, "item_id").union(row(pairs, "b")))
    met = chunks.coalesce(1).hint("shuffle_replicate_nl").crossJoin(own.toDF(*[f"own_{c}" for c in own.columns]))
    names = [c.split()[0] for c in schema.split(", ")]
    out = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in schema.split(", ")])
    types = [np.int64, np.int32, *SAMPLE.values()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                read = [np.frombuffer(c[k].as_buffer(), t) for c, t in zip(batch.columns, [*types, *types, np.int64, np.int64], strict=True)]
                (ids, sizes, *theirs), (own_ids, own_sizes, *mine), (a, b) = read[: len(types)], read[len(types) : -2], read[-2:]
                there = np.flatnonzero(np.isin(a, ids) & np.isin(b, own_ids))
                if not len(there):
                    continue
                a, b = np.searchsorted(ids, a[there]), len(ids) + np.searchsorted(own_ids, b[there])
                columns = [np.concatenate(c) for c in zip(theirs, mine, strict=True)]
                for m in _matched(np.concatenate([ids, own_ids]), np.concatenate([sizes, own_sizes]).astype(np.int64), columns, a, b, most, 1 << 24):
                    yield from pa.table(job(*m), names=names).cast(out).to_batches(1_000_000)

    return met.mapInArrow(each, schema)
