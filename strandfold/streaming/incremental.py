"""New items as a stream: fingerprint once, match against what is known.

A store is a folder of tables with versions: items, samples, tokens (an index of postings) and matches, with
the files' fingerprints and failures beside them. Samples and matches are cut by item, postings by
token, and a batch reads only the folders that its own tokens and the items they lead to lie in. A
batch that is run again replaces itself. An item that comes again in a later batch replaces its earlier
samples and tokens, and what it matched before is no longer told. Frequencies and caps are recomputed over
the postings of tokens that new items hold, so a stream can keep pairs that a full scan would have cut;
full_refresh answers as a full scan does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.operators.align import align_pairs, align_samples
from strandfold.operators.candidates import candidate_pairs, ends, frequent_tokens, likely_items, sharing, token_lists
from strandfold.operators.tokens import item_tokens, selected_lists, selected_tokens
from strandfold.operators.verify import matching_points
from strandfold.params import Params
from strandfold.sources.stores import KEY, FileStore
from strandfold.sources.versions import Table

Samples = Callable[[DataFrame], DataFrame]
Files = Callable[[DataFrame], DataFrame]
ITEMS = "item_id long, batch long"


def tables(spark: SparkSession, store: str) -> dict[str, Table]:
    return {
        "items": Table(spark, f"{store}/items", ("item_id",), ("item_id",)),
        "samples": Table(spark, f"{store}/samples", ("item_id",), ("item_id",)),
        "tokens": Table(spark, f"{store}/tokens", (), ("token",), 256),
        "matches": Table(spark, f"{store}/matches", (), ("a",)),
    }


def binary_files(kind: str = "fast", interval: float = 0.0) -> Files:
    """The store's key of rows of a binaryFile stream."""
    return lambda rows: rows.withColumns({
        "size_bytes": F.col("length"), "mtime_ns": F.unix_micros("modificationTime") * 1000, "kind": F.lit(kind), "interval": F.lit(interval),
    })


def _once(batch: DataFrame, key: str) -> DataFrame:
    """One row of each key; of several in a batch the greatest."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[f"_r.{c}" for c in rest])


def _store(batch: DataFrame, number: int, to_samples: Samples, store: str, p: Params, key: str, files: Files | None, retry: bool) -> DataFrame:
    """Puts the batch's samples, selected tokens and items into the store; returns the tokens (item_id, token).

    With files, items that are known or failed before unchanged are left out; those that give no samples fail.
    """
    spark, at, name = batch.sparkSession, tables(batch.sparkSession, store), f"batch-{number}"
    rows = durable(_once(batch, key), "batch")
    if files:
        known = FileStore(spark, store, number)
        told = durable(known.split(files(rows).select(F.col(key).alias("item_id"), *KEY), retry), "told").where("status = 'pending'")
        rows = rows.join(told.select(F.col("item_id").alias(key)), key, "left_semi")
    samples = durable(to_samples(rows), "samples")
    made = samples.select("item_id").distinct()
    tokens = durable(selected_lists(samples, p.token_limit).select("item_id", F.explode("tokens").alias("token")), "tokens")
    stamp = F.lit(number).cast("long").alias("batch")
    at["samples"].append(samples.select("*", stamp), name)
    at["tokens"].append(tokens.select("item_id", "token", stamp), name)
    at["items"].append(rows.select(F.col(key).cast("long").alias("item_id"), stamp), name)
    if files:
        known.put(told.join(made, "item_id", "left_semi").select(*KEY), name)
        known.fail(told.join(made, "item_id", "left_anti").select(*KEY, F.lit("no samples").alias("error")), name)
    return tokens


def _live(rows: DataFrame, items: Table) -> DataFrame:
    """Of rows (item_id, batch, ...) those of each item's last batch; only the folders of these items are read."""
    last = items.read(items.touched(rows.select("item_id").distinct()), empty=ITEMS)
    return rows.join(last, ["item_id", "batch"], "left_semi")


def current(spark: SparkSession, store: str, table: str) -> DataFrame:
    """Rows of samples or tokens: of each item those that came last."""
    at = tables(spark, store)
    return at[table].read().join(at["items"].read(empty=ITEMS), ["item_id", "batch"], "left_semi").drop("batch")


def current_matches(spark: SparkSession, store: str) -> DataFrame:
    """Matches but those of which an end has come again since."""
    at = tables(spark, store)
    last, rows = at["items"].read(empty=ITEMS), at["matches"].read()
    for end in ("a", "b"):
        rows = rows.join(last.select(F.col("item_id").alias(end), F.col("batch").alias("_last")), end).where("_last <= batch").drop("_last")
    return rows


def stream_fingerprints(stream: DataFrame, to_samples: Samples, store: str, checkpoint: str, p: Params, key: str = "doc_id", files: Files | None = None, retry: bool = False):
    """A query that puts the samples and selected tokens of arriving items into the store, each unchanged file once.

    files: adds the columns of the store's key to rows; without it every arriving item is new.
    """

    def keep(batch: DataFrame, number: int) -> None:
        _store(batch, number, to_samples, store, p, key, files, retry)

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def postings(spark: SparkSession, store: str, tokens: DataFrame) -> DataFrame:
    """(item_id, token, batch) that the store holds of the tokens; only the folders they lie in are read."""
    table = tables(spark, store)["tokens"]
    asked = tokens.select("token").distinct()
    return table.read(table.touched(asked), empty="item_id long, token int, batch long").join(asked, "token", "left_semi")


def new_pairs(spark: SparkSession, store: str, tokens: DataFrame, p: Params) -> DataFrame:
    """(a, b) with an item of these tokens (item_id, token) at one end at least, of all stored ones that share enough rare tokens."""
    held = _live(postings(spark, store, tokens), tables(spark, store)["items"]).select("item_id", "token")
    lists = token_lists(held)
    frequent, new = frequent_tokens(lists, p.max_frequency), tokens.select("item_id").distinct()
    own, other = durable(lists.join(new, "item_id", "left_semi"), "new"), durable(lists.join(new, "item_id", "left_anti"), "other")
    # of a new item all partners count, of another one those that are new
    return ends(sharing(own, lists, p.min_shared, p.per_item, frequent).unionAll(sharing(other, own, p.min_shared, p.per_item, frequent)))


def match_new(spark: SparkSession, store: str, tokens: DataFrame, p: Params) -> DataFrame:
    """Aligned points of the items of these tokens x all stored items."""
    samples, pairs = tables(spark, store)["samples"], durable(new_pairs(spark, store, tokens, p), "pairs")
    met = likely_items(pairs)
    rows = samples.read(samples.touched(met), empty="item_id long, pos int, ts double, dhash long, ahash long, mean int, batch long")
    rows = durable(rows.join(met, "item_id", "left_semi").drop("batch"), "met")
    return align_pairs(matching_points(pairs, rows, p.distance), p) if "regions" in rows.columns else align_samples(pairs, rows, p)


def stream_match_new(spark: SparkSession, stream: DataFrame, to_samples: Samples, store: str, checkpoint: str, p: Params, key: str = "doc_id", files: Files | None = None, retry: bool = False):
    """The same, and the matches of every batch with all that is stored; tokens are read, not made again."""

    def keep(batch: DataFrame, number: int) -> None:
        tokens = _store(batch, number, to_samples, store, p, key, files, retry)
        found = match_new(spark, store, tokens, p)
        tables(spark, store)["matches"].append(found.withColumn("batch", F.lit(number).cast("long")), f"batch-{number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def full_refresh(samples: DataFrame, p: Params) -> DataFrame:
    """Aligned points of all pairs of stored items."""
    pairs = candidate_pairs(selected_tokens(item_tokens(samples), p.token_limit), p)
    return align_pairs(matching_points(pairs, samples, p.distance), p)
