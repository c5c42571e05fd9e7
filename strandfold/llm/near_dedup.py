"""MinHash near-duplicate groups with sequential Bayesian verification.

Documents of equal shingle sets are one node from the start. Nodes that share a band of their
signatures are candidates. First, in STARS rounds, one member of each bucket (its pivot, drawn by hash)
meets its other members that are not yet in the pivot's component; these links join most of any large
group. Pairs inside one component need no test, since only components are asked for. Buckets that
still hold several components are then cut into tiles of at most about TILE members and TILE_SHINGLES
shingles, and every two tiles of a bucket are compared in one task, pair by pair across components: no
row is made of a pair, only of the links that join components, and nothing is skipped at any group
size. Each pair is tested on batches of its signatures: it goes as soon as the posterior probability of
similarity >= threshold falls below `miss`; survivors are verified exactly on their whole sets.

Rows: null or empty texts and texts without words have an empty set and link with nothing; a
document with fewer than five words has its whole word sequence as the one shingle; very long texts
are read whole; repeated rows are equal sets, so they share a component; a null doc_id links but
cannot name a component (component_id is null if no other id is in it). One row of each component is
kept, one of its least id; unlike texts that repeat an id, or have none, are rows of their own, each
in its own component though these may bear the same id. An empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.llm import words as W
from strandfold.operators.components import connected_components

BANDS, ROWS = 32, 5
BATCH = 32
STARS = 3
MISS = 1e-5
TILE, TILE_SHINGLES = 512, 2_000_000


def least_matches(n: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes seen, least matches with which a pair stays), batch by batch.

    Under a uniform prior the similarity after m matches of k is Beta(m + 1, k - m + 1), and the
    probability that it is at least t is that of at most m successes in k + 1 draws of chance t.
    """
    out = []
    for k in range(BATCH, n + 1, BATCH):
        total, m = 0.0, -1
        while total < miss and m < k:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append((k, m))
    return out


def _row(doc_id: str, text: str) -> Column:
    """128 bits that stand for a row's id and text, nulls included; the same whenever the row is read."""
    cells = [F.col(doc_id).cast("long"), F.col(doc_id).isNull(), F.col(text), F.col(text).isNull()]
    return F.concat_ws(".", *[F.xxhash64(F.lit(k), *cells).cast("string") for k in (1, 2)])


def _sketch(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, place: number of the row, n_shingles, node: digest of the whole set or null, sig, bands)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = W.MinHash(bands * rows)
        salt = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts = W.as_strings(batch.column(3))
            for lo, hi, codes, bounds in W.word_codes(texts):
                n, node, sig, keys = [], [], [], []
                for s in W.shingle_sets(codes, bounds):
                    n.append(len(s))
                    node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    mine = minhash(s) if len(s) else None
                    sig.append(mine.tobytes() if len(s) else None)
                    if mine is None:
                        keys.append(None)
                    else:
                        folded = salt.copy()
                        for part in mine.reshape(bands, rows).T.astype(np.uint64):
                            folded = W.mix(folded + part)
                        keys.append(folded.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(lo, hi - lo) for k in range(3)), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "row", "place", "n_shingles", "node", "sig", "bands"],
                )
        W.release()

    place = F.monotonically_increasing_id()
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), _row(doc_id, text).alias("row"), place.alias("place"), F.col(text).alias("text")).mapInArrow(
        job, "doc_id long, row string, place long, n_shingles long, node binary, sig binary, bands array<long>"
    )


def _whole_sets(docs: DataFrame) -> DataFrame:
    """(node, set: array of distinct shingle codes) of (row, text)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, bounds in W.word_codes(W.as_strings(batch.column(1))):
                sets = [s.view(np.int64) for s in W.shingle_sets(codes, bounds)]
                node = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])
        W.release()

    return docs.mapInArrow(job, "node binary, set array<long>")


def _stays(steps: list[tuple[int, int]]):
    """Whether a pair survives every batch of its signatures."""

    @F.pandas_udf("boolean")
    def stays(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint32).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint32).reshape(len(b), -1)
        alive, seen, matches = np.arange(len(a)), 0, np.zeros(len(a), np.int64)
        for k, least in steps:
            matches = matches + (x[alive, seen:k] == y[alive, seen:k]).sum(axis=1)
            good = matches >= least
            alive, matches, seen = alive[good], matches[good], k
        out = np.zeros(len(a), bool)
        out[alive] = True
        return pd.Series(out)

    return stays


def _tile_links(percent: int, steps: list[tuple[int, int]]):
    """Of two tiles of a bucket, verified links that join components; a pair whose ends are joined meanwhile is not tested."""

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        node, n, sets = rows["node"].to_numpy(), rows["n"].to_numpy(), rows["set"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(len(rows), -1)
        part, tile = rows["component"].factorize()[0], rows["tile"].to_numpy()
        links = []
        first, second = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        for i in first:
            j = second[(part[second] != part[i]) & ((second > i) | (key[1] != key[2]))]
            j = j[100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])]
            seen, same = 0, np.zeros(len(j), np.int64)
            for k, least in steps:
                same = same + (sig[j, seen:k] == sig[i, seen:k]).sum(axis=1)
                good = same >= least
                j, same, seen = j[good], same[good], k
                if not len(j):
                    break
            for x in j:
                if part[x] != part[i]:
                    both = len(np.intersect1d(sets[i], sets[x], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[x] - both):
                        links.append((min(node[i], node[x]), max(node[i], node[x])))
                        part[part == part[x]] = part[i]
        return pd.DataFrame(links, columns=["a", "b"])

    return job


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    percent: int = 75,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = MISS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of docs; links have 100 * intersection >= percent * union."""
    return _found(docs, doc_id, text, percent, bands, rows, miss).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """One row of docs for each component of near_duplicates, of its least id, with all columns."""
    kept = _found(docs, doc_id, text, percent, BANDS, ROWS, MISS).where("stays")
    kept = kept.select(F.col("row").alias("_row"), F.col("node").isNull().alias("_wordless")).distinct()
    # Rows of one id and text are one component, so one stays; rows without words are no copies of each other.
    once = F.when(F.col("_wordless"), F.monotonically_increasing_id())
    met = docs.withColumn("_row", _row(doc_id, text)).join(kept, "_row").withColumn("_once", once)
    return met.dropDuplicates(["_row", "_once"]).select(*docs.columns)


def _found(docs: DataFrame, doc_id: str, text: str, percent: int, bands: int, rows: int, miss: float) -> DataFrame:
    """near_duplicates with the columns row, node and stays: whether a row is the one of its component that stays, among rows of one id too."""
    sketch = durable(_sketch(docs, doc_id, text, bands, rows), "sketch")
    low = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row", "place")
    nodes = sketch.where("node is not null").groupBy("node").agg(
        F.min(low).alias("low"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    nodes = durable(nodes, "nodes")
    # Equal sets are one node, so thousands of copies make one row in a bucket.
    bucket = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    wide = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
    member = durable(bucket.join(wide, "bucket"), "members")
    facts = durable(nodes.join(member.select("node").distinct(), "node").select("node", "low", "n", "sig"), "facts")
    labels = _link(docs, text, doc_id, member, facts, percent, least_matches(bands * rows, percent / 100, miss))
    lows = (
        labels.join(facts.select("node", "low"), "node")
        .groupBy("component").agg(F.min("low").alias("least"))
        .join(labels, "component")
        .select("node", "least")
    )
    alone = nodes.select("node", "low")
    found = alone.join(lows, "node", "left").select("node", F.coalesce("least", "low").alias("least"))
    out = sketch.select("doc_id", "row", "place", "n_shingles", "node").join(found, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    stays = F.col("node").isNull() | (F.col("place") == F.col("least.place"))
    return out.select("doc_id", "row", "node", "n_shingles", own.alias("component_id"), stays.alias("stays"))


def _link(docs, text, doc_id, member, facts, percent, steps) -> DataFrame:
    """(node, component) of the nodes that link."""
    texts = docs.select(_row(doc_id, text).alias("row"), F.col(text).alias("text")).join(facts.select("low.row"), "row", "left_semi")
    sets = durable(_whole_sets(texts).join(facts.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    stays = _stays(steps)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that are links."""
        x = facts.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = facts.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        close = (
            pairs.join(x, "a").join(y, "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .where(stays("sa", "sb")).select("a", "b")
        )
        full = (
            close.join(sets.select(F.col("node").alias("a"), F.col("set").alias("ta")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("tb")), "b")
            .withColumn("both", F.size(F.array_intersect("ta", "tb")))
        )
        return full.where(100 * F.col("both") >= percent * (F.size("ta") + F.size("tb") - F.col("both"))).select("a", "b")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Components after new links."""
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
            labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b"
        )
        into = connected_components(ends, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("into"))
        return durable(labels.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "labels")

    def open_(labels: DataFrame) -> DataFrame:
        """Members, with their components, of the buckets that hold several."""
        placed = member.join(labels, "node")
        several = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
        return durable(placed.join(several.where("least <> most").select("bucket", "m", "shingles"), "bucket"), "open")

    labels = facts.select("node", F.col("node").alias("component"))
    for turn in range(STARS):
        left = open_(labels)
        pivots = left.groupBy("bucket").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("p"))
        star = left.join(pivots, "bucket").where("component <> p.component")
        pairs = star.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        labels = merged(labels, durable(verified(pairs), "links"))
    tiles = F.ceil(F.greatest(F.col("m") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int")
    tiled = open_(labels).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(-1)), "tiles").cast("int"))
    dealt = tiled.join(facts.select("node", "sig"), "node").join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})
    links = dealt.groupBy("bucket", "lo", "hi").applyInPandas(_tile_links(percent, steps), "a binary, b binary")
    return merged(labels, durable(links.distinct(), "links"))


def oracle_sql(percent: int = 75) -> str:
    """The same for DuckDB, for tables without repeated or null ids: all pairs that share a shingle, and their closure."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as materialized (
  select doc_id, case when len(w) >= {W.SHINGLE} then list_distinct(list_transform(range(1, len(w) - {W.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {W.SHINGLE - 1}], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from words),
flat as materialized (select doc_id, unnest(s) as x from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from flat a join flat b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as materialized (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
ways as (select a, b from links union all select b, a from links),
reach as (select a, b from ways union select r.a, w.b from reach r join ways w on w.a = r.b),
lowest as (select a as doc_id, min(b) as b from reach group by a)
select s.doc_id, len(s.s)::bigint as n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) as component_id, s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) as kept
from sets s left join lowest l using (doc_id)"""
