"""Embedding near-duplicates over robust-pruned flat graphs.

Vectors are compared within a label and a length. Equal vectors are one node with a weight. Each label
is cut into clusters around centres drawn from its own vectors; a vector belongs to the cluster of its
nearest centre (its home) and to all clusters whose centres are within `margin` of that in cosine, so
shards overlap. In each shard every node gets a robust-pruned list of neighbours, with their reverse
edges; the lists of a node from all shards are united. Then every vector searches its home shard: a
greedy beam search from the medoid (and some fixed entries) walks towards it; once inside the
threshold, the walk spreads over every neighbour that is within it (range expansion). What is found
is verified by the cosine in double precision. A sample of vectors is held against all vectors block by
block, drawn from all and from those that have a link to a vector on the same side of random planes,
which is told without the search; if the mean recall of the linked ones among them falls below
`recall`, margin and beam are widened and the search is repeated. Where TRIES searches fall short, or
fewer than AUDITED audited vectors are linked, so that their recall tells little, clusters are compared exactly: with t the angle of the threshold, vectors join every cluster
whose centre is at most 2 t further away than their nearest, which by the triangle inequality puts
both ends of each link into either's home. A cluster of more than CELL nodes is searched as several graphs, each by all of its
vectors, so no task holds more than CELL nodes and CELL queries.

Rows: a null label, a null, empty or zero vector and one with null or non-finite components link with
nothing (n_links 0, component_id its own id); equal vectors, also repeated rows, link with each
other; ties need no order; a null vec_id links and is counted, but names no component; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandfold.durable import durable
from strandfold.operators.components import connected_components

THRESHOLD = 0.98
CELL = 2048
PER_CENTRE = 400
CENTRES = 1024
DEGREE, POOL, ALPHA = 24, 64, 1.2
BEAM, ENTRIES, MARGIN = 48, 8, 0.12
AUDIT, RECALL, TRIES = 200, 0.99, 3
PLANES, AUDITED = 16, 50
SLICE = 8192


def _matrix(vectors) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def robust_lists(x: np.ndarray) -> list[tuple[int, int]]:
    """Edges (from, to), both ways, of the robust-pruned graph: of a node's nearest, one stays unless a kept one is closer to it by ALPHA."""
    n = len(x)
    edges: set[tuple[int, int]] = set()
    pool = min(POOL, n - 1)
    for lo in range(0, n if pool else 0, 128):
        rows = np.arange(lo, min(lo + 128, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool]
        own = np.take_along_axis(sims, near, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
        among = np.sqrt(np.maximum(2 - 2 * np.einsum("nkd,njd->nkj", x[near], x[near]), 0))
        away = np.sqrt(np.maximum(2 - 2 * own, 0))
        alive, kept = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for k in range(pool):
            take = alive[:, k] & (kept.sum(axis=1) < DEGREE)
            kept[take, k] = True
            alive &= ~(take[:, None] & (ALPHA * among[:, k] <= away))
        a, b = np.nonzero(kept)
        edges.update(zip(rows[a].tolist(), near[a, b].tolist(), strict=True))
    return sorted(edges | {(b, a) for a, b in edges})


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, threshold: float, beam: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query's number, nodes within the threshold). lists: n x R node numbers, -1 where none; own: each query's node or -1.

    All queries of a batch walk in step. A query that never met its own node starts from it once more.
    """
    n = len(x)
    centre = x.mean(axis=0)
    entries = np.unique(np.concatenate([[int((x @ centre).argmax())], np.linspace(0, n - 1, min(ENTRIES, n)).astype(int)]))
    for lo in range(0, len(queries), 256):
        q, mine = queries[lo : lo + 256], own[lo : lo + 256]
        sims, open_ = np.full((len(q), n), -np.inf), np.zeros((len(q), n), bool)
        sims[:, entries] = q @ x[entries].T
        open_[:, entries] = True
        restarted = False
        while True:
            least = np.partition(sims, -min(beam, n), axis=1)[:, -min(beam, n)] if n > 1 else sims[:, 0]
            ready = np.where(open_ & ((sims >= least[:, None]) | (sims >= threshold)), sims, -np.inf)
            wide = min(8, n)
            best = np.argpartition(-ready, wide - 1, axis=1)[:, :wide]
            who, which = np.nonzero(np.take_along_axis(ready, best, 1) > -np.inf)
            if not len(who):
                lost = np.flatnonzero((mine >= 0) & np.isneginf(sims[np.arange(len(q)), np.maximum(mine, 0)]))
                if restarted or not len(lost):
                    break
                restarted = True
                sims[lost, mine[lost]] = 1.0
                open_[lost, mine[lost]] = True
                continue
            node = best[who, which]
            open_[who, node] = False
            step = lists[node]
            who, step = np.repeat(who, step.shape[1]), step.ravel()
            new = step >= 0
            who, step = who[new], step[new]
            new = np.isneginf(sims[who, step])
            who, step = who[new], step[new]
            key = np.unique(who * n + step)
            who, step = key // n, key % n
            sims[who, step] = np.einsum("nd,nd->n", q[who], x[step])
            open_[who, step] = True
        for i in range(len(q)):
            yield lo + i, np.flatnonzero(sims[i] >= threshold)


def exact_search(x: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(query's number, nodes within the threshold), by all cosines."""
    for lo in range(0, len(queries), 256):
        for i, sims in enumerate(queries[lo : lo + 256] @ x.T):
            yield lo + i, np.flatnonzero(sims >= threshold)


def _centres(nodes: DataFrame) -> DataFrame:
    """(part, centres): of each part about one node in PER_CENTRE, at most about CENTRES, drawn by hash."""
    many = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    drawn = nodes.join(many, "part").where(
        F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) * F.col("n") < F.lit(1 << 30) * F.least(F.ceil(F.col("n") / PER_CENTRE), F.lit(CENTRES))
    )
    return drawn.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("node", "vector"))).getField("vector").alias("centres"))


def _cells(nodes: DataFrame, margin: float, threshold: float | None = None) -> DataFrame:
    """(part, cell, home, node, vector, weight): every node once for each cell it belongs to.

    With a threshold, to all cells that can hold a home of one linked with it. A part is dealt in
    slices of about SLICE nodes, each of which meets the part's centres once.
    """
    slices = nodes.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    placed = nodes.select("part", "node", "vector", "weight").join(slices, "part")
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("node", F.lit(13)), "slices").cast("int")).drop("slices")
    centres = _centres(nodes).join(slices, "part").select(F.col("part").alias("of"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("at"), "centres")
    kept = ["part", "node", "vector", "weight"]

    def cells(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        told = [[0]] * len(rows)
        if len(rows) and len(centres):
            table, told = _matrix(centres["centres"].iloc[0]), []
            for lo in range(0, len(rows), 1024):
                for sims in _matrix(rows["vector"].iloc[lo : lo + 1024]) @ table.T:
                    first = int(sims.argmax())
                    least = sims[first] - margin
                    if threshold is not None:
                        angle = np.arccos(np.clip(sims[first], -1, 1)) + 2 * np.arccos(np.clip(threshold, -1, 1)) + 1e-6
                        least = np.cos(min(angle, np.pi)) - 1e-9
                    told.append([first, *(int(k) for k in np.flatnonzero(sims >= least) if k != first)])
        return rows[kept].assign(cells=told)

    schema = T.StructType([*(placed.schema[c] for c in kept), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    found = placed.groupBy("part", "slice").cogroup(centres.groupBy("of", "at")).applyInPandas(cells, schema)
    return found.select(*kept, F.posexplode("cells").alias("place", "cell")).select("part", "cell", (F.col("place") == 0).alias("home"), "node", "vector", "weight")


def _lists(cells: DataFrame) -> DataFrame:
    """(node, list): united neighbours of each node over all its shards."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        edges = robust_lists(_matrix(rows["vector"]))
        ids = rows["node"].to_numpy()
        a = np.array([e[0] for e in edges], np.int64)
        b = np.array([e[1] for e in edges], np.int64)
        return pd.DataFrame({"node": ids[a] if len(a) else ids[:0], "to": ids[b] if len(b) else ids[:0]})

    built = cells.groupBy("part", "cell", "block").applyInPandas(build, "node long, to long")
    return built.groupBy("node").agg(F.collect_set("to").alias("list"))


def _search(rows: DataFrame, threshold: float, beam: int | None) -> DataFrame:
    """(node, found: weight found, to: least node found with it) per query and graph; without a beam by all cosines."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        graph, asked = rows[~rows["query"]], rows[rows["query"]]
        if not len(graph) or not len(asked):  # nobody's home, or nothing to search
            ids = asked["node"].to_numpy()
            return pd.DataFrame({"node": ids, "found": np.zeros(len(ids), np.int64), "to": ids})
        ids, x = graph["node"].to_numpy(), _matrix(graph["vector"])
        order = np.argsort(ids)
        ids, x, weight, lists = ids[order], x[order], graph["weight"].to_numpy()[order], [graph["list"].iloc[k] for k in order]
        width = max([1, *(len(t) for t in lists if t is not None)])
        table = np.full((len(ids), width), -1)
        for k, to in enumerate(lists):
            if to is not None and len(to):
                at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
                at = at[ids[at] == to]  # a neighbour of another shard may not be here
                table[k, : len(at)] = at
        mine = asked["node"].to_numpy()
        own = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
        own = np.where(ids[own] == mine, own, -1)
        q = _matrix(asked["vector"])
        found, root = np.zeros(len(mine), np.int64), mine.copy()
        parent = {int(i): int(i) for i in np.concatenate([ids, mine])}

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        walk = exact_search(x, q, threshold) if beam is None else range_search(x, table, q, threshold, beam, own)
        for k, near in walk:
            near = near[ids[near] != mine[k]]
            found[k] = weight[near].sum()
            a = top(int(mine[k]))
            for b in {top(int(i)) for i in ids[near]}:
                a, b = min(a, b), max(a, b)
                parent[b] = a
        # All that this graph joins is told by one edge a node, and nothing by a pair.
        nodes = np.unique(np.concatenate([ids, mine]))
        tops = np.array([top(int(i)) for i in nodes])
        edge = tops != nodes
        return pd.DataFrame({
            "node": np.concatenate([mine, nodes[edge]]), "found": np.concatenate([found, np.full(edge.sum(), -1)]), "to": np.concatenate([root, tops[edge]]),
        })

    return rows.groupBy("part", "cell", "block", "turn").applyInPandas(search, "node long, found long, to long")


def _blocked(cells: DataFrame) -> DataFrame:
    """Cells with the number of their node's graph (block), and how many graphs their cell has (blocks)."""
    many = cells.groupBy("part", "cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))
    return cells.join(many, ["part", "cell"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))


def _found_by(cells: DataFrame, lists: DataFrame | None, threshold: float, beam: int | None) -> tuple[DataFrame, DataFrame]:
    """(hits of _search, weight found per node): each node asked in all graphs of its home."""
    turns = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    none = F.lit(None).cast("array<bigint>")
    queries = cells.where("home").select("part", "cell", turns.alias("block"), F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int").alias("turn"), "node", "vector", "weight")
    graph = cells.join(lists, "node", "left") if lists is not None else cells.withColumn("list", none)
    graph = graph.select("part", "cell", "block", turns.alias("turn"), "node", "vector", "weight", "list")
    both = graph.withColumn("query", F.lit(False)).unionByName(queries.withColumn("list", none).withColumn("query", F.lit(True)))
    hits = durable(_search(both, threshold, beam), "hits")
    return hits, hits.where("found >= 0").groupBy("node").agg(F.sum("found").alias("found"))


def _likely(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node): nodes that a test which knows nothing of the search finds linked: the cosine with one vector that lies on the same side of PLANES random planes."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            found = np.zeros(len(rows), np.int64)
            for size, at in rows.groupby(rows["vector"].map(len)).indices.items():
                planes = np.random.default_rng(size).normal(size=(PLANES, size))
                x = np.stack([np.asarray(v, np.float64) for v in rows["vector"].iloc[at]])
                found[at] = (x @ planes.T > 0) @ (1 << np.arange(PLANES))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("node"), batch.column("vector"), pa.array(found)], names=["part", "node", "vector", "side"])

    kind = nodes.schema["vector"].dataType.simpleString()
    placed = durable(nodes.select("part", "node", "vector").mapInArrow(sides, f"part string, node {nodes.schema['node'].dataType.simpleString()}, vector {kind}, side long"), "sides")
    first = placed.groupBy("part", "side").agg(F.min("node").alias("mate"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = durable(first.join(placed.select(F.col("node").alias("mate"), F.col("vector").alias("w")), "mate"), "mates")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    met = placed.join(first, ["part", "side"]).where("node <> mate")
    return met.where(dot("vector", "w") >= threshold * F.sqrt(dot("vector", "vector")) * F.sqrt(dot("w", "w"))).select("node")


def _audit(nodes: DataFrame, threshold: float, found: DataFrame, likely: DataFrame) -> tuple[float | None, int]:
    """Mean recall of the linked ones among AUDIT nodes and AUDIT likely ones, by cosine with all nodes in blocks, and their number; None if none is linked."""
    order = F.xxhash64("node", F.lit(17))
    drawn = nodes.orderBy(order).limit(AUDIT).select("node").unionByName(likely.orderBy(order).limit(AUDIT)).distinct()
    sample = nodes.join(drawn, "node").select("part", "node", "vector").toPandas()  # at most 2 AUDIT vectors
    if not len(sample):
        return None, 0
    parts = {p: (g["node"].to_numpy(), _matrix(g["vector"])) for p, g in sample.groupby("part")}

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            ids, sums = [], []
            for part, group in rows.groupby("part"):
                if part in parts:
                    mine, q = parts[part]
                    near = (q @ _matrix(group["vector"]).T >= threshold) & (mine[:, None] != group["node"].to_numpy()[None])
                    ids += mine.tolist()
                    sums += (near @ group["weight"].to_numpy()).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.int64())], names=["node", "true"])

    truth = nodes.select("part", "node", "vector", "weight").mapInArrow(job, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    share = F.least("true", F.coalesce("found", F.lit(0))) / F.col("true")
    got = truth.where(F.col("true") > 0).join(found, "node", "left").agg(F.avg(share).alias("recall"), F.count(F.lit(1)).alias("n")).first()
    return got["recall"], got["n"]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) per row of vectors; recall: what the audit of the search measured, null where no audited vector is linked."""
    v = F.transform(F.col("vector"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("vector"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    fine = fine & F.col("label").isNotNull()
    part = F.concat_ws("/", F.col("label").cast("string"), F.size("vector").cast("string"))
    key = F.xxhash64(part, F.transform("vector", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("part", F.when(fine, part)).withColumn("node", F.when(fine, key))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("part").alias("part"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low")
    )
    nodes = durable(nodes, "nodes")
    margin, beam, exact = MARGIN, BEAM, False
    likely = durable(_likely(nodes, threshold), "likely")
    for _ in range(TRIES):
        cells = durable(_blocked(_cells(nodes, margin)), "cells")
        hits, found = _found_by(cells, _lists(cells), threshold, beam)
        reached, linked = _audit(nodes, threshold, found, likely)
        if linked >= AUDITED and reached >= recall:
            break
        if linked < AUDITED:  # too few to tell the search's recall
            exact = True
            break
        margin, beam = margin * 1.5, beam * 2
    else:
        exact = True
    if exact:
        hits, found = _found_by(durable(_blocked(_cells(nodes, 0.0, threshold)), "cells"), None, threshold, None)
        reached, _ = _audit(nodes, threshold, found, likely)
    labels = connected_components(hits.where("found < 0"), "node", "to")
    named = nodes.select("node", "low", "weight").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = named.join(lows, "component").join(found, "node", "left").select(
        "node", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("links"), "component_id"
    )
    out = rows.select("vec_id", "node").join(facts, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"), F.lit(reached).cast("double").alias("recall"))
