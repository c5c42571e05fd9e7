"""A prefix trie of conversations, with sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns. It is named by the least conversation that begins with it
(its owner) and its depth: a conversation owns the last nodes of its path, from some depth on, and no other
conversation does, so owned nodes are the trie and paths of owners are all its edges. Prefixes are
told apart by their depth and 128 bits: the exclusive or of digests of (place, turn), which running
aggregates make without gathering a conversation.

Subtree sums come from a centroid decomposition of the forest of parent edges. How many nodes a
subtree has is counted from owners, so the splitting nodes of all large components are found at once:
nodes of SMALL or more below them that have no or several such children, or one with which they differ in
the multiple of SMALL reached. Without these, of which there are at most 4 for every SMALL nodes, all
components have fewer than SMALL nodes. Their totals are added up over the tree of splitting nodes, by
the same step with SMALL times as much; what hangs below a component is added to the node it hangs on.
Each component is then taken apart in a task: its centroid splits it, the total below the centroid is added
along the path from the centroid to the component's top, and the rest is split on, all components of a
batch in step, so that a node is handled once for each halving.

Rows: a null role or text counts as empty, a null turn comes first, turns of one number are ordered by
the digests of role and text, repeated rows are turns of their own; rows without a conv_id belong to no
conversation; conversations of any length are cut into stretches; copies of a conversation meet only as
counts and as stretches of ids; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.llm.columns import crc32_sql
from strandfold.operators.places import placed, running

SMALL = 4096
BATCH = 1 << 16
IDS = 4096
MOST = 9
GROUP = 5
KEY = ["conv_id", "depth"]


def _h(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % MOST


def rebuilt(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv_id, turns) of all conversations, and their turns (conv_id, depth from 1, digest, bytes), after each got the first turns of the first of its GROUP."""
    said = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null").select("conv_id", "turn", F.sha2(said, 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # rows alike in all else are interchangeable
    own = placed(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("tie")])
    own = durable(own.select("conv_id", "place", "size", "digest", "bytes"), "turns")
    sizes = own.groupBy("conv_id").agg(F.max("size").alias("size"))
    sizes = durable(sizes.select("conv_id", "size", _h(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")), "sizes")
    first = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("there"))
    got = F.least("h", F.coalesce("there", F.lit(0)))
    convs = sizes.join(first, "base", "left").select("conv_id", "base", "h", got.alias("got"), (got + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("turns"))
    convs = durable(convs, "convs")
    kept = own.join(convs.select("conv_id", "h", "got"), "conv_id").where("place >= h").select("conv_id", (F.col("got") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    heads = own.where(F.col("place") < MOST - 1).withColumnRenamed("conv_id", "base")
    lent = convs.select("conv_id", "base", "h").join(heads, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes")
    return convs.select("conv_id", "turns"), kept.unionByName(lent)


def _paths(turns: DataFrame) -> DataFrame:
    """turns with their prefix's name (x, y) instead of the digest."""
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), "digest"), 256)
    half = lambda at: F.conv(F.substring(mixed, at, 16), 16, -10).cast("long")
    return running(turns, "conv_id", "depth", {"x": (F.bit_xor, half(1)), "y": (F.bit_xor, half(17))}).drop("digest")


def build(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trie's nodes, the paths to them, and who ends where.

    nodes: (conv_id, depth, parent_conv_id, n_convs, bytes, size, n_children), size being that of the subtree.
    paths: (path, depth, conv_id), the owners of all prefixes of each conversation that owns a node.
    ends: (conv_id, depth, member), the node at which each conversation ends.
    """
    long = lambda x: F.lit(x).cast("long")
    passing = durable(_paths(turns), "prefixes")
    prefix = ["depth", "x", "y"]
    groups = durable(passing.groupBy(*prefix).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")), "groups")
    every = durable(passing.join(groups, prefix).select("conv_id", "depth", "owner", "n_convs", "bytes"), "owners")
    whole = convs.agg(F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("n")).first()
    own = every.where("conv_id = owner").drop("owner")
    starts = durable(own.groupBy("conv_id").agg(F.min("depth").alias("start"), F.max("depth").alias("last")), "starts")
    # Of the nodes that a conversation owns, those no higher than a prefix of its own lie below that.
    below = every.select("conv_id", "depth", "owner").join(starts, "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(
        F.sum(F.greatest(F.col("last") - F.greatest("start", "depth") + 1, long(0))).alias("size")
    )
    total = starts.agg(F.coalesce(F.sum(F.col("last") - F.col("start") + 1), F.lit(0)).alias("n")).first()["n"]
    above = every.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    nodes = own.join(above, KEY, "left").join(below, KEY).select(*KEY, F.coalesce("parent_conv_id", long(whole["first"])).alias("parent_conv_id"), "n_convs", "bytes", "size")
    root = convs.sparkSession.range(1 if whole["n"] else 0).select(
        long(whole["first"]).alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(whole["n"]).alias("n_convs"), long(0).alias("bytes"), long(total + 1).alias("size")
    )
    nodes = durable(nodes.unionByName(root), "nodes")
    kids = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = durable(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", long(0))), "nodes")
    owners = starts.select("conv_id").unionByName(root.select("conv_id")).distinct()
    paths = every.join(owners, "conv_id", "left_semi").select(F.col("conv_id").alias("path"), "depth", F.col("owner").alias("conv_id"))
    paths = durable(paths.unionByName(owners.select(F.col("conv_id").alias("path"), long(0).alias("depth"), long(whole["first"]).alias("conv_id"))), "paths")
    ending = every.join(convs.select("conv_id", F.col("turns").alias("depth")), KEY, "left_semi").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    silent = convs.where("turns = 0").select(long(whole["first"]).alias("conv_id"), long(0).alias("depth"), F.col("conv_id").alias("member"))
    return nodes, paths, ending.unionByName(silent)


def subtree_sums(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each node the sum of values (n x k) over its subtree, by centroid decomposition of all components in step.

    parent: each node's parent or -1; a parent has a lesser depth.
    """
    n, out = len(parent), np.zeros_like(values)
    up, live = parent.copy(), np.argsort(depth, kind="stable")
    while len(live):
        layers = [x[up[x] >= 0] for x in np.split(live, np.flatnonzero(np.diff(depth[live])) + 1)]  # without the components' tops
        size, top, below = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
        size[live] = 1
        for layer in reversed(layers):
            np.add.at(size, up[layer], size[layer])
        for layer in layers:
            top[layer] = top[up[layer]]
        # The centroid of a component has the least subtree with half of its nodes.
        half = live[2 * size[live] >= size[top[live]]]
        half = half[np.lexsort((size[half], top[half]))]
        centroids = half[np.flatnonzero(np.diff(top[half], prepend=-1))]
        below[centroids] = True
        for layer in layers:
            below[layer] |= below[up[layer]]
        total = np.zeros_like(values)
        under = live[below[live]]
        np.add.at(total, top[under], values[under])
        walk, sums = centroids, total[top[centroids]]
        while len(walk):  # from the centroids up to the tops
            out[walk] += sums
            on = up[walk] >= 0
            walk, sums = up[walk[on]], sums[on]
        gone = np.zeros(n + 1, bool)
        gone[centroids] = True
        live = live[~gone[live]]
        up[live[gone[up[live]]]] = -1
    return out


VALUES = ["n_leaves", "saved_tokens"]
SUMMED = "conv_id long, depth long, n_leaves long, saved_tokens long"


def _small_sums(rows: DataFrame) -> DataFrame:
    """Subtree sums within components: rows (top_id, top_depth, conv_id, depth, up_id, up_depth, n_leaves, saved_tokens); a component's rows meet in a task."""
    columns = ["top_id", "top_depth", *KEY, "up_id", "up_depth", *VALUES]

    def solved(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Of whole components."""
        index = {k: i for i, k in enumerate(zip(held["conv_id"].tolist(), held["depth"].tolist(), strict=True))}
        top = (held["conv_id"] == held["top_id"]) & (held["depth"] == held["top_depth"])
        parent = [-1 if t else index[k] for t, k in zip(top.tolist(), zip(held["up_id"].tolist(), held["up_depth"].tolist(), strict=True), strict=True)]
        sums = subtree_sums(np.array(parent, np.int64), held["depth"], np.stack([held[v] for v in VALUES], 1))
        return pa.RecordBatch.from_arrays([pa.array(held[c]) for c in KEY] + [pa.array(sums[:, k]) for k in range(len(VALUES))], names=[*KEY, *VALUES])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.empty(0, np.int64) for c in columns}
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            held = {c: np.concatenate([held[c], new[c]]) for c in columns}
            if len(held["depth"]) >= BATCH:
                last = (held["top_id"] != held["top_id"][-1]) | (held["top_depth"] != held["top_depth"][-1])
                whole = int(last.nonzero()[0][-1]) + 1 if last.any() else 0  # the last component may go on
                if whole:
                    yield solved({c: x[:whole] for c, x in held.items()})
                    held = {c: x[whole:] for c, x in held.items()}
        if len(held["depth"]):
            yield solved(held)

    rows = rows.select(*[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in columns])
    return rows.repartition("top_id", "top_depth").sortWithinPartitions("top_id", "top_depth", "depth", "conv_id").mapInArrow(job, SUMMED)


def rollup(nodes: DataFrame, paths: DataFrame, small: int = SMALL, step: int | None = None) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums over subtrees of nodes (conv_id, depth, up_id, up_depth, size, n_leaves, saved_tokens).

    paths: (path, depth, conv_id) of the nodes' paths, from the top. small: components have a size below it.
    """
    step = step or small
    up = F.struct("up_id", "up_depth")
    large = nodes.where(F.col("size") >= small)
    kids = large.where("up_id is not null").groupBy(up.alias("node")).agg(F.count(F.lit(1)).alias("kids"), F.max("size").alias("kid"))
    splits = large.withColumn("node", F.struct("conv_id", "depth")).join(kids.withColumn("node", F.col("node").cast("struct<conv_id: bigint, depth: bigint>")), "node", "left")
    splits = splits.where((F.coalesce("kids", F.lit(0)) != 1) | (F.floor(F.col("size") / small) != F.floor(F.col("kid") / small)))
    splits = durable(splits.select(*KEY).withColumn("split", F.lit(True)), "splits")
    if splits.isEmpty():
        top = nodes.where("up_id is null").select(F.col("conv_id").alias("top_id"), F.col("depth").alias("top_depth")).first()
        return _small_sums(nodes.withColumns({"top_id": F.lit(top and top["top_id"]), "top_depth": F.lit(top and top["top_depth"])}))
    node = F.struct("depth", "conv_id")
    at = running(paths.join(splits, KEY, "left"), "path", "depth", {"over": (F.max, F.when(F.col("split"), node)), "last": (F.max, node)}, before=True)
    # Whoever follows a split, or begins the path, is the top of a component, unless it is a split itself.
    is_top = F.col("split").isNull() & (F.col("last").isNull() | F.col("last").eqNullSafe(F.col("over")))
    told = running(durable(at.withColumn("first", F.when(is_top, node)).drop("last"), "seen"), "path", "depth", {"top": (F.max, F.col("first"))})
    own = told.where("path = conv_id").select(*KEY, "split", "over", "top")
    full = durable(nodes.join(own, KEY), "labelled")
    part = full.where("split is null")
    totals = part.where("over is not null").groupBy("over").agg(*[F.sum(v).alias(f"more_{v}") for v in VALUES])
    upper = full.where("split").join(totals.select(F.col("over.conv_id").alias("conv_id"), F.col("over.depth").alias("depth"), *[f"more_{v}" for v in VALUES]), KEY, "left")
    upper = upper.select(*KEY, F.col("over.conv_id").alias("up_id"), F.col("over.depth").alias("up_depth"), "size", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in VALUES])
    upper = durable(upper, "upper")
    owners = upper.select(F.col("conv_id").alias("path")).distinct()
    done = durable(rollup(upper, durable(paths.join(splits, KEY, "left_semi").join(owners, "path", "left_semi"), "paths"), small * step, step), "summed")
    # What a split sums up hangs on the node above it.
    hung = full.where("split").select(*KEY, "up_id", "up_depth").join(done, KEY).where("up_id is not null")
    hung = hung.groupBy(F.col("up_id").alias("conv_id"), F.col("up_depth").alias("depth")).agg(*[F.sum(v).alias(f"more_{v}") for v in VALUES])
    part = part.join(hung, KEY, "left").select(
        F.col("top.conv_id").alias("top_id"), F.col("top.depth").alias("top_depth"), *KEY, "up_id", "up_depth",
        *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in VALUES],
    )
    return done.unionByName(_small_sums(part))


ENDS = "conv_id long, depth long, ends_sha256 string"


def end_hashes(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): the hash of each node's members, ascending, joined by commas.

    Sorted ranges write stretches of IDS ids at most; a node's stretches then pass one hash in order, none of them kept.
    """

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in KEY])
            members = batch.column("member").to_pylist()
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            starts = [at for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(members)]) for at in range(a, b, IDS)]
            texts = [",".join(map(str, members[a:b])) for a, b in zip(starts, [*starts[1:], len(members)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in key), pa.array([members[a] for a in starts], pa.int64()), pa.array(texts, pa.string())], names=[*KEY, "member", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, made = None, None, []
        for batch in batches:
            for c, d, ids in zip(*(batch.column(x).to_pylist() for x in (*KEY, "ids")), strict=True):
                if (c, d) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    made.append((*now, digest.hexdigest()))
                now, digest = (c, d), hashlib.sha256(ids.encode())
            yield rows(made)
            made.clear()
        yield rows([(*now, digest.hexdigest())] if now else [])

    def rows(made: list[tuple]) -> pa.RecordBatch:
        c, d, h = zip(*made, strict=True) if made else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.string())], names=[*KEY, "ends_sha256"])

    order = [*KEY, "member"]
    ranged = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    some = ranged.mapInArrow(stretches, "conv_id long, depth long, member long, ids string")
    return some.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(hashes, ENDS)


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", small: int = SMALL) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node."""
    nodes, paths, ends = build(*rebuilt(conversations, conv_id, turn, role, text))
    summed = nodes.select(
        *KEY, F.col("parent_conv_id").alias("up_id"), F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("up_depth"), "size",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    found = nodes.join(rollup(summed, paths, small), KEY).join(end_hashes(ends), KEY, "left")
    return found.select(*KEY, "parent_conv_id", "n_convs", "n_children", *VALUES, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def oracle_sql() -> str:
    """The query of the conversations for DuckDB: every prefix of every conversation, and sums over all pairs of a node and one above it."""
    h = f"{crc32_sql('conv_id')} % {MOST}"
    return f"""
with said as (
  select row_number() over () as r, conv_id, turn, strlen(coalesce(text, '')) as bytes,
    sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as digest from conversations where conv_id is not null),
own as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, digest, r) - 1 as place, count(*) over (partition by conv_id) as n from said),
sizes as materialized (select conv_id, max(n) as n, {h} as h, conv_id - conv_id % {GROUP} as base from own group by conv_id),
convs as materialized (select s.*, least(s.h, coalesce(b.n, 0)) as got from sizes s left join sizes b on b.conv_id = s.base),
turns as (
  select c.conv_id, o.place + 1 as depth, o.digest, o.bytes from convs c join own o on o.conv_id = c.base where o.place < c.h
  union all select c.conv_id, c.got + o.place - c.h + 1, o.digest, o.bytes from convs c join own o on o.conv_id = c.conv_id where o.place >= c.h),
lists as (select conv_id, list(digest order by depth) as said, list(bytes order by depth) as bytes from turns group by conv_id),
whole as (select conv_id, coalesce(said, []) as said, coalesce(bytes, []) as bytes from convs left join lists using (conv_id)),
prefixes as materialized (
  select conv_id, d as depth, sha256(array_to_string(said[1:d], '')) as k, bytes[d] as bytes, d = len(said) as ends
  from (select *, unnest(range(0, len(said) + 1)) as d from whole)),
nodes as materialized (
  select min(conv_id) as conv_id, depth, k, count(*) as n_convs, coalesce(max(bytes), 0) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256 from prefixes group by depth, k),
ups as materialized (select n.conv_id, n.depth, p.k as up from nodes n join prefixes p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
kids as materialized (select up as k, depth - 1 as depth, count(*) as n from ups group by all),
facts as materialized (select n.*, coalesce(c.n, 0) as n_children from nodes n left join kids c using (k, depth)),
sums as (
  select p.k, p.depth, sum((n.n_children = 0)::int)::bigint as n_leaves, sum((n.n_convs - 1) * n.bytes)::bigint as saved_tokens
  from facts n join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth group by all)
select f.conv_id, f.depth, u.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
from facts f join sums s using (k, depth) left join ups on ups.conv_id = f.conv_id and ups.depth = f.depth left join nodes u on u.k = ups.up and u.depth = f.depth - 1"""
