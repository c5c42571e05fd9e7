"""A Merkle manifest of a dataset: an append log of tree nodes in postorder, and proofs addressed in it.

Every row is a leaf; rows of a group (a tree) ascend by their key, and while a tree has several nodes
left, every two consecutive ones become the hash of their hex digests, a last single one the hash of
its own. The trees' roots, in the order of their groups, are the leaves of one more tree, whose root
stands for the whole table.

The log is written by aligned builders. A builder reads 2 ** levels consecutive leaves, which make a subtree
of so many levels, and appends each node as it completes: a leaf, then every parent that it closes. So
a segment is its subtree in postorder, and a node's place in it follows from sizes alone: before leaf e
2 e - popcount(e) nodes are complete, and the node of height h that leaf e closes comes h places after
it; of n leaves the nodes that are short on the right come last, from the lowest. Roots of segments
are the leaves of the next band of builders, until each tree has one. A proof reads the siblings of a
leaf from its builder's segment and from those above it, by that formula.

Rows are placed by sorted ranges and their heads, so a group may hold any share of the rows; a task
holds one segment at a time.

Rows: null values hash as `-`; null groups come first, as do null keys; rows of equal keys are ordered by
their leaves, and equal rows are interchangeable; very long texts are hashed where they are read; an
empty table gives no rows and no root (None); other columns are kept by `proofs` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandfold.durable import durable
from strandfold.llm.columns import crc32_sql
from strandfold.operators.places import placed

LEVELS = 7


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """The hash of values, each as its number of UTF-8 bytes, a colon and itself, or `-` if null."""

    def told(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(told, values)), 256)


def position(height: int, index: int, n: int) -> int:
    """Where the index-th node of a height stands in the postorder log of n leaves."""
    end = (index + 1) << height
    if end <= n:  # a whole subtree is complete with its last leaf
        return 2 * (end - 1) - (end - 1).bit_count() + height
    whole = (n & -n).bit_length() - 1  # up to this height no node is short
    return 2 * n - n.bit_count() + height - whole - 1


def height(n: int) -> int:
    """Levels above n leaves."""
    return (n - 1).bit_length()


def postorder(leaves: list[str], top: int) -> list[str]:
    """The log of a subtree that is top levels high, node by node as they complete."""
    log, open_ = [], []
    for node in leaves:
        at = 0
        log.append(node)
        while open_ and open_[-1][0] == at:
            node, at = digest(open_.pop()[1] + node), at + 1
            log.append(node)
        open_.append((at, node))
    at, node = open_.pop()
    while at < top:  # short on the right
        node = digest((open_.pop()[1] if open_ and open_[-1][0] == at else "") + node)
        at += 1
        log.append(node)
    return log


def siblings(place: int, n: int, top: int) -> list[int | None]:
    """For each level, where the sibling of a leaf or of its ancestor stands in the log; None where it has none."""
    out = []
    for h in range(top):
        other = (place >> h) ^ 1
        out.append(position(h, other, n) if other << h < n else None)
    return out


def fold(node: str, place: int, n: int, proof: Iterator[str]) -> str:
    """The root that a leaf at a place of n leads to with the siblings of its proof."""
    for h in range(height(n)):
        index = place >> h
        if index & 1:
            node = digest(next(proof) + node)
        else:
            node = digest(node + next(proof) if (index + 1) << h < n else node)
    return node


def _block(place: str, levels: int) -> Column:
    return F.shiftright(place, levels).cast("long")


def _by_block(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", *order)


def _build(leaves: DataFrame, levels: int) -> DataFrame:
    """(tree, block, size, nodes, root): the segment of each block of (tree, place, size, hash)."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, made = None, [], []

        def close() -> None:
            tree, block, size = now
            log = postorder(held, min(height(size), levels))
            made.append((tree, block, size, bytes.fromhex("".join(log)), log[-1]))

        for batch in batches:
            tree, block, size, node = (batch.column(c).to_pylist() for c in ("tree", "block", "size", "hash"))
            for t, b, s, h in zip(tree, block, size, node, strict=True):
                if now is None or (t, b) != now[:2]:
                    if held:
                        close()
                    now, held = (t, b, s), []
                held.append(h)
            yield _rows(made, SEGMENT)
            made.clear()
        if held:
            close()
        yield _rows(made, SEGMENT)

    rows = leaves.withColumn("block", _block("place", levels)).select("tree", "block", "place", "size", "hash")
    return _by_block(rows, "place").mapInArrow(job, SEGMENT)


SEGMENT = T.StructType([
    T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("nodes", T.BinaryType()), T.StructField("root", T.StringType()),
])
PATH = T.StructType([T.StructField("tree", T.StringType()), T.StructField("place", T.LongType()), T.StructField("above", T.ArrayType(T.StringType()))])
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary(), T.ArrayType(T.StringType()): pa.list_(pa.string())}


def _rows(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[f.dataType]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def _segment(block: int, size: int, nodes: bytes, levels: int) -> tuple[list[str], int, int]:
    """A segment's digests, its number of leaves and its height."""
    log = nodes.hex()
    return [log[i : i + 64] for i in range(0, len(log), 64)], min(1 << levels, size - (block << levels)), min(height(size), levels)


class _Addresses(dict):
    """Addresses of siblings of every leaf of a segment, by its number of leaves and height."""

    def __missing__(self, key: tuple[int, int]) -> list[list[int]]:
        n, top = key
        self[key] = found = [[p for p in siblings(q, n, top) if p is not None] for q in range(n)]
        return found


def _bands(leaves: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The bands of segments over (tree, place, size, hash), and each tree's (tree, root)."""
    bands, rows, width = [], leaves, 1 << levels
    while True:
        bands.append(durable(_build(rows, levels), "segments"))
        more = bands[-1].where(F.col("size") > width)
        if more.isEmpty():
            break
        rows = more.select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / width).alias("size"), F.col("root").alias("hash"))
    roots = bands[0].where(F.col("size") <= width)
    for band in bands[1:]:
        roots = roots.unionByName(band.where(F.col("size") <= width))
    return bands, roots.select("tree", "root")


def _paths(bands: list[DataFrame], levels: int) -> DataFrame | None:
    """(tree, place, above): the siblings over each leaf of the lowest of these bands, upwards; None if there are no bands."""
    found = None

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        addresses = _Addresses()
        for batch in batches:
            for r in batch.to_pylist():
                log, n, top = _segment(r["block"], r["size"], r["nodes"], levels)
                first, above = r["block"] << levels, r["above"] or []
                yield _rows([(r["tree"], first + q, [*(log[p] for p in at), *above]) for q, at in enumerate(addresses[n, top])], PATH)

    for band in reversed(bands):
        found = durable(_with_above(band, found).select("tree", "block", "size", "nodes", "above").mapInArrow(job, PATH), "paths")
    return found


def _with_above(band: DataFrame, paths: DataFrame | None) -> DataFrame:
    if paths is None:
        return band.withColumn("above", F.lit(None).cast(PATH["above"].dataType))
    return band.join(paths.withColumnRenamed("place", "block"), ["tree", "block"], "left")


@dataclass
class Manifest:
    """leaves (own columns, tree, place, size, hash); bands of segments (tree, block, size, nodes, root); trees (tree, subroot, place, size, above); root."""

    leaves: DataFrame
    bands: list[DataFrame]
    trees: DataFrame
    root: str | None
    levels: int

    def proofs(self, asked: str | None = None) -> DataFrame:
        """The leaves' own columns with leaf, subroot, root, siblings (array, upwards through the subroot) and folded_root.

        folded_root: what the siblings make of the row's hash, or of the one in the column asked, where it has one.
        """
        levels = self.levels
        own = [c for c in self.leaves.columns if c not in ("tree", "place", "size", "hash", asked)]
        rows = self.leaves.select(*own, "tree", "place", "size", "hash", F.coalesce(*([asked] if asked else []), "hash").alias("start"))
        top = self.trees.select("tree", "subroot", F.col("place").alias("at"), F.col("size").alias("trees"), F.col("above").alias("over"))
        segments = _with_above(self.bands[0], _paths(self.bands[1:], levels)).join(top, "tree").drop("root", "size")
        both = rows.withColumn("block", _block("place", levels)).unionByName(segments.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
        text = T.StringType()
        extra = [("leaf", text), ("subroot", text), ("root", text), ("siblings", T.ArrayType(text)), ("folded_root", text)]
        schema = T.StructType([*(self.leaves.schema[c] for c in own), *(T.StructField(n, t) for n, t in extra)])
        root = self.root

        def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            addresses, log, head = _Addresses(), [], None
            for batch in batches:
                made: list[tuple] = []
                keep: list[int] = []
                columns = [batch.column(c) for c in ("place", "size", "hash", "start", "nodes")]
                for k, (place, size, node, start) in enumerate(zip(*(c.to_pylist() for c in columns[:4]), strict=True)):
                    if place < 0:  # the block's segment comes before its rows
                        head, log = {c: batch.column(c)[k].as_py() for c in ("block", "above", "subroot", "at", "trees", "over")}, columns[4][k].as_py()
                        continue
                    if isinstance(log, bytes):
                        log, n, high = _segment(head["block"], size, log, levels)
                        at = addresses[n, high]
                    proof = [*(log[p] for p in at[place & ((1 << levels) - 1)]), *(head["above"] or []), *(head["over"] or [])]
                    rest = iter(proof)
                    folded = fold(fold(start, place, size, rest), head["at"], head["trees"], rest)
                    keep.append(k)
                    made.append((node, head["subroot"], root, proof, folded))
                at_rows = pa.array(keep, pa.int64())
                new = zip(*made, strict=True) if made else [[]] * len(extra)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(at_rows) for c in own] + [pa.array(c, _ARROW[t]) for c, (_, t) in zip(new, extra, strict=True)], names=schema.names
                )

        return _by_block(both, "place").mapInArrow(job, schema)


def manifest(rows: DataFrame, group: Column, order: list[Column], hashed: Column, keep: dict[str, Column], levels: int = LEVELS) -> Manifest:
    """The manifest of rows: hashed is each one's leaf, group its tree, order that of leaves in a tree; keep names columns to carry."""
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # a null group is a tree of its own, the first
    columns = [c.alias(n) for n, c in keep.items()] + [c.alias(f"_order{k}") for k, c in enumerate(order)]
    leaves = durable(rows.select(*columns, tree.alias("tree"), hashed.alias("hash")), "leaves")
    by = [F.col(f"_order{k}").asc_nulls_first() for k in range(len(order))]
    leaves = durable(placed(leaves.withColumn("_tie", F.monotonically_increasing_id()), "tree", [*by, F.col("hash"), F.col("_tie")]).select(*keep, "tree", "place", "size", "hash"), "leaves")
    bands, roots = _bands(leaves, levels)
    top = placed(roots.withColumnsRenamed({"tree": "of", "root": "hash"}).withColumn("tree", F.lit("")), "tree", [F.col("of")])
    top = durable(top, "trees")
    high, root = _bands(top.select("tree", "place", "size", "hash"), levels)
    trees = top.join(_paths(high, levels).drop("tree"), "place").select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "place", "size", "above")
    found = root.first()
    return Manifest(leaves, bands, durable(trees, "trees"), found and found["root"], levels)


def oracle_sql() -> str:
    """The query of the documents by language for DuckDB: levels by recursion, proofs from whole trees."""
    told = lambda x: f"coalesce(strlen(({x})::varchar)::varchar || ':' || ({x})::varchar, '-')"
    hashed = lambda n: "sha256(" + " || ".join(map(told, ("doc_id", "source", "lang", n, "text"))) + ")"
    rise = "select tree, h + 1, i // 2, sha256(node || coalesce(after, '')) from (select *, lead(node) over (partition by tree order by i) as after, count(*) over (partition by tree) as n from {}) where i % 2 = 0 and n > 1"
    step = "case x[1] when 'l' then sha256(x[2:] || a) when 'r' then sha256(a || x[2:]) else sha256(a) end"

    def sides(at: str, nodes: str, own: str) -> str:
        sibling = f"case when s.node is null then '-' when s.i < l.place >> q.h then 'l' || s.node else 'r' || s.node end"
        return f"""select l.{own} as {own}, list({sibling} order by q.h) as side from {at} l
  join (select distinct tree, h from {nodes}) q on q.tree = l.tree join (select tree, max(h) as high from {nodes} group by tree) t on t.tree = l.tree and q.h < t.high
  left join {nodes} s on s.tree = l.tree and s.h = q.h and s.i = xor(l.place >> q.h, 1) group by l.{own}"""

    return f"""
with recursive docs as (
  select row_number() over () as r, doc_id, coalesce('=' || lang, '') as tree, {hashed('n_chars')} as leaf,
    case when {crc32_sql('doc_id')} % 7 = 0 and n_chars is not null then {hashed('n_chars::hugeint + 1')} end as tampered from documents),
leaves as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as place from docs),
nodes(tree, h, i, node) as (select tree, 0, place, leaf from leaves union all {rise.format('nodes')}),
roots as materialized (select tree, arg_max(node, h) as node from nodes group by tree),
places as materialized (select '' as tree, tree as own, node, row_number() over (order by tree) - 1 as place from roots),
high(tree, h, i, node) as (select tree, 0, place, node from places union all {rise.format('high')}),
inner_sides as materialized ({sides('leaves', 'nodes', 'r')}),
outer_sides as materialized ({sides('places', 'high', 'own')}),
proofs as (
  select l.*, r.node as subroot, (select arg_max(node, h) from high) as root, coalesce(i.side, []) || coalesce(o.side, []) as side
  from leaves l join roots r using (tree) left join inner_sides i using (r) left join outer_sides o on o.own = l.tree),
told as (
  select *, sha256(array_to_string(list_transform(list_filter(side, lambda x: x <> '-'), lambda x: x[2:]), '')) as proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), side), lambda a, x: {step}) as folded_root from proofs)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from told"""
