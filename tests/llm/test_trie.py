"""The prefix trie against a plain one, with odd rows among them."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.llm import trie
from strandfold.llm import queries as Q
from strandfold.operators import places

SF = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string, depth int, SIZE int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    """By the definition, of (conv_id, turn, role, text)."""
    said = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            said.setdefault(c, []).append(((t is not None, t or 0), sha(f"{len(r.encode())}:{r}{x}"), r, x))
    said = {c: [v[2:] for v in sorted(turns)] for c, turns in said.items()}
    paths = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(said.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids, under = {}, {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
        for d in range(len(node) + 1):
            under.setdefault(node[:d], []).append(node)
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(node))))
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in under[node] if u)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(kids.get(node, ())), sum(u not in kids for u in under[node]), saved, sha(ends)))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS).repartition(3)
    return sorted(tuple(r) for r in trie.prefix_trie(df, **more).collect())


def test_subtree_sums_by_centroids():
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 50, 400]:
        for reach in (1, 3, n):  # a path, long branches, a bush
            parent = np.array([-1 if v == 0 or rng.random() < 0.02 else rng.integers(max(0, v - reach), v) for v in range(n)])
            depth = np.zeros(n, int)
            for v in range(n):
                depth[v] = depth[parent[v]] + 1 if parent[v] >= 0 else rng.integers(3)
            values = rng.integers(0, 100, (n, 2))
            want = values.copy()
            for v in reversed(range(n)):
                if parent[v] >= 0:
                    want[parent[v]] += want[v]
            assert (trie.subtree_sums(parent, depth, values) == want).all()


def test_query_equals_plain_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in Q.op12_prefix_trie(spark, SF).collect()) == plain(rows)


def conversations(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(12)):
            rows.append((c, t, rng.choice(["user", "user", "system"]), rng.choice("ab") * (t % 3)))
    return rows


@pytest.mark.parametrize("small", [4, 4096])
def test_components_of_any_size(spark, small):
    rows = conversations(120)
    assert run(spark, rows, small=small) == plain(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, t, "user", "copy") for c in range(300, 340) for t in range(6)]  # copies
    rows += [(1000, t, "user", f"t{t % 5}") for t in range(150)]  # a long one
    rows += [(7, None, "system", "null turn first"), (7, 3, None, "x"), (7, 3, None, "x"), (7, 3, "user", None), (7, -1, None, None), (None, 0, "user", "nobody"), (-3, 0, "user", "é"), (-5, 0, "user", "ü"), (2**62, 0, "", "")]
    rows += [(c, 0, "user", "only one") for c in range(500, 520)]
    assert run(spark, rows, small=16) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(3, 0, "user", "base absent")], [(5, 0, "user", "x")]])
def test_few_rows(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_running_over_stretches(spark):
    rows = [(g, p, (g * 7 + p * 13) % 29) for g in range(3) for p in range(1, 30)]
    df = spark.createDataFrame(rows, "g long, p long, v long")
    for before in (False, True):
        found = places.running(df, "g", "p", {"m": (F.max, F.col("v")), "x": (F.bit_xor, F.col("v"))}, before, span=2).collect()
        assert len(found) == len(rows)
        for r in found:
            seen = [v for g, p, v in rows if g == r.g and (p < r.p or p == r.p and not before)]
            assert r.m == max(seen, default=None) and r.x == np.bitwise_xor.reduce(seen or [0])
