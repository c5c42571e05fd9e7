"""Sets without arrays, the interval sweep and the removal walk in rounds, against plain models."""

import collections
import random

import pytest
from pyspark.sql import functions as F
from test_operators import e, items, matches, p

from strandfold.operators import groups, places, policy


def plain_groups(sets):
    """Numbers of distinct sets by least item, size and items, and each source's number."""
    order = sorted({tuple(sorted(s)) for s in sets.values()}, key=lambda s: (s[0], len(s), s))
    return {k: order.index(tuple(sorted(s))) + 1 for k, s in sets.items()}


def found_groups(spark, sets):
    rows = [(k, i) for k, s in sets.items() for i in s]
    members = spark.createDataFrame(rows, "source long, item_id long")
    same = groups.same_sets(members)
    ids = groups.numbered_sets(members, same.where("source = head").select(F.col("head").alias("set"), "least", "n"))
    return {r.source: r.group_id for r in same.join(ids.select(F.col("set").alias("head"), "group_id"), "head").collect()}


def test_sets_are_told_and_numbered_without_arrays(spark):
    rng = random.Random(1)
    sets = {k: frozenset(rng.sample(range(12), rng.randrange(1, 7))) for k in range(150)}
    sets |= {500 + k: frozenset({0, 100 + rng.randrange(40)}) for k in range(60)}  # many that agree in least item and size
    assert found_groups(spark, sets) == plain_groups(sets)


def test_sets_of_a_hundred_thousand(spark):
    n = 100_000
    base = spark.range(n).select(F.col("id").alias("item_id"))
    other = base.where(F.col("item_id") != n - 1).unionByName(spark.range(n, n + 1).select(F.col("id").alias("item_id")))
    members = base.select(F.lit(5).cast("long").alias("source"), "item_id")
    for k, rows in ((9, base), (3, other), (4, other), (1, base.where("item_id < 3"))):
        members = members.unionByName(rows.select(F.lit(k).cast("long").alias("source"), "item_id"))
    same = groups.same_sets(members)
    assert {r.source: (r.head, r.n) for r in same.collect()} == {5: (5, n), 9: (5, n), 3: (3, n), 4: (3, n), 1: (1, 3)}
    ids = groups.numbered_sets(members, same.where("source = head").select(F.col("head").alias("set"), "least", "n"))
    assert {r.set: r.group_id for r in ids.collect()} == {1: 1, 5: 2, 3: 3}


def test_unlike_sets_of_one_digest_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(groups.F, "xxhash64", lambda k, item: F.lit(7).cast("long"))
    sets = {1: {1, 2, 3}, 2: {1, 2, 4}, 3: {1, 2, 3}}
    assert found_groups(spark, sets) == plain_groups(sets)


@pytest.mark.parametrize("span", [2, 12])
def test_islands_equal_brute_force(spark, span):
    rng = random.Random(3)
    rows, match = [], 0
    for c in range(30):
        for _ in range(rng.randrange(1, 25)):
            a = rng.randrange(80)
            rows.append((c, match, *((None, None) if rng.random() < 0.01 else (a, a + rng.randrange(4)))))
            match += 1
    rows += [(99, match + k, 10 * k, 10 * k + (12 if k % 7 else 3)) for k in range(3000)]  # long chains
    edges = groups.island_edges(spark.createDataFrame(rows, "class_id long, match_id long, start int, end int"), span).collect()
    got = {r.a: r.b for r in edges}
    by_class = collections.defaultdict(list)
    for c, m, a, b in rows:
        by_class[c].append((m, a, b))
    for spans in by_class.values():
        spans.sort(key=lambda s: (s[1] is not None, s[1], s[2], s[0]))
        wild, reach, first = any(a is None for _, a, _ in spans), None, None
        for m, a, b in spans:
            if first is None or not wild and (reach is None or a > reach):
                first = m
            reach = b if reach is None else max(reach, b or 0)
            assert got[m] == first
    assert len(edges) == len(rows)


def test_a_large_class_is_swept_by_many_tasks(spark):
    n = 300_000
    spans = spark.range(n).select(F.lit(1).alias("class_id"), F.col("id").alias("match_id"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + F.when(F.col("id") % 1000 == 999, 1).otherwise(3)).cast("int").alias("end"))
    edges = groups.island_edges(spans)
    assert edges.groupBy("b").count().agg(F.count(F.lit(1)), F.min("count"), F.max("count")).first() == (n // 1000, 1000, 1000)
    cut = places.placed(spans, "class_id", [F.col("start")])
    assert cut.agg(F.min("place"), F.max("place"), F.countDistinct("place"), F.min("size")).first() == (0, n - 1, n, n)


def walk(order, classes, n, bins, least):
    """One group's removals, one after the other."""
    kept, gone = set(order), []
    for item in order:
        if len(kept) <= 1:
            break
        covered = 100.0
        if sum(classes[k] == classes[item] for k in kept) < 2:
            seen = {b for other, b in bins.get(item, ()) if other in kept and other != item}
            covered = min(100.0, 100.0 * len(seen) / n[item])
        if covered + 1e-9 >= least:
            kept.discard(item)
            gone.append(item)
    return gone


@pytest.mark.parametrize(("seed", "least"), [(1, 95.0), (2, 50.0), (3, 100.0), (4, 0.0)])
def test_removals_in_rounds_equal_the_walk(spark, seed, least):
    rng = random.Random(seed)
    n_items, size = 60, 6
    pairs = [e(a, a + 1) for a in range(0, n_items - 1) if rng.random() < 0.15]
    for _ in range(260):
        a, b = rng.sample(range(n_items), 2)
        spans = [sorted(rng.sample(range(size), 2)) for _ in range(2)]
        pairs.append(p(a, b, [tuple(spans[0])], [tuple(spans[1])]))
    known = items(spark, n_items, counts=dict.fromkeys(range(n_items), size), sizes={i: rng.randrange(9) for i in range(n_items)})
    found = matches(spark, *pairs)
    teams = {g: sorted(rng.sample(range(n_items), rng.randrange(2, 30))) for g in range(1, 9)}
    used = {(g, k) for g in teams for k in range(len(pairs)) if rng.random() < 0.8}
    members = spark.createDataFrame([(g, i) for g, team in teams.items() for i in team], "group_id long, item_id long")
    order = policy.removal_priority(members, None, found, known, "delete-shallower", 1.0, least, ["/r"]).collect()
    class_of = list(range(n_items))
    for a, b, kind, *_ in pairs:
        if kind == "exact":
            class_of = [class_of[a] if c == class_of[b] else c for c in class_of]
    got = policy.recommend_removals(members, spark.createDataFrame(sorted(used), "group_id long, match_id long"), found, known, "delete-shallower", 1.0, least, ["/r"]).collect()
    for g, team in teams.items():
        bins = collections.defaultdict(set)
        for k, (a, b, kind, ra, rb, *_) in enumerate(pairs):
            if kind == "perceptual" and (g, k) in used:
                bins[a] |= {(b, x) for s, t in ra for x in range(s, t + 1)}
                bins[b] |= {(a, x) for s, t in rb for x in range(s, t + 1)}
        tried = [r.item_id for r in sorted((r for r in order if r.group_id == g), key=lambda r: r.place)]
        assert sorted(tried) == team
        want = walk(tried, class_of, dict.fromkeys(team, size), bins, least)
        assert [r.item_id for r in sorted((r for r in got if r.group_id == g), key=lambda r: r.place)] == want
    assert got


def test_removals_of_thousands_of_copies_and_a_chain(spark):
    n = 4000
    known = items(spark, n, counts={n - 1: 10})
    found = matches(spark, *[e(0, k) for k in range(1, n - 40)], *[p(k, k + 1, [(0, 9)], [(0, 9)]) for k in range(n - 40, n - 1)])
    members = spark.createDataFrame([(1, i) for i in range(n)], "group_id long, item_id long")
    used = found.select(F.lit(1).cast("long").alias("group_id"), "match_id")
    got = [r.item_id for r in policy.recommend_removals(members, used, found, known, "delete-shallower", 1.0, 95.0, ["/r"]).collect()]
    left = set(range(n)) - set(got)
    assert len(got) == len(set(got)) and len(left & set(range(n - 40))) == 1 and n - 1 in left
