"""Literal cases and small models of the operators."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandfold.functions import kernels as K
from strandfold.functions import pixels
from strandfold.operators import align, candidates, coverage, filters, groups, policy, tokens, verify
from strandfold.operators.components import connected_components
from strandfold.params import Params
from strandfold.plans import decisions as plans

MATCH = "match_id long, a_id long, b_id long, kind string, a_sample_ranges array<struct<start: int, end: int>>, b_sample_ranges array<struct<start: int, end: int>>, a_duplicated_percent double, b_duplicated_percent double"
SAMPLE = "item_id long, pos int, ts double, dhash long, ahash long, mean int"
DECISION = "group_id long, keeper_ids array<long>, removal_order array<long>, method string"


def matches(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], MATCH)


def p(a, b, ra, rb):
    return (a, b, "perceptual", ra, rb, 0.0, 0.0)


def e(a, b):
    return (a, b, "exact", None, None, None, None)


def items(spark, n, counts=None, **more):
    rows = [(i, more.get("paths", {}).get(i, f"/r/f{i}.mp4"), more.get("sizes", {}).get(i, 1), 0, float(more.get("durations", {}).get(i, 10)), more.get("width", {}).get(i, 1), 1, (counts or {}).get(i, 10)) for i in range(n)]
    return spark.createDataFrame(rows, "item_id long, path string, size_bytes long, mtime_ns long, duration_seconds double, width long, height long, detailed_sample_count long")


def grouped(spark, items_, found):
    members, used = groups.duplicate_groups(items_, found)
    got = {}
    for r in members.collect():
        got.setdefault(r.group_id, set()).add(r.item_id)
    return [got[k] for k in sorted(got)], members, used


def test_clip_in_compilation(spark):
    clip = [(0, i, float(i), i, i, 100) for i in range(8)]
    both = [(1, i, float(i), i, i, 100) for i in range(8)] + [(1, 8 + i, 8.0 + i, 10000 + i, 10000 + i, 30) for i in range(8)]
    samples = spark.createDataFrame(clip + both, SAMPLE)
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    q = Params(interval=1.0, distance=0, min_segment=3.0)
    known = spark.createDataFrame([(0, 8.0), (1, 16.0)], "item_id long, duration_seconds double")
    counts = samples.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    for aligned in (align.align_pairs, align.align_best_offset):
        row = align.match_records(aligned(verify.matching_points(pairs, samples, 0), q), known, q, counts).first()
        assert (row.a_duplicated_percent, row.b_duplicated_percent, row.overlap_seconds) == (100.0, 50.0, 8.0)
        assert [(r.start, r.end) for r in row.b_sample_ranges] == [(0, 7)]


def test_flat_samples_do_not_match(spark):
    samples = spark.createDataFrame([(k, i, float(i), 0, -1, 16) for k in (0, 1) for i in range(12)], SAMPLE)
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    assert tokens.item_tokens(samples).isEmpty() and verify.sample_pairs(pairs, samples).isEmpty()


def test_filters(spark):
    known = items(spark, 3, durations={0: 9.999, 1: 10.0, 2: 20.0})
    kept, left = filters.short_items_out(known, matches(spark, e(0, 1), e(1, 2)), 10.0)
    assert [r.item_id for r in kept.collect()] == [1, 2] and [(r.a_id, r.b_id) for r in left.collect()] == [(1, 2)]
    found = matches(spark, (0, 1, "perceptual", [], [], 100.0, 12.5), (0, 2, "perceptual", [], [], 94.9, 94.9), e(1, 2))
    assert sorted(r.match_id for r in filters.min_duplicate_percent(found, 95.0).collect()) == [0, 2]
    with pytest.raises(ValueError):
        filters.min_duplicate_percent(found, 90.0, scanned_at=95.0)


@pytest.mark.parametrize(
    ("found", "expected"),
    [
        ([p(0, 1, [(0, 3)], [(0, 3)]), p(0, 2, [(10, 13)], [(0, 3)])], [{0, 1}, {0, 2}]),
        ([p(0, 1, [(0, 5)], [(0, 5)]), p(0, 2, [(4, 8)], [(0, 4)])], [{0, 1, 2}]),
        ([e(0, 1), p(0, 2, [(0, 3)], [(0, 3)]), p(1, 3, [(10, 13)], [(0, 3)])], [{0, 1, 2}, {0, 1, 3}]),
        ([p(0, 1, [(0, 3)], [(0, 3)]), p(0, 2, [(4, 7)], [(0, 3)])], [{0, 1}, {0, 2}]),
        ([p(0, 1, [(0, 3)], [(0, 3)]), p(0, 2, [], [(0, 3)])], [{0, 1, 2}]),
    ],
)
def test_clip_groups(spark, found, expected):
    assert grouped(spark, items(spark, 4), matches(spark, *found))[0] == expected


def test_candidate_cap(spark):
    t = spark.createDataFrame([(0, 10), (0, 20), (1, 10), (2, 20)], "item_id long, token int")
    got = candidates.cap_candidates(candidates.shared_token_counts(t), 1)
    assert sorted(map(tuple, got.collect())) == [(0, 1), (0, 2)]


def test_ranges(spark):
    bins = spark.createDataFrame([(0, b) for b in (2, 3, 4, 7, 8)], "item_id long, bin int")
    assert sorted((r.start, r.end) for r in coverage.compress_ranges(bins, ["item_id"]).collect()) == [(2, 4), (7, 8)]
    known = items(spark, 2, counts={0: 10, 1: 10}, durations={0: 30, 1: 30})
    found = coverage.duplicate_time_ranges(matches(spark, p(0, 1, [(2, 4), (7, 8)], [(0, 1)])), known, 3.0)
    assert sorted((r.start_seconds, r.end_seconds) for r in found.where("item_id = 0").collect()) == [(6.0, 15.0), (21.0, 27.0)]


def test_normalised_ranges_equal_normalised_bins(spark):
    rng = random.Random(4)
    rows = [(k, rng.randint(3, 12)) for k in range(120)]
    bins = {k: sorted(rng.sample(range(n), rng.randint(1, n))) for k, n in rows}
    flat = spark.createDataFrame([(k, b) for k, bs in bins.items() for b in bs], "k long, bin int")
    sizes = spark.createDataFrame(rows, "k long, n int")
    by_range = coverage.expand_ranges(coverage.normalize_coverage(coverage.compress_ranges(flat, ["k"]).join(sizes, "k"), ["k"]), ["k"])
    got = {}
    for r in by_range.collect():
        got.setdefault(r.k, set()).add(r.bin)
    arrays = spark.createDataFrame([(k, bins[k], n) for k, n in rows], "k long, bins array<int>, n int")
    also = {r.k: set(r.x) for r in arrays.select("k", coverage.normalize_array(F.col("bins"), F.col("n")).alias("x")).collect()}
    for k, n in rows:
        want = set(bins[k]) | {b + 1 for b in bins[k] if b + 2 in bins[k]}
        want |= {0} if min(bins[k]) <= 1 else set()
        want |= {n - 1} if max(bins[k]) >= n - 2 else set()
        assert got[k] == want == also[k]


def covered(spark, item, keepers, found, known):
    one = lambda ids: spark.createDataFrame([(0, i) for i in ids], "scope long, item_id long")
    r = coverage.covered_by(one([item]), one(keepers), found, known, 1.0).first()
    return r.covered_percent, r.sources


def test_coverage_reaches_over_copies(spark):
    assert covered(spark, 2, [1], matches(spark, e(0, 1), e(0, 2)), items(spark, 3)) == (100.0, [1])
    assert covered(spark, 0, [1, 2], matches(spark, p(0, 1, [(0, 3)], [(0, 3)]), p(0, 2, [(2, 5)], [(0, 3)])), items(spark, 3)) == (60.0, [1, 2])


def removed(spark, strategy, known, found, least=95.0):
    _, members, used = grouped(spark, known, found)
    got = policy.recommend_removals(members, used, found, known, strategy, 1.0, least, ["/r"]).orderBy("place").collect()
    return [r.item_id for r in got]


def test_strategies(spark):
    two = matches(spark, e(0, 1))
    assert removed(spark, "delete-shallower", items(spark, 2, paths={0: "/r/a.mp4", 1: "/r/x/a.mp4"}), two) == [0]
    assert removed(spark, "delete-shorter-name", items(spark, 2, paths={0: "/r/a.mp4", 1: "/r/descriptive-name.mp4"}), two) == [0]
    assert removed(spark, "delete-numbered-name", items(spark, 2, paths={0: "/r/clip2.mp4", 1: "/r/descriptive-name.mp4"}), two) == [0]
    assert removed(spark, "delete-fully-covered", items(spark, 2), matches(spark, p(0, 1, [(0, 9)], [(0, 4)]))) == [0]
    three = matches(spark, e(0, 1), e(0, 2))
    assert removed(spark, "delete-fully-covered", items(spark, 3, sizes={0: 1, 1: 2, 2: 3}), three) == [0, 1]


@pytest.mark.parametrize(("percent", "least", "parts"), [(100, 95.0, {1, 2}), (95, 95.0, {1, 2}), (94, 90.0, {1, 2}), (94, 95.0, set())])
def test_parts_before_compilation(spark, percent, least, parts):
    known = items(spark, 3, counts={0: 200, 1: 100, 2: 100}, durations={0: 200, 1: 100, 2: 100}, width={0: 640, 1: 1920, 2: 1920})
    found = matches(spark, p(0, 1, [(0, 99)], [(0, percent - 1)]), p(0, 2, [(100, 199)], [(0, percent - 1)]), p(1, 2, [], [(0, 0)]))
    found = found.where("match_id < 2")
    members = spark.createDataFrame([(1, i) for i in range(3)], "group_id long, item_id long")
    used = spark.createDataFrame([(1, 0), (1, 1)], "group_id long, match_id long")
    got = policy.recommend_removals(members, used, found, known, "delete-fully-covered", 1.0, least)
    assert {r.item_id for r in got.collect()} - {0} == parts


def decisions(spark, *rows):
    return spark.createDataFrame([(g, k, r, "manual") for g, k, r in rows], DECISION)


def test_actions_use_keepers_of_all_sets(spark):
    found = matches(spark, p(0, 1, [(0, 3)], [(0, 3)]), p(0, 2, [(4, 7)], [(0, 3)]))
    known = items(spark, 3, counts={0: 8, 1: 4, 2: 4})
    got = plans.build_actions(decisions(spark, (1, [1], [0]), (2, [2], [0])), found, known, 1.0, 95.0).collect()
    assert [(r.item_id, r.covered_percent, r.sources) for r in got] == [(0, 100.0, [1, 2])]
    star = matches(spark, e(0, 1), e(0, 2))
    got = plans.build_actions(decisions(spark, (1, [1], [0]), (2, [0], [2])), star, items(spark, 3), 1.0, 95.0).collect()
    assert [r.item_id for r in got] == [2]
    assert plans.build_actions(decisions(spark, (1, [], [0])), star, items(spark, 3), 1.0, 0.0).isEmpty()


def overlapping(spark):
    found = matches(spark, e(0, 1), e(4, 5), p(0, 2, [(0, 3)], [(0, 3)]), p(1, 2, [(0, 3)], [(0, 3)]), p(0, 3, [(4, 7)], [(0, 3)]), p(1, 3, [(4, 7)], [(0, 3)]))
    return items(spark, 6, counts={0: 8, 1: 8, 2: 4, 3: 4}), found


def test_review_cycle(spark):
    known, found = overlapping(spark)
    sets, members, _ = grouped(spark, known, found)
    assert sets == [{0, 1, 2}, {0, 1, 3}, {4, 5}]
    one = decisions(spark, (1, [1, 2], [0]))
    full = plans.default_decisions(members, one)
    assert [r.item_id for r in plans.build_actions(full, found, known, 1.0, 95.0).collect()] == [0]
    assert {r.group_id: r.keeper_ids for r in full.collect()}[2] == [1, 3]
    veto = decisions(spark, (1, [1, 2], [0]), (2, [0, 3], [1]))
    assert plans.build_actions(plans.default_decisions(members, veto), found, known, 1.0, 95.0).isEmpty()
    done = spark.createDataFrame([(0,)], "item_id long")
    two = one.unionByName(decisions(spark, (3, [4], [5]), (2, [0, 3], [1])))
    _, _, after, _, carried = plans.retire_resolved(known, found, members, two, done)
    assert sorted((r.group_id, r.keeper_ids, r.removal_order) for r in carried.collect()) == [(1, [3], [1]), (2, [4], [5])]
    got = {}
    for r in after.collect():
        got.setdefault(r.group_id, set()).add(r.item_id)
    assert [got[k] for k in sorted(got)] == [{1, 3}, {4, 5}]


def test_strict_plan_needs_unchanged_sources(spark):
    known = items(spark, 3)
    actions = spark.createDataFrame([(0, [1, 2])], "item_id long, sources array<long>")
    now = known.withColumn("size_bytes", F.when(F.col("item_id") == 2, 99).otherwise(F.col("size_bytes")))
    asked = decisions(spark, (1, [1, 2], [0]))
    assert plans.validate_plan(actions, asked, known, now).first().status == "ready"
    assert plans.validate_plan(actions, asked, known, now, strict=True).first().status == "refused"


def test_linked_groups_and_shared_choices(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 12), (3, 13), (4, 20), (4, 21)], "group_id long, item_id long")
    from_ = lambda g: sorted(r.group_id for r in groups.linked_groups(members, spark.createDataFrame([(g,)], "group_id long")).collect())
    assert from_(1) == [1, 2, 3] and from_(4) == [4]
    log = spark.createDataFrame([(1, 1, 11, True), (2, 1, 10, False)], "seq long, group_id long, item_id long, keep boolean")
    choices = plans.sync_shared_choices(members, log)
    assert {r.group_id for r in choices.collect()} == {1}
    assert [r.item_id for r in plans.removal_files(choices).collect()] == [10]
    assert plans.removal_files(plans.sync_shared_choices(members, log, until=1)).isEmpty()


def frames(seed, n):
    return np.random.default_rng(seed).integers(0, 256, (n, pixels.HEIGHT, pixels.WIDTH), dtype=np.uint8)


def frame_table(spark, *sets):
    rows = [(k, i, float(i), bytearray(f.tobytes())) for k, fs in enumerate(sets) for i, f in enumerate(fs)]
    return pixels.frame_samples(spark.createDataFrame(rows, "item_id long, pos int, ts double, pixels binary")).withColumn("mean", F.col("mean").cast("int"))


def test_moving_occlusions_still_match(spark):
    base = frames(71, 12)
    covered_ = base.copy()
    for i in range(12):
        for t in (i % 9, (i + 4) % 9):
            covered_[i, t // 3 * 8 : t // 3 * 8 + 8, t % 3 * 9 : t % 3 * 9 + 9] = 255
    samples = frame_table(spark, base, covered_).persist()
    pairs = spark.createDataFrame([(0, 1)], "a long, b long")
    q = Params(interval=1.0)
    points = verify.matching_points(pairs, samples, q.distance)
    row = align.match_records(align.align_pairs(points, q), items(spark, 2, durations={0: 12, 1: 12}), q, samples.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))).first()
    assert (row.a_duplicated_percent, row.b_duplicated_percent) == (100.0, 100.0)
    assert verify.matching_points(pairs, samples, 0).isEmpty()


def test_shared_tile_alone_does_not_match(spark):
    a, b = frames(99, 2)[:1], frames(99, 2)[1:]
    b = b.copy()
    b[0, :8, :9] = a[0, :8, :9]
    points = verify.sample_pairs(spark.createDataFrame([(0, 1)], "a long, b long"), frame_table(spark, a, b))
    assert all(r.distance > 20 for r in points.collect())


def aligned_model(points, least, most=20):
    """The matcher as its definition has it, on one pair's points {(i, j): distance}."""
    votes = collections.Counter(j - i for i, j in points)
    left, right, taken = set(), set(), []
    for shift in sorted(votes, key=lambda k: (-votes[k], -k))[:most]:
        best = {}
        for (i, j), d in points.items():
            if abs(j - i - shift) <= 1 and i not in left and j not in right:
                best[i] = min(best.get(i, (9, 0, 0)), (abs(j - i - shift), d, j))
        runs, at = [], sorted(best)
        for k, i in enumerate(at):
            runs = [*runs[:-1], [*runs[-1], i]] if k and i - at[k - 1] <= 2 else [*runs, [i]]
        for run in runs:
            rising = [i for k, i in enumerate(run) if all(best[h][2] < best[i][2] for h in run[:k])]
            if len(run) >= least and run[-1] - run[0] + 1 >= least and len(rising) >= least:
                taken += [(i, best[i][2], best[i][1]) for i in rising]
                left |= set(rising)
                right |= {best[i][2] for i in rising}
    return sorted(taken)


def test_alignment_equals_model(spark):
    rng = random.Random(5)
    pairs = {}
    for a in range(120):
        points = {(i, j): rng.randint(0, 20) for i in range(12) for j in range(12) if rng.random() < 0.25}
        order = rng.sample(range(3), 3)  # three parts in another order on the other side
        points |= {(20 + 6 * k + x, 20 + 6 * order[k] + x): rng.randint(0, 5) for k in range(3) for x in range(6) if rng.random() < 0.9}
        pairs[a] = points
    rows = [(a, a + 1000, i, j, d) for a, points in pairs.items() for (i, j), d in points.items()]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "a long, b long, i int, j int, distance int")
    got = collections.defaultdict(list)
    for r in align.align_pairs(table, Params(interval=1.0, min_segment=3.0)).collect():
        got[r.a].append((r.i, r.j, r.distance))
    assert {a: sorted(got[a]) for a in pairs} == {a: aligned_model(points, 3) for a, points in pairs.items()}
    assert any(len({j - i for i, j, _ in x}) >= 3 for x in got.values())
    assert align.align_pairs(table.limit(0), Params()).count() == 0


def test_thousands_of_exact_copies(spark):
    n = 3000
    ids = [10_000_000 + k for k in range(n)]
    table = spark.createDataFrame([(i, "same", 5) for i in ids], "item_id long, sha256 string, size_bytes long")
    star = spark.createDataFrame([(ids[0], i) for i in ids[1:]], "a_id long, b_id long")
    found = star.select("a_id", "b_id", F.lit("exact").alias("kind"))
    classes = coverage.exact_classes(table, found)
    scope = table.select(F.lit(0).alias("scope"), "item_id")
    got = {r.item_id: (r.source, r.n_sources) for r in coverage.exact_sources(scope, scope, classes).collect()}
    assert got == {i: (ids[0] if i != ids[0] else ids[-1], n - 1) for i in ids}
    few = coverage.exact_sources(scope, scope.where(F.col("item_id") == ids[7]), classes).collect()
    assert len(few) == n - 1 and {r.source for r in few} == {ids[7]}


def test_report_and_plan_come_back(spark, tmp_path):
    from strandfold.sources import reports

    rows = spark.createDataFrame([(k, f"/a/{k}", 10 * k, k, 1.5, 3, 4, "c", None) for k in range(50)], reports.PARTS["files"]).repartition(5)
    found = spark.createDataFrame([(k, k, k + 1, "perceptual", 1.0, float(k), 2.0, 0.5, [(0, k)], None) for k in range(40)], reports.PARTS["matches"])
    for _ in range(2):  # written anew, not added to
        reports.write_report(f"{tmp_path}/r", rows, found, {"interval": "1.0"})
    files, matches, settings = reports.load_report(spark, f"{tmp_path}/r")
    assert sorted(files.collect()) == sorted(rows.collect()) and settings == {"interval": "1.0"}
    assert [(r.match_id, [tuple(x) for x in r.a_sample_ranges], r.b_sample_ranges) for r in matches.orderBy("match_id").collect()] == [(k, [(0, k)], []) for k in range(40)]
    assert [r.match_id for r in matches.collect()] == list(range(39, 2, -1)) + [0, 1, 2]  # by the greater percent, then by ids
    summary = spark.createDataFrame([(50, 40)], "scanned long, duplicate_pairs long")
    failures = spark.createDataFrame([("/a/x", "no samples", True)], reports.PARTS["failures"])
    reports.write_report(f"{tmp_path}/r", rows, found, {"interval": "1.0"}, summary, failures)
    parts = reports.report_parts(spark, f"{tmp_path}/r")
    assert sorted(map(tuple, parts["summary"].collect())) == [("duplicate_pairs", 40.0), ("scanned", 50.0)] and parts["failures"].collect() == failures.collect()
    decided = spark.createDataFrame([(1, [3], [5, 4], "m"), (2, [6], [], "m")], "group_id long, keeper_ids array<long>, removal_order array<long>, method string")
    actions = spark.createDataFrame([(5, 99.0, [3], 1)], "item_id long, covered_percent double, sources array<long>, n_sources long")
    reports.write_plan(f"{tmp_path}/p", decided, actions, rows)
    by_path, planned = reports.load_plan(spark, f"{tmp_path}/p")
    assert sorted((r.group_id, r.keeper_paths, r.removal_paths) for r in by_path.collect()) == [(1, ["/a/3"], ["/a/5", "/a/4"]), (2, ["/a/6"], [])]
    assert [(r.item_id, r.path, r.size_bytes, r.sources) for r in planned.collect()] == [(5, "/a/5", 50, [3])]


def test_components_equal_union_find(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(500 + i, 501 + i) for i in range(60)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: top(x) for e_ in edges for x in e_}


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("/a/b/c1.mp4", "1.5"), ("/z/clip.mp4", "nan"), ("/a/x", "x")], "path string, t string")
    got = df.select(K.relative_folder_depth(F.col("path"), F.array(F.lit("/a"), F.lit("/a/b/"))).alias("d"), K.mixed_alphanumeric_name(F.col("path")).alias("m"), K.safe_float(F.col("t")).alias("f")).collect()
    assert [(r.d, r.m, r.f) for r in got] == [(0, True, 1.5), (1, False, 0.0), (0, False, 0.0)]


def test_stale_snapshot_is_refused(spark):
    from strandfold.sources import stores

    decided = spark.createDataFrame([(1, [2], [3], "m")], DECISION)
    known, found = items(spark, 4), matches(spark, p(2, 3, [(0, 3)], [(0, 3)]))
    state = stores.state_of(known, found, min_coverage=95.0)
    saved = stores.save_snapshot(decided, "r", "s", state)
    assert stores.state_of(known.repartition(3), found, min_coverage=95.0) == state
    assert [tuple(r) for r in stores.snapshot(saved, "r", "s", state).collect()] == [(1, [2], [3], "m")]
    for other in (stores.state_of(known.where("item_id <> 0"), found, min_coverage=95.0), stores.state_of(known, found, min_coverage=90.0)):
        with pytest.raises(ValueError):
            stores.snapshot(saved, "r", "s", other)


def test_stream_replaces_items_that_come_again(spark, tmp_path):
    from strandfold.sources import adapters
    from strandfold.streaming import incremental

    lines = lambda k, seed: ". ".join(f"word{random.Random(f'{seed}-{i}').randint(0, 10**9)} some line number {seed} {i} of text" for i in range(k))
    parts = [[(1, lines(8, "x")), (2, lines(8, "y"))], [(3, lines(8, "x"))], [(1, lines(8, "z")), (4, lines(8, "y"))]]
    q = Params(interval=1.0, min_segment=3.0)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for part in parts:
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.stream_match_new(spark, stream, adapters.document_samples, f"{tmp_path}/store", f"{tmp_path}/checkpoint", q).awaitTermination()
    now = incremental.current(spark, f"{tmp_path}/store", "samples")
    want = adapters.document_samples(spark.createDataFrame([(1, lines(8, "z")), (2, lines(8, "y")), (3, lines(8, "x")), (4, lines(8, "y"))], "doc_id long, text string"))
    assert sorted(now.select(*want.columns).collect()) == sorted(want.collect())
    got = {(r.a, r.b) for r in incremental.current_matches(spark, f"{tmp_path}/store").collect()}
    assert (2, 4) in got and (1, 3) not in got
    assert {(r.a, r.b) for r in incremental.full_refresh(now, q).collect()} == got


def test_list_files_by_depth(spark, tmp_path):
    from strandfold.sources import discovery

    for name in ("a.mp4", "one/b.MP4", "one/two/c.mp4", "one/d.txt"):
        f = tmp_path / "root" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * 7)
    listed = discovery.list_files(spark, [f"{tmp_path}/root"])
    found = lambda depth: sorted(r.path.split("/root/")[1] for r in discovery.discover_items(listed, [f"{tmp_path}/root"], depth, ("mp4",)).collect())
    assert found(0) == ["a.mp4"] and found(1) == ["a.mp4", "one/b.MP4"] and found(-1) == ["a.mp4", "one/b.MP4", "one/two/c.mp4"]
