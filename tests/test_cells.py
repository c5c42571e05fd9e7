"""Pairs of items in cells against the joins by token."""

import dataclasses
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandfold import queries
from strandfold.functions import simhash
from strandfold.operators import align, candidates, cells, tokens, verify
from strandfold.operators.tokens import drop_frequent
from strandfold.params import DOCUMENTS as P
from strandfold.streaming import incremental


def _samples(spark, n=12, length=40):
    """Items that share lines, some of them many times over, and lines with a few bits changed."""
    told = random.Random(5)
    lines = [(told.getrandbits(64) - 2**63, told.getrandbits(64) - 2**63, told.randrange(256)) for _ in range(60)]
    rows = []
    for item in range(n):
        for pos in range(length):
            d, a, m = lines[(pos + 3 * item) % 60 if pos % 4 else item % 3]
            rows.append((item, pos, float(pos), d ^ (told.randrange(8) if pos % 5 == 0 else 0), a, m))
    rows += [(99, 0, 0.0, 0, 0, 1)]  # flat
    return spark.createDataFrame(rows, "item_id long, pos int, ts double, dhash long, ahash long, mean smallint")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_alignment_in_cells_equals_joins(spark):
    samples = _samples(spark)
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(a + 1, 12)] + [(3, 99), (4, 1000)], "a long, b long")
    joined = align.align_pairs(verify.matching_points(pairs, samples, P.distance), P)
    got = _rows(align.align_samples(pairs, samples, P))
    assert got == _rows(joined) and len({r[:2] for r in got}) > 20


def test_verification_in_cells_equals_joins(spark):
    samples = _samples(spark, n=8)
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)] + [(3, 99)], "a long, b long")
    items = spark.createDataFrame([(k, 40.0) for k in [*range(8), 99]], "item_id long, duration_seconds double")
    support = verify.bucket_support(verify.within(verify.sample_pairs(pairs, samples), P.distance))
    wanted = _rows(support.where("least(n_left, n_right) >= 2").select("a", "b").distinct())
    assert _rows(verify.verify_candidates(pairs, samples, items, P)) == wanted and wanted


def test_pairs_sharing_tokens_in_cells(spark):
    told = random.Random(7)
    tokens = spark.createDataFrame([(item * 7 - 20, t) for item in range(60) for t in told.sample(range(50), told.randrange(9))], "item_id long, token int")
    for least in (1, 2, 3):
        wanted = candidates.min_shared(candidates.shared_token_counts(tokens), least)
        assert _rows(candidates.pairs_sharing(tokens, least)) == _rows(wanted)
    assert candidates.pairs_sharing(tokens.where("false"), 2).isEmpty()


def test_cells_of_blocks():
    import numpy as np

    assert list(cells.spans(np.array([5, 1, 1, 9, 2]), 4)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    assert cells.ragged(np.array([7, 2, 4]), np.array([2, 0, 3])).tolist() == [7, 8, 4, 5, 6]


def test_tokens_are_shuffled_by_item_only(spark):
    from strandfold.operators import tokens

    chosen = tokens.selected_tokens(tokens.item_tokens(_samples(spark)), 20)
    assert chosen.groupBy("item_id").count().where("count > 20").isEmpty()
    # of the samples, and of the hashes that both windows need; three with other keys before
    assert spark._jvm.PythonSQLUtils.explainString(chosen._jdf.queryExecution(), "simple").count("Exchange hashpartitioning(item_id") == 2


def test_cells_keep_the_best_of_either_end_only(spark):
    told = random.Random(7)
    tokens = spark.createDataFrame([(k, t) for k in range(60) for t in told.sample(range(40), 12)], "item_id long, token int").cache()
    every = candidates.pairs_sharing(tokens, 2)
    best = candidates.pairs_sharing(tokens, 2, 3)
    assert best.count() <= 60 * 3 * cells.blocks(spark, 0) < 2 * every.count()
    assert _rows(candidates.best_pairs(tokens, 2, 3)) == _rows(candidates.cap_candidates(every, 3))
    lists = tokens.groupBy("item_id").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    for most in (0, 15, 18, 60):
        wanted = candidates.cap_candidates(candidates.shared_token_counts(drop_frequent(tokens, most)).where("score >= 2"), 3)
        assert _rows(candidates.best_of_lists(lists, most, 2, 3)) == _rows(wanted)


def test_actions_are_made_once(spark, tmp_path):
    """What a plan's actions are read from is written, and not made anew by each reader."""
    s = queries.Stage(spark, str(tmp_path))
    s.made = {
        "decided": spark.createDataFrame([(1, [1], [2])], "group_id long, keeper_ids array<long>, removal_order array<long>"),
        "matches": spark.createDataFrame([(1, 1, 2, "exact", 100.0, 100.0, [], [])], "match_id long, a_id long, b_id long, kind string, a_duplicated_percent double, b_duplicated_percent double, a_sample_ranges array<struct<start: int, end: int>>, b_sample_ranges array<struct<start: int, end: int>>"),
        "items": spark.createDataFrame([(1, 9.0, 9), (2, 9.0, 9)], "item_id long, duration_seconds double, detailed_sample_count long"),
        "classes": spark.createDataFrame([(1, 1), (2, 1)], "item_id long, class_id long"),
    }
    assert [(r.item_id, r.sources) for r in s.actions.collect()] == [(2, [1])] and s.actions.inputFiles()


def test_selected_lists_equal_selected_tokens(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # items go on in the next batch
    try:
        for limit in (20, 33, 1000):
            lists = tokens.selected_lists(_samples(spark), limit)
            wanted = _rows(tokens.selected_tokens(tokens.item_tokens(_samples(spark)), limit))
            got = sorted((r.item_id, t) for r in lists.collect() for t in r.tokens)
            assert got == wanted and wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_meet_alike_in_all_ways():
    """Small pairs at once, large ones each by itself, very large ones by bands."""
    told = np.random.default_rng(3)
    base = told.integers(-(2**63), 2**63, (40, 2))
    sizes = [5, 30, 70, 80, 90]
    lists = []
    for n in sizes:
        h = base[told.integers(0, 40, n)] ^ (1 << told.integers(0, 60, (n, 2))) ^ (1 << told.integers(0, 60, (n, 2)))
        lists.append([{"pos": k, "ts": float(k), "dhash": int(d), "ahash": int(a), "mean": int(m)} for k, ((d, a), m) in enumerate(zip(h, told.integers(0, 256, n)))])
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("ts", pa.float64()), ("dhash", pa.int64()), ("ahash", pa.int64()), ("mean", pa.int16())]))
    items = pa.table({"item_id": pa.array(range(5), pa.int64()), "samples": pa.array(lists, kind)})
    pairs = pa.table({"a": pa.array([a for a in range(5) for b in range(a + 1, 5)]), "b": pa.array([b for a in range(5) for b in range(a + 1, 5)])})
    wanted = []
    for a in range(5):
        for b in range(a + 1, 5):
            for x in lists[a]:
                for y in lists[b]:
                    bits = [(x[h] ^ y[h]) & (2**64 - 1) for h in ("dhash", "ahash")]
                    distance = sum(v.bit_count() for v in bits) + min(8, abs(x["mean"] - y["mean"]) // 16)
                    if distance <= 8 and any((v >> s) & 0xFFFF == 0 for v in bits for s in (0, 16, 32, 48)):
                        wanted.append((a, b, x["pos"], y["pos"], distance))
    for long in (0, 2000, 1 << 24):
        got = [t for low, high, own, i, j, _, _, d in cells.matches(pairs, items, 8, long) for t in zip(low[own].tolist(), high[own].tolist(), i.tolist(), j.tolist(), d.tolist())]
        assert sorted(got) == sorted(wanted) and wanted


def test_runs_too_short_for_a_segment_go_before_the_walk():
    turn, i = np.array([1, 1, 1, 1, 1, 1, 2, 2, 2]), np.array([0, 0, 2, 5, 7, 8, 0, 1, 1])
    assert align._long_runs(turn, i, 3).tolist() == [3, 4, 5]


def test_votes_of_long_sentences(spark):
    text = " ".join(["aa", "bb", "bb"] * 200) + ". " + "cc dd  dd and a few more"
    (long, short) = simhash.sentence_samples(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    word = hashlib.md5(b"bb").digest()
    parts = [int.from_bytes(word[2 * k : 2 * k + 2], "big") for k in range(4)]
    assert long.dhash & (2**64 - 1) == sum(p << 16 * k for k, p in enumerate(parts)) and short.mean == len("cc dd  dd and a few more")


@pytest.mark.parametrize("name", ["shared_token_counts", "cap_candidates", "min_shared_filter"])
def test_tokens_that_items_share_are_not_shuffled(spark, name):
    """Neither a row for a token of an item nor one for a token that two items share leaves a task."""
    told = random.Random(11)
    drawn = spark.createDataFrame([(k - 30, t) for k in range(60) for t in told.sample(range(40), 12)] + [(k, 7000) for k in range(P.max_frequency + 1)], "item_id long, token int")
    s = queries.Stage(spark, "")
    s.made["lists"] = candidates.token_lists(drawn.distinct())
    got = getattr(queries, name)(s)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "hashpartitioning(token" not in plan and "CartesianProduct" in plan
    counts = candidates.shared_token_counts(drop_frequent(drawn.distinct(), P.max_frequency))
    enough = candidates.min_shared(counts, P.min_shared)
    wanted = {"shared_token_counts": counts, "min_shared_filter": enough, "cap_candidates": candidates.cap_candidates(enough, P.per_item)}[name]
    assert _rows(got) == _rows(wanted) and wanted.count() > 1000
    assert name != "cap_candidates" or "Window" not in plan  # an item's best are known where its partners are counted


def test_a_block_tells_the_best_of_its_items_in_parts():
    """Partners come over many chunks and are sifted in between; ties go to the greater id."""
    told = np.random.default_rng(9)
    ids, owned = np.arange(-5, 35, dtype=np.int64), [np.sort(told.choice(12, told.integers(0, 6), replace=False)).astype(np.int32) for _ in range(40)]
    pack = lambda at: (ids[at], np.array([len(owned[k]) for k in at], np.int32), np.concatenate([np.zeros(0, np.int32), *(owned[k] for k in at)]))
    own = candidates._Block(*pack(np.arange(0, 40, 2)), 3)
    for at in np.split(np.arange(40), 8):
        chunk = pack(at)
        own.keep(chunk[0], [(np.zeros(0, np.int64),) * 3, *own.meet(*chunk, 1)])
        own.sift()
    wanted = []
    for k in range(0, 40, 2):
        score = sorted(((-len(set(owned[k]) & set(owned[m])), -ids[m]) for m in range(40) if m != k and set(owned[k]) & set(owned[m])))[:3]
        wanted += [(ids[k], -m, -n) for n, m in score]
    item, other, score = own.sift()
    assert sorted(zip(own.ids[item], other, score)) == sorted(wanted) and len(wanted) > 30


def _stage_of_pairs(spark):
    samples = _samples(spark, n=8)
    s = queries.Stage(spark, "")
    s.made = {"candidates": spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)] + [(3, 99)], "a long, b long"), "fast": samples}
    return s, verify.within(verify.sample_pairs(s.candidates, samples), P.distance)


def _shuffled(df):
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return {k for k in ("token", "bucket", "i#", "j#") for line in plan.splitlines() if "Exchange hashpartitioning" in line and k in line}


def test_bucket_support_shuffles_no_points(spark):
    s, points = _stage_of_pairs(spark)
    got, wanted = queries.bucket_support(s), verify.bucket_support(points)
    assert _shuffled(wanted) and not _shuffled(got)
    assert _rows(got) == _rows(wanted) and got.dtypes == wanted.dtypes and got.count() > 100


def test_points_of_the_fast_pass_meet_in_cells(spark):
    s, points = _stage_of_pairs(spark)
    got, wanted = queries.distance_filter(s), points.select("a", "b", "i", "j", "distance")
    assert _shuffled(wanted) and not _shuffled(got)
    assert _rows(got) == _rows(wanted) and got.dtypes == wanted.dtypes and got.count() > 100


def test_samples_are_not_sent_to_many_tasks(spark):
    """Samples are shuffled to be written and to their block, however many blocks there are."""
    s, points = _stage_of_pairs(spark)
    got = queries.bucket_support(s)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "CartesianProduct" in plan and "Join" not in plan and "Generate" not in plan


def test_new_pairs_meet_in_blocks(spark, monkeypatch):
    """Old items meet new ones only, and an end's best are told among the pairs with a new end."""
    told = random.Random(13)
    drawn = sorted({(k, t) for k in range(40) for t in told.sample(range(30), 9)})
    held = spark.createDataFrame(drawn, "item_id long, token int")
    monkeypatch.setattr(incremental, "tables", lambda *_: {"items": None})
    monkeypatch.setattr(incremental, "postings", lambda *_: held)
    monkeypatch.setattr(incremental, "_live", lambda rows, _: rows)
    q = dataclasses.replace(P, per_item=2, max_frequency=14)
    got = incremental.new_pairs(spark, "", held.where("item_id % 4 = 1"), q)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "CartesianProduct" in plan and "hashpartitioning(token" not in plan
    frequent = {t for _, t in drawn if sum(u == t for _, u in drawn) > 14}
    own = {k: {t for i, t in drawn if i == k} - frequent for k in range(40)}
    best = lambda a: sorted(((-len(own[a] & own[b]), -b) for b in own if b != a and (a % 4 == 1 or b % 4 == 1) and len(own[a] & own[b]) >= 2))[:2]
    assert _rows(got) == sorted({(min(a, -b), max(a, -b)) for a in own for _, b in best(a)}) and frequent
