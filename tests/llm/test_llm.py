"""The llm operators against brute force, exact round trips and held-out rows, with odd rows among them."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandfold.llm import bpe, embeddings, fingerprints, language, licences, lm, mixing, near_dedup, quality, toxicity
from strandfold.llm import queries as Q
from strandfold.llm import words as W
from strandfold.llm.elias_fano import EliasFano, Level, Trie
from strandfold.llm.sampling import folds

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, score int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, short and very long texts, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    near = list(base)
    near[7] = "other"
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(base), "de", None), (3, " ".join(base), "de", None),
        (4, None, None, "b"), (5, "", "en", "b"), (6, " \t\n ", "fr", ""), (7, "One two", "fr", "b"), (8, "ONE  two", "fr", "c"),
        (None, "only a null id here, six", "en", "c"), (None, None, None, None), (9, "é二 " * 60000, "en", "a"), (10, "-" * 5000, None, "a"), (11, "12 34", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 0, 1, 2) for r in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components(texts, percent=75):
    """Brute force: least id reachable."""
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: top(i) for i in texts}


def test_word_codes():
    texts = ["Ab  c\n\td", "", None, "ab", "AB C d", "é\x0bz ", "  "]
    (_, _, codes, bounds), = W.word_codes(W.as_strings(pa.array(texts)))
    want = [w for t in texts for w in words(t)]
    assert len(codes) == len(want) and bounds.tolist() == [0, 3, 3, 3, 4, 7, 9, 9]
    assert len(dict(zip(codes.tolist(), want))) == len(set(want))


def test_bpe_equals_tiktoken_and_round_trips(spark, odd):
    ranks = bpe.read_ranks(PATH)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, rng, tokens = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(1), list(ranks)
    for k in range(3000):
        if k % 2:
            text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))).decode("utf-8", "replace")
        else:
            text = "".join(rng.choice("ab e-=\n\t .,é二'\"s1") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == known.encode_ordinary(text)
    other = bpe.encode(spark.createDataFrame([("abc",)], "text string"), PATH, ".").collect()  # another pattern in the same workers
    assert other[0].ids == [ranks[c.encode()] for c in "abc"]
    long = ["-" * 30000, "ab" * 9000, "é二" * 7000, "the" * 5000]  # pieces beyond LOOKAHEAD
    assert all(encoder.encode(t) == known.encode_ordinary(t) for t in long)
    got = bpe.decode(bpe.encode(odd, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(got) == odd.count() and all(r.ids == known.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") for r in got)
    decoder = bpe.Decoder({0: b"\xe4", 1: b"\xba\x8c", 2: b"\xff", 3: b"a"})
    assert [decoder.feed([i]) for i in (0, 1, 2, 3, 0)] + [decoder.end()] == ["", "二", "�", "a", "", "�"]


def test_near_dedup_equals_brute_force(spark, odd, docs):
    for table in (docs, odd.where("doc_id is not null and doc_id <> 9").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
        got = near_dedup.near_duplicates(table).collect()
        want = components(texts)
        assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {i: (c, len(shingles(texts[i])), c == i) for i, c in want.items()}
    assert near_dedup.near_duplicates(odd).count() == odd.count()
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_dedup_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(5)
    fresh = lambda: [f"w{rng.randint(0, 9999)}" for _ in range(120)]

    def edited(text, at):  # two edits of one text link with it, but not with each other
        return text[:at] + [f"x{at + k}" for k in range(9)] + text[at + 9 :]

    a, b, c, d = fresh(), fresh(), fresh(), fresh()
    rows = [
        (None, b), (None, edited(b, 20)), (None, edited(b, 80)),  # a component without ids
        (7, edited(a, 20)), (None, a), (8, edited(a, 80)),  # linked only through a null id
        (3, c), (3, edited(c, 50)), (3, fresh()), (3, fresh()), (3, d), (3, d), (5, d),  # a repeated id of like, unlike and equal texts
        (None, fresh()), (None, fresh()), (None, []), (None, []), (3, []),
    ]
    rows = [(i, " ".join(t)) for i, t in rows]
    groups = collections.defaultdict(list)
    for k, c in components({k: t for k, (_, t) in enumerate(rows)}).items():
        groups[c].append(k)
    assert sorted(map(len, groups.values()), reverse=True)[:4] == [3, 3, 3, 2]
    least = {k: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values() for k in g}
    table = spark.createDataFrame([(*r, "en", "a", 0, 1, 2) for r in rows], DOC).repartition(3)
    got = near_dedup.near_duplicates(table).collect()
    count = collections.Counter
    assert count((r.doc_id, r.n_shingles, r.component_id) for r in got) == count((i, len(shingles(t)), least[k]) for k, (i, t) in enumerate(rows))
    want = count(least[g[0]] for g in groups.values())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    stage = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, table, SF)
    kept = [(r.doc_id, r.text) for r in stage.collect()]
    assert stage.columns == table.columns and count(i for i, _ in kept) == want
    assert all(sum((rows[k][1]) in [t for _, t in kept] for k in {rows[k][1]: k for k in g}.values()) == 1 for g in groups.values())


def test_near_dedup_in_large_groups(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(300):  # spread copies: only some pairs link
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(150)] = f"x{rng.randint(0, 9999)}"
        rows.append((i, " ".join(copy)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == components(dict(rows))


def test_bayes_bounds_keep_similar_pairs():
    for seen, least in near_dedup.least_matches(160, 0.75, 1e-5):
        lost = sum(math.comb(seen, m) * 0.75**m * 0.25 ** (seen - m) for m in range(least))
        assert lost < 1e-4 and least > seen * 0.4


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(600):
        v = rng.normal(size=16) if k % 3 else np.ones(16) + rng.normal(0, 0.08, 16)
        rows.append((k, v.astype(np.float32).tolist(), k % 2))
    rows += [(600, rows[0][1], 0), (601, None, 0), (602, [0.0] * 16, 0), (603, [float("nan")] * 16, 0), (604, rows[1][1], None), (605, [1.0], 0), (606, [2.0], 0), (607, [None] * 16, 0), (608, [], 0)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = collections.defaultdict(set)
    for i, v, y in good:
        for j, w, z in good:
            if i != j and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    total = sum(map(len, links.values()))
    assert len(got) == len(rows) and total > 1000
    assert sum(min(got[i].n_links, len(links[i])) for i, *_ in rows) >= 0.99 * total and all(got[i].n_links <= len(links[i]) for i, *_ in rows)
    assert all(got[i].component_id == i and got[i].kept for i in (601, 602, 603, 604, 607, 608)) and got[605].n_links == 1
    assert all(r.recall >= 0.99 for r in got.values())


def test_embeddings_are_compared_exactly_where_the_search_falls_short(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(500, 12)), np.repeat(rng.normal(size=(40, 12)), 25, 0) + rng.normal(0, 0.16, (1000, 12))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for name, value in (("CELL", 128), ("PER_CENTRE", 60), ("TRIES", 1), ("SLICE", 300)):
        monkeypatch.setattr(embeddings, name, value)
    monkeypatch.setattr(embeddings, "range_search", lambda x, lists, q, *_: ((i, np.empty(0, int)) for i in range(len(q))))  # a walk that finds nothing
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    links = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert links.sum() > 1000 and [got[k].n_links for k in range(len(x))] == links.tolist() and got[0].recall == 1.0


def test_elias_fano_and_trie():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 64), (1, 64), (5, 3), (1000, 64), (3000, 12)):
        v = np.sort(rng.integers(0, 2**bits - 1, n, dtype=np.uint64))
        e, i, x = EliasFano(v, bits), np.arange(n), rng.integers(0, 2**bits - 1, 500, dtype=np.uint64)
        assert (e[i] == v).all() and (e.successor(x) == np.searchsorted(v, x)).all()
    names = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    each = rng.integers(0, 20, len(names))
    classes = np.concatenate([np.sort(rng.choice(2**18, k, replace=False)) for k in each])
    more = rng.integers(0, 4, len(classes))
    thirds = np.concatenate([np.sort(rng.choice(2**32, k, replace=False)) for k in more])
    levels = [Level(each, classes, np.zeros(len(classes), np.uint16), 18), Level(more, thirds, np.zeros(len(thirds), np.uint16), 32)]
    trie = Trie(names, np.arange(len(names)), levels)
    found = trie.levels[0].find(trie.find_words(names)[np.repeat(np.arange(len(names)), each)], classes)
    assert (found == np.arange(len(classes))).all() and (trie.find_words(names + np.uint64(1)) == -1).all()
    below = trie.levels[1].find(np.repeat(found, more), thirds)
    assert (below == np.arange(len(thirds))).all() and (trie.levels[1].find(np.repeat(found, more), thirds + 1) != below).all()


def test_lm_counts_and_probabilities(spark, docs, odd):
    rows = {r.doc_id: r for r in Q.op3_lm_scoring(spark, SF).collect()}
    text = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    learnt = {i for i in text if zlib.crc32(str(i).encode()) % 7 != 2}
    c = collections.Counter(w for i in learnt for w in text[i])
    n, v = sum(c.values()), len(c)
    for i, tokens in text.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in learnt, len(tokens), sum(w in c for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(odd, F.lit(True)).count() == odd.count() and lm.score(odd.limit(0), F.lit(True)).count() == 0


def plain_lm(texts, learnt):
    """Log10 p of a token after those before it, by counting, as a function of the two strengths."""
    grams = [collections.Counter() for _ in range(3)]
    for tokens in (texts[i] for i in learnt):
        line = ["<start>", *tokens]
        grams[0].update(line)
        for k in (1, 2):
            grams[k].update(zip(*[line[j:] for j in range(k + 1)]))
    n = sum(c for w, c in grams[0].items() if w != "<start>")

    def p(before, w, second, third):
        v = before[-1]
        s = second * math.sqrt(1 + grams[0][v])
        two = (grams[1][v, w] + s * max(grams[0][w], 1) / (n + 1)) / (grams[0][v] + s)
        if len(before) < 2:
            return two
        c = grams[1][before[-2], v]
        t = third * math.sqrt(1 + c)
        return (grams[2][before[-2], v, w] + t * two) / (c + t)

    return p, grams


def test_lm_scores_equal_plain_counting(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(lm, "HEAVY", 60)  # frequent words, pairs of them among them
    for table, train in ((docs.select("doc_id", "text"), F.col("doc_id") % 3 != 1), (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), F.lit(True))):
        texts = {r.doc_id: [*words(r.text), None] for r in table.collect()}
        learnt = {r.doc_id for r in table.where(train).collect()}
        got = lm.score(table, train).collect()
        p, grams = plain_lm(texts, learnt)
        second, third = got[0].second, got[0].third
        for r in got:
            line = ["<start>", *texts[r.doc_id]]
            want = sum(math.log10(p(line[max(0, j - 2) : j], line[j], second, third)) for j in range(1, len(line)))
            assert r.score == pytest.approx(want, rel=1e-6, abs=3e-4 * r.n_tokens), r.doc_id  # codes are steps of 1 / 4096
        for before in (["<start>"], ["<start>", texts[min(learnt)][0]], list(grams[1].most_common(1)[0][0])):
            if before[-1] is not None:
                words_of = [w for w in grams[0] if w != "<start>"]
                assert sum(p(before, w, second, third) for w in [*words_of, "an unknown word"]) == pytest.approx(1)


def test_lm_shards_hold_no_frequent_word_whole(spark, monkeypatch):
    """A fifth of all tokens is one word; whatever N / HEAVY is, no shard gets more than a few times SHARD_TOKENS."""
    monkeypatch.setattr(lm, "HEAVY", 2)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    rng = random.Random(8)
    rows = [(k, " ".join("the" if rng.random() < 0.2 else f"w{rng.randint(0, 900)}" for _ in range(100))) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(True).alias("train")).coalesce(1)
    counted = lm._count(table, 6).cache()
    n, ends = counted.agg(F.sum("n"), F.sum("ends")).first()
    heavy = lm._heavy(counted, n, ends)
    assert (lm.W.codes(np.frombuffer(b"the", np.uint8), np.array([0]), np.array([3])) & lm.CODE)[0] in heavy[0] and len(heavy[0]) < n / 500 + 2
    shards = -(-n // 500)
    dealt = table.mapInArrow(lm._deal(shards, heavy[0]), "key long, block long, part long, blob binary").where("key >= 0").collect()
    triples = collections.Counter()
    for r in dealt:
        triples[r.key] += len(lm._unpack(r.blob)[5])
    assert n == 20200 and sum(triples.values()) > 15000 and max(triples.values()) < 3 * 500
    texts = {k: [*words(t), None] for k, t in rows}
    p, _ = plain_lm(texts, set(texts))
    for r in lm.score(table, F.lit(True)).where("doc_id < 9").collect():
        line = ["<start>", *texts[r.doc_id]]
        want = sum(math.log10(p(line[max(0, j - 2) : j], line[j], r.second, r.third)) for j in range(1, len(line)))
        assert r.score == pytest.approx(want, rel=1e-6, abs=3e-4 * r.n_tokens)


def test_mix_hits_targets(spark, docs, odd):
    got = mixing.mix(docs).collect()
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert all(r.size == size[r.doc_id] and r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
    total, weight = sum(size.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by))}
    source = {s: sum(r.size for r in rows) for s, rows in by.items()}
    full = set()
    while True:
        share = (total - sum(3 * source[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s, w in weight.items() if s not in full and w * share > 3 * source[s]}
        if not more:
            break
        full |= more
    for s, rows in by.items():
        assert rows[0].target == pytest.approx(3 * source[s] if s in full else weight[s] * share)
        assert abs(sum(r.taken for r in rows) - rows[0].target) < max(r.size for r in rows) + 1e-6
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, got))
    kept = mixing.mix(odd).collect()
    assert len(kept) == odd.count() and all(r.taken == 0 for r in kept if r.size == 0)
    assert mixing.mixed(odd).columns == odd.columns and mixing.mix(docs.limit(0)).count() == 0


def test_licences(spark, docs, odd):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted((a, b, c, round(d, 9)) for a, b, c, d in con.execute(licences.oracle_sql()).fetchall())
    assert sorted((r.doc_id, r.licence, r.n_passages, round(r.dice, 9)) for r in licences.scan(docs).collect()) == want and want
    assert licences.scan(odd).count() == 0 and licences.scan(odd.limit(0)).count() == 0
    full = licences.TEMPLATES["MIT-full"].split()
    wrapped = "\n".join(" * " + " ".join(full[i : i + 9]) for i in range(0, len(full), 9))
    code = "\n".join(f"x{i} = f(y{i}, {i}) of the end" for i in range(400))
    rows = [
        (1, "text\nreleased UNDER the (MIT) licence.\nReleased under the MIT License!"), (2, "Copyright 2020 X. Released under the MIT License. All of it."),
        (3, f"/*\n{wrapped}\n*/\n{code}"), (4, f"{wrapped.replace('Software', 'Program', 2)}\n{code}\n{wrapped}"), (5, code), (None, "-" * 9000 + "licensed, under: CC BY-NC\n4.0"),
        (6, "Released under the MIT License."), (6, "Released under the MIT License."),
    ]
    found = {(r.doc_id, r.licence): (r.n_passages, r.dice) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {
        (1, "MIT"): (2, 1.0), (2, "MIT"): (1, 1.0), (3, "MIT-full"): (1, 1.0), (3, "MIT-text"): (1, 1.0), (4, "MIT-full"): (2, 1.0), (4, "MIT-text"): (2, 1.0),
        (None, "CC-BY-NC-4.0"): (1, 1.0), (6, "MIT"): (2, 1.0),
    }


def test_licences_of_any_length_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for name in ("MIT-text", "GPL-3.0-text", "Apache-2.0-text", "BSD-text", "MPL-2.0-text"):
        words_ = licences.words_of(licences.TEMPLATES[name])
        for every in (6, 7, 8, 11):
            longer = [x for k, w in enumerate(words_) for x in ([w, "new"] if k % every == every - 1 else [w])]
            shorter = [w for k, w in enumerate(words_) if k % every]
            for made in (longer, shorter, longer + ["and", "then"] + shorter, words_[: len(words_) * 2 // 3] + longer[-20:]):
                around = [rng.choice(["to", "the", "copy", "of", "xx"]) for _ in range(rng.randrange(8))]
                rows.append((len(rows), " ".join(around + made + around)))
    want = {}
    for k, text in rows:
        grams = [f"{a} {b}" for a, b in zip(text.split(), text.split()[1:])]
        for name, template in licences.TEMPLATES.items():
            own, longest = set(licences.bigrams_of(template)), licences._longest(template, 0.8)
            if len(own & set(grams)) < 0.8 / 1.2 * len(own):
                continue
            found = {}
            for i in range(len(grams)):
                seen = set()
                for g in grams[i : i + longest]:
                    seen.add(g)
                    found[i] = max(found.get(i, 0), 2.0 * len(seen & own) / (len(seen) + len(own)))
            at = [i for i, d in found.items() if d >= 0.8 and grams[i] in own]
            if max(found.values()) >= 0.8:
                apart = licences._places(template) // 2
                want[k, name] = (sum(j == 0 or i - at[j - 1] > apart for j, i in enumerate(at)), max(found.values()))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.licence): (r.n_passages, r.dice) for r in licences.scan(table).collect()}
    assert found == want and len({k for k, _ in want}) > 40
    monkeypatch.setattr(licences, "STRIDE", 7)
    assert {(r.doc_id, r.licence): (r.n_passages, r.dice) for r in licences.scan(table).collect()} == want


def test_fingerprints(spark, docs, odd):
    text = [(r.doc_id, r.text) for r in docs.orderBy(F.desc("doc_id")).collect()]
    got = {r.doc_id: r for r in Q.op6_fingerprints(spark, SF).collect()}
    assert len(got) == len(text)
    for k, (i, t) in enumerate(text):
        after, third = text[(k + 1) % len(text)][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        assert abs(got[i].near_edited - len(a & b) / max(1, len(a | b))) < 0.3
    assert fingerprints.edits(odd).count() == odd.count() and fingerprints.edits(odd.limit(0)).count() == 0
    some, minhash = [t for _, t in text[:12]], W.MinHash(fingerprints.PERMUTATIONS, seed=23)
    for (_, _, codes, bounds) in W.word_codes(W.as_strings(pa.array(some))):
        for (i, _), found in zip(text, W.shingle_sets(codes, bounds)):
            least = [min((int(a) * int(x) + int(b)) % 2**64 for x in found) for a, b in zip(minhash.a.ravel(), minhash.b.ravel(), strict=True)]
            assert got[i].fingerprint == "".join(f"{int(v) >> 48:04x}" for v in W.mix(np.array(least, np.uint64)))
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 9999)}" for _ in range(100)] for _ in range(9)]
    rows = [(k, " ".join(w if rng.random() > 0.006 else f"x{rng.randint(0, 9999)}" for w in base[k % 9])) for k in range(90)]
    near = {r.doc_id: r.component_id for r in fingerprints.banded_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near == components(dict(rows)) and len(set(near.values())) < 60


@pytest.mark.parametrize("hot", [None, 50])
def test_following_documents_of_hot_ids(spark, monkeypatch, hot):
    """Half of the rows share one id or null: they are dealt to many bins and each still meets the next one."""
    monkeypatch.setattr(fingerprints, "BIN_ROWS", 10)
    rows = [(hot if k % 2 else k, f"text {k} " * 4) for k in range(300)] + [(7, "same"), (7, "same"), (-(2**63), "least"), (2**63 - 1, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = fingerprints.with_following(table.na.fill("", ["text"]), 30).withColumn("part", F.spark_partition_id()).collect()
    assert max(collections.Counter(r.part for r in dealt).values()) < 60
    assert all(len({r.part for r in dealt if r.bin == b}) == 1 for b in {r.bin for r in dealt})
    own = [r for r in dealt if not r.copy]
    assert collections.Counter((r.doc_id, r.text) for r in own) == collections.Counter((i, t or "") for i, t in rows)
    order = [r for b in sorted({r.bin for r in own}) for r in own if r.bin == b]
    ids = [r.doc_id for r in order]
    assert ids == sorted(ids, key=lambda i: (i is None, -(i or 0)))
    want = collections.Counter()
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        k = len(r.text) // 3
        want[r.doc_id, hashlib.sha256((r.text[: len(r.text) - k] + after.text[:k]).encode()).hexdigest()] += 1
    monkeypatch.setattr(fingerprints, "MOST_BINS", 30)
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in fingerprints.edits(table).collect()) == want


def test_language_gradients_and_held_out_accuracy(spark, docs, odd):
    net = language.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data, label = np.random.default_rng(0).integers(97, 123, (4, 5)), np.array([0, 1, 2, 1])
    loss = lambda: -net.log_probabilities(data)[np.arange(4), :, label].mean()
    for name, g in net.gradients(data, label).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = net.p[name][at]
        net.p[name][at] = kept + 1e-3
        up = loss()
        net.p[name][at] = kept - 1e-3
        down = loss()
        net.p[name][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.02)
    texts = pa.array(["", "a b\xe9 " * 40, "x" * language.WINDOW], pa.large_string())
    body, offsets = W.raw(texts)
    starts, ends, bounds = language.windows(offsets)
    seen = [language.read(body, starts[i:j], ends[i:j]).tobytes().rstrip().decode() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert seen == [t.rstrip() for t in texts.to_pylist()]  # windows hold the whole text, over words and blanks
    small = language.Network(["a", "b"])
    want = np.zeros((len(texts), 2))
    for k, text in enumerate(texts.to_pylist()):
        for at in range(0, len(text.encode()), language.WINDOW):
            window = text.encode()[at : at + language.WINDOW].ljust(language.WINDOW)
            each = small.log_probabilities(np.frombuffer(window, np.uint8)[None])[0]
            want[k] += sum(each[i] for i, c in enumerate(window) if chr(c).isascii() and chr(c).isalpha() or c > 127)
    assert np.allclose(language._sums(small, body, offsets), want, rtol=1e-4)
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in Q.op8_language_id(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)
    made = language.fit(pa.array(["the and of", "der die das"], pa.large_string()), ["en", "de"])
    rows = language.predict(odd, made).collect()
    assert len(rows) == odd.count() and all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in rows)


def test_classifiers_on_held_out_rows(spark, odd):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, name, found, alarms in ((Q.op9_toxicity, "toxic", 0.75, 0.02), (Q.op10_quality, "quality", 0.9, 0.08)):
        held = [(r.predicted, label[r.doc_id][name]) for r in query(spark, sf).collect() if r.held_out and r.doc_id in label]
        ones, others = [p for p, k in held if k], [p for p, k in held if not k]
        assert sum(ones) >= found * len(ones) > 0 and sum(others) <= max(1, alarms * len(others))
    for got in (quality.score(odd, np.zeros((1 << 18) + 2)), toxicity.score(odd, None)):
        rows = got.collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_equals_brute_force(spark):
    """The query's scores and evidence from dense cosines over all words."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice([f"w{rng.randint(0, 60)}", f"r{rng.randint(0, 900)}", *(["vile", "nasty"] if i % 5 == 0 else [])]) for _ in range(rng.randint(3, 40))), int(i % 5 == 0)) for i in range(160)]
    rows[7] = (7, "", 0)
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    asked = spark.createDataFrame([*((i + 1000, t) for i, t, _ in rows[:50]), (9001, None), (9002, "zzz"), (9003, "vile nasty")], "doc_id long, text string")
    index = toxicity.train(table, F.col("toxic"), table)
    got = {r.doc_id: r for r in toxicity.score(asked, index).collect()}
    bags = {i: collections.Counter(t.split()) for i, t, _ in rows}
    y = {i: k for i, _, k in rows}
    df = collections.Counter(w for b in bags.values() for w in b)
    ones = collections.Counter(w for i, b in bags.items() if y[i] for w in b)
    factor = {w: (math.log((len(rows) + 1) / (df[w] + 1)) + 1) * math.log2(2 + ones[w] / max(1, df[w] - ones[w])) ** toxicity.POWER for w in df}

    def vector(bag):
        v = {w: (1 + math.log(n)) * factor[w] for w, n in bag.items() if w in factor}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(b) for i, b in bags.items()}
    base = sum(y.values()) / len(y)
    for r in asked.collect():
        q = vector(collections.Counter((r.text or "").split()))
        near = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), i) for i, v in vectors.items()), reverse=True)[: toxicity.K]
        near = [(c, i) for c, i in near if c > 0]
        evidence = got[r.doc_id].evidence
        assert [e.cosine for e in evidence] == pytest.approx([c for c, _ in near]) and all(e.label == y[e.doc_id] for e in evidence)
        share = (sum(c * y[i] for c, i in near) + base) / (sum(c for c, _ in near) + 1)
        assert got[r.doc_id].score == pytest.approx(index.probability(share) if q else index.empty, abs=1e-6)
    part, votes = folds(pa.array([t for _, t, _ in rows], pa.large_string()), toxicity.PARTS, 1), []  # the calibration, from examples that an index of the other parts has not seen
    for i in range(len(rows)):
        rest = [j for j in range(len(rows)) if part[j] != part[i]]
        held = collections.Counter(w for j in rest for w in bags[j])
        one = collections.Counter(w for j in rest if y[j] for w in bags[j])
        factor = {w: (math.log((len(rows) + 1) / (df[w] + 1)) + 1) * math.log2(2 + one[w] / max(1, held[w] - one[w])) ** toxicity.POWER for w in held}
        q, others = vector(bags[i]), {j: vector(bags[j]) for j in rest}
        near = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), j) for j, v in others.items()), reverse=True)[: toxicity.K]
        votes.append((sum(c * y[j] for c, j in near) + sum(y[j] for j in rest) / len(rest)) / (sum(c for c, _ in near) + 1))
    index.calibrate(np.array([votes[i] for i in index.ids]))
    again = {r.doc_id: r.score for r in toxicity.score(asked, index).collect()}
    assert len(set(part)) > 1 and again == pytest.approx({i: r.score for i, r in got.items()}, abs=1e-9)
    assert toxicity.train(table.limit(0), F.col("toxic"), table) is None


def test_cross_validation_leaves_folds_out(spark):
    """Copies share a fold; what only one fold holds can't be told by the others."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["vile", "nasty", "scum"] if k % 3 == 0 else ["calm", "kind", "soft"]) + f" w{rng.randint(0, 50)}" for _ in range(30)) for k in range(90)]
    column, y = pa.array(texts, pa.large_string()), [int(k % 3 == 0) for k in range(90)]
    fold = folds(pa.array([*texts, texts[0], "", ""], pa.large_string()))
    assert fold[90] == fold[0] and fold[91] == fold[92] and set(fold[:90]) == {0, 1, 2}
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert toxicity.cross_validated(column, y, fold[:90], table) == (30, 30, 0, 60)
    own = np.array(y)  # all of label 1 in one fold: the other fold knows no example of it
    assert toxicity.cross_validated(column, y, own, table)[:2] == (0, 30)
    langs = ["de" if k else "en" for k in y]
    assert language.cross_validated(column, langs, own, 4)[0] == 0


def test_quality_equals_plain_dot_products(spark):
    """Scores are the intercept and, over all features of a text, weight times count over the root of its words."""
    rng = np.random.default_rng(4)
    weights = rng.normal(size=(1 << quality.BITS) + 2)
    weights[1 << quality.BITS] = 0
    texts = ["a b a b, c!", "", None, "x", "Word word WORD  w2\n..", "é二 " * 50, " ".join(f"w{k % 7}" for k in range(300))]
    got = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).collect()
    assert len(got) == len(texts)
    for r in got:
        body, offsets = W.raw(W.as_strings(pa.array([r.text])))
        slots, bounds, factor = quality.features(body, offsets)
        n = len(re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^\s0-9A-Za-z\u0080-\U0010ffff]+", r.text or ""))
        total = sum(weights[k] for k in slots.tolist()) / math.sqrt(max(n, 1)) + weights[-1]
        assert len(slots) == 3 * n and bounds.tolist() == [0, 3 * n] and factor[0] == pytest.approx(1 / math.sqrt(max(n, 1)))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))))


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(6)
    known = np.arange(40, dtype=np.uint64)
    bags = [np.unique(rng.integers(0, 40, rng.integers(0, 6)), return_counts=True) for _ in range(500)]
    index = toxicity.Index(known, rng.uniform(1, 5, 40), bags, rng.integers(0, 2, 500).astype(float))
    for bag in bags[:60]:
        q = index.vector(*bag)
        dense = np.zeros(40)
        dense[q[0]] = q[1]
        cosines = np.array([dense[a] @ b for a, b in index.vectors])
        want = sorted(((-c, i) for i, c in enumerate(cosines) if c > 0))[: toxicity.K]
        ids, got = index.nearest(*q) if len(q[0]) else ([], [])
        assert np.allclose(got, [-c for c, _ in want])


def test_mix_takes_rows_one_by_one(spark):
    text = " ".join(["w"] * 10)
    rows = [(1, text, "a", 5)] * 60 + [(None, text, "a", 5)] * 300 + [(k + 2, text, "b", k) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(4)
    got = mixing.mix(table).collect()
    taken = collections.Counter()
    for r in got:
        taken[r.doc_id if r.source == "a" else "b"] += r.copies
    assert len(got) == 400 and len({r.row for r in got}) == 400
    out = mixing.mixed(table)
    again = collections.Counter(r.doc_id if r.source == "a" else "b" for r in out.collect())
    assert out.columns == table.columns and +again == +taken
    assert all(abs(10 * sum(r.copies for r in got if r.source == s) - next(r.target for r in got if r.source == s)) < 10 for s in "ab")


def test_mix_is_the_same_however_the_table_is_split(spark, docs, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1, 2, k]), " ".join(["w"] * rng.randrange(30)), rng.choice("ab")) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.option("parquet.block.size", 2048).parquet(f"{tmp_path}/t")
    seen = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        table = spark.read.parquet(f"{tmp_path}/t")
        seen.append((sorted(map(str, (tuple(r) for r in mixing.mix(table).drop("row").collect()))), table.rdd.getNumPartitions()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0][0] == seen[1][0] and seen[0][1] != seen[1][1]


def test_toxicity_of_empty_texts_is_the_share_among_empty_examples(spark):
    rows = [(k, "", int(k == 500)) for k in range(1001)] + [(2000 + k, f"nice words number {k} here and there", 0) for k in range(30)] + [(3000 + k, f"bad {k} awful mean words of hate", 1) for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.train(table, F.col("toxic"), table.select("doc_id", "text"))
    assert 0.0005 < index.empty < 0.002
    got = toxicity.score(spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string"), index).collect()
    assert all(r.score == index.empty for r in got)


def test_embedding_recall_is_measured_without_the_search(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[1::10] = x[::10] + rng.normal(0, 0.02, x[::10].shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = (x @ x.T >= 0.98).sum(axis=1) - 1
    walk = embeddings.range_search
    lossy = lambda x, lists, q, threshold, beam, own: ((i, near if k % 2 else near[:0]) for k, (i, near) in enumerate(walk(x, lists, q, threshold, beam, own)))
    monkeypatch.setattr(embeddings, "range_search", lossy)
    monkeypatch.setattr(embeddings, "TRIES", 1)
    got = {r.vec_id: r for r in embeddings.near_duplicates(table).collect()}
    assert links.sum() > 500 and [got[k].n_links for k in range(len(x))] == links.tolist() and got[0].recall == 1.0  # about half was lost, so all were compared
    few = table.where("vec_id % 10 not in (0, 1) or vec_id < 20")
    got = {r.vec_id: r for r in embeddings.near_duplicates(few).collect()}
    assert sum(r.n_links for r in got.values()) == 4 and got[0].recall == 1.0  # too few linked to measure by


def test_pipeline_keeps_columns_and_odd_rows(spark, docs, odd):
    import corpus_pipeline

    named = docs.select("*", F.col("doc_id").alias("score"), F.col("doc_id").alias("lang_pred"), F.col("doc_id").alias("evidence"), F.col("doc_id").alias("copies"), F.col("doc_id").alias("row"))
    stages = dict(corpus_pipeline.STAGES)
    plain = {name: collections.Counter(r.doc_id for r in stages[name](spark, docs, SF).collect()) for name in list(stages)[:-1]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, named, SF).collect()
        assert all(r.score == r.lang_pred == r.evidence == r.copies == r.row == r.doc_id for r in got), name
        assert collections.Counter(r.doc_id for r in got) == plain[name]
        assert stage(spark, docs.limit(0), SF).count() == 0
    count = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    assert count(stages["toxicity"](spark, odd, SF)) == count(odd)
    lettered = stages["language ID"](spark, odd, SF)
    assert count(lettered) <= count(odd.where(F.col("text").rlike(r"\p{L}")))
    last = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert len(last) == odd.count() and all(r.round_trip for r in last)


def test_pipeline_toxicity_stage_is_the_operator(spark, docs):
    import corpus_pipeline

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    index = toxicity.train(docs.join(labels, "doc_id"), F.col("toxic"), docs)
    want = {r.doc_id for r in toxicity.score(docs, index).collect() if r.score < corpus_pipeline.TOXIC_FROM}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, SF).collect()} == want


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    table, ids = docs, set()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, SF).cache()
        assert table.columns == docs.columns, name
        ids = {r.doc_id for r in table.select("doc_id").collect()}
        if name == "MinHash near-dedup":
            assert table.count() == len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, table, SF).collect()
    assert len(last) == table.count() and all(r.round_trip for r in last) and len(ids) > 100


def test_pipeline_gives_the_drivers_memory_back(spark, docs, monkeypatch):
    import weakref

    import corpus_pipeline

    fitted, gone = [], []
    for module in (toxicity, language):
        monkeypatch.setattr(module, "train", lambda *a, f=module.train: (fitted.append(weakref.ref(x := f(*a))), x)[1])
    monkeypatch.setattr(W, "release", lambda: gone.append([x() is None for x in fitted]))
    for name in ("toxicity", "language ID"):
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert gone == [[True], [True, True]]  # freed first, then given back, in each of the two stages that fit
