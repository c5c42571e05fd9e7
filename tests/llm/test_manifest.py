"""The Merkle manifest against a plain tree, with odd rows among them."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandfold.llm import manifest as M
from strandfold.llm import queries as Q

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def around(tree, place):
    """Siblings of a leaf, level by level."""
    return [tree[h][(place >> h) ^ 1] for h in range(len(tree) - 1) if (place >> h) ^ 1 < len(tree[h])]


def refold(node, tree, place):
    for h in range(len(tree) - 1):
        pair = list(tree[h][(place >> h) // 2 * 2 : (place >> h) // 2 * 2 + 2])
        pair[(place >> h) % 2] = node
        node = sha("".join(pair))
    return node


def plain(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text), by the definition."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        made[name] = levels([x[2] for x in trees[name]])
    top = levels([made[n][-1][0] for n in names])
    out = []
    for at, name in enumerate(names):
        for place, (_, _, own, r) in enumerate(trees[name]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            start = leaf(*r[:3], r[3] + 1, r[4]) if tampered else own
            folded = refold(refold(start, made[name], place), top, at)
            proof = around(made[name], place) + around(top, at)
            out.append((r[0], own, made[name][-1][0], top[-1][0], sha("".join(proof)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def test_positions_are_those_of_the_log():
    for n in range(1, 300):
        tree = levels([sha(str(k)) for k in range(n)])
        log = M.postorder(tree[0], M.height(n))
        assert len(log) == sum(map(len, tree)) and log[-1] == tree[-1][0]
        for h, level in enumerate(tree):
            for i, node in enumerate(level):
                assert log[M.position(h, i, n)] == node


def test_fold_rejects_another_leaf():
    tree = levels([sha(str(k)) for k in range(11)])
    for place in range(11):
        assert M.fold(tree[0][place], place, 11, iter(around(tree, place))) == tree[-1][0]
        assert M.fold(sha("other"), place, 11, iter(around(tree, place))) != tree[-1][0]


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf int, PLACE int"


def run(spark, rows, tmp_path):
    path = f"{tmp_path}/sf"
    spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in Q.op13_merkle_manifest(spark, path).collect()), key=str)


def test_query_equals_plain_tree(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = Q.op13_merkle_manifest(spark, SF).collect()
    assert sorted((tuple(r) for r in found), key=str) == plain(rows)
    assert {r.verified for r in found} == {True, False}


def test_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, "s", rng.choice(["en", "de", "é", "", "en"]), rng.choice([None, k, 2**62]), "t" * rng.randrange(9)) for k in range(60)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (3, "s", "en", 5, "again"), (3, "s", "en", 5, "again"), (70, "s", "lone", -4, "é" * 200000), (71, None, None, 2**63 - 1, "")]
    assert run(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, tmp_path, n):
    rows = [(k, "s", None, 3, "x") for k in range(n)]
    assert run(spark, rows, tmp_path) == plain(rows) if n else run(spark, rows, tmp_path) == []


@pytest.mark.parametrize(("n", "high", "bands"), [(2500, 7, 2), (77, 2, 4), (64, 1, 6)])
def test_one_tree_over_many_bands(spark, n, high, bands):
    rows = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    made = M.manifest(rows, F.lit("x"), [F.col("id")], F.col("h"), {"id": F.col("id")}, high)
    tree = levels([sha(str(k)) for k in range(n)])
    assert made.root == tree[-1][0] and len(made.bands) == bands
    found = made.proofs().collect()
    assert {r.id: r.siblings for r in found} == {k: around(tree, k) for k in range(n)}
    assert {r.folded_root for r in found} == {made.root}
