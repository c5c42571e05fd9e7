"""A trigram language model over the whole corpus, kept and queried as Elias-Fano tries.

Tokens are words and one end per text. p(w) = c(w) / (N + 1), where the one unknown event has 1 / (N + 1);
p(w | v) = (c(v w) + s p(w)) / (c(v) + s) and p(w | u v) = (c(u v w) + t p(w | v)) / (c(u v) + t): Bayesian
mixtures of what followed a context and of the shorter context, with strengths s and t that grow with the
root of the context's count: k sqrt(1 + c). A text's first token has only its start before it, so p(w | v).
The two k are those of GRID under which leave-one-out prediction of all training tokens is best.

Two passes read the texts. The first counts words. The second deals each block's distinct pairs and triples
to shards by their first word; a shard adds the blocks' counts, builds its trie, whose levels hold words,
what follows them and what follows that, with quantised probabilities c / (N + 1), and answers every block
from it; a block's documents meet its answers again and are scored under every pair of k, of which one is
kept. First words are told by codes of 56 bits, second words by 32 bits relative to the first, third words by
24 bits relative to the pair, so an unseen third word is taken for one of m seen ones with chance m / 2^24.
A word above N / HEAVY tokens, or above SHARD_TOKENS where that is less, is dealt by its pair, and by its
triple if the second word is such a one too, so no word brings a shard more than SHARD_TOKENS tokens however
large the corpus. Such words are fewer than HEAVY or than the shards; their exact counts go to all tasks,
16 bytes each. A block sends each pair and triple once, in one row a shard, so rows are at most its distinct
pairs and triples, and no key gathers rows beyond the number of blocks.

Rows: a null or empty text has only its end; a null doc_id counts as training; repeated rows count
as often as they come; very long texts are read whole; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.durable import durable
from strandfold.llm import words as W
from strandfold.llm.elias_fano import Level, Trie

HEAVY = 4096
BLOCK_TOKENS = 1_500_000
SHARD_TOKENS = 1_500_000
GRID = [0.5, 4.0, 32.0]
UNIT = 4096.0  # codes of probabilities: -log10 p in steps of 1 / UNIT
UNSEEN = 65535
SECOND_BITS, THIRD_BITS = 32, 24  # of a second and a third word's code, relative to what stands before it
CODE = np.uint64(0xFFFFFFFFFFFFFF00)
START, END = (W.mix(np.array([k], np.uint64)) & CODE for k in (0x5354415254, 0x454E44))
_SECOND, _THIRD, _HALF, _LOW = np.uint64(64 - SECOND_BITS), np.uint64(64 - THIRD_BITS), np.uint64(32), np.uint64(0xFFFFFFFF)
_ZSTD = pa.Codec("zstd", 1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, each as planes of bytes."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.empty((0, 0), np.uint8)
        body = planes.tobytes()
        small = bytes(_ZSTD.compress(body)) if body else b""
        parts += [a.dtype.str.encode().ljust(8), len(a).to_bytes(8, "little"), len(small).to_bytes(8, "little"), small]
    return b"".join(parts)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        dtype, n, size = np.dtype(blob[at : at + 8].strip().decode()), int.from_bytes(blob[at + 8 : at + 16], "little"), int.from_bytes(blob[at + 16 : at + 24], "little")
        at += 24
        if n:
            body = np.frombuffer(_ZSTD.decompress(blob[at : at + size], n * dtype.itemsize), np.uint8)
            out.append(np.ascontiguousarray(body.reshape(dtype.itemsize, n).T).view(dtype).ravel())
        else:
            out.append(np.empty(0, dtype))
        at += size
    return out


def _tokens(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's start, words and end, and the n + 1 bounds of the texts."""
    docs = len(bounds) - 1
    at = bounds + 2 * np.arange(docs + 1)
    tokens = np.empty(len(words) + 2 * docs, np.uint64)
    inner = np.ones(len(tokens), bool)
    tokens[at[:-1]], tokens[at[1:] - 1] = START[0], END[0]
    inner[at[:-1]] = inner[at[1:] - 1] = False
    tokens[inner] = words & CODE
    return tokens, at


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray, np.ndarray]]:
    """(ids, train flags, tokens, bounds) of at most BLOCK_TOKENS and one text."""
    ids, train, parts, n = [], [], [], 0

    def flush():
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        return ids, train, np.concatenate([p[0] for p in parts]), at

    for batch in batches:
        doc_ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for lo, hi, codes, bounds in W.word_codes(W.as_strings(batch.column(1))):
            parts.append(_tokens(codes, bounds))
            ids += doc_ids[lo:hi]
            train += flags[lo:hi]
            n += len(parts[-1][0])
            if n >= BLOCK_TOKENS:
                yield flush()
                ids, train, parts, n = [], [], [], 0
    if parts:
        yield flush()


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


def _count(docs: DataFrame, shard_bits: int) -> DataFrame:
    """Of the training texts, by shards of the word codes: numbers of words, tokens and ends, and the frequent words."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64), np.empty(0, np.int64)

        def told(words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            edges = np.searchsorted(words >> np.uint64(64 - shard_bits), np.arange((1 << shard_bits) + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(edges))
            blobs = [_pack(words[a:b], counts[a:b]) for a, b in zip(edges[some], edges[some + 1], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for _, _, tokens, _ in _blocks(batches):
            words, counts = np.unique(tokens[tokens != START[0]], return_counts=True)
            held = _sums(np.concatenate([held[0], words]), np.concatenate([held[1], counts]))
            if len(held[0]) >= BLOCK_TOKENS:
                yield told(*held)
                held = held[0][:0], held[1][:0]
        yield told(*held)

    def reduce(key, rows: pd.DataFrame) -> pd.DataFrame:
        got = [_unpack(b) for b in rows["blob"]]
        words, counts = _sums(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64))
        much = counts >= min(counts.sum() / HEAVY, SHARD_TOKENS)
        ends = int(counts[words == END[0]].sum())
        return pd.DataFrame({"shard": [key[0]], "v": [len(words)], "n": [int(counts.sum())], "ends": [ends], "heavy": [_pack(words[much], counts[much])]})

    rows = docs.where("train").mapInArrow(blocks, "shard long, blob binary")
    return rows.groupBy("shard").applyInPandas(reduce, "shard long, v long, n long, ends long, heavy binary")


def _heavy(counted: DataFrame, n: int, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the words of `least` tokens or more, with the start and the end of a text."""
    least = min(n / HEAVY, SHARD_TOKENS)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                words, counts = _unpack(blob)
                keep = (counts >= least) & (words != END[0])
                yield pa.RecordBatch.from_arrays([pa.array(words[keep].view(np.int64)), pa.array(counts[keep])], names=["w", "c"])

    # Fewer than max(HEAVY, n / SHARD_TOKENS) words have as many.
    got = counted.select("heavy").mapInArrow(frequent, "w long, c long").toArrow()
    top = list(zip(got["w"].to_numpy().view(np.uint64), got["c"].to_numpy(), strict=True))
    top = sorted([*top, (START[0], ends), (END[0], ends)])
    return np.array([x[0] for x in top], np.uint64), np.array([x[1] for x in top], np.int64)


class _Grams:
    """The distinct pairs and triples of a block and where they are dealt; made alike when it is dealt and when it is gathered.

    Nodes are pairs by the shards that hold them: each at its home, and beside each triple that is dealt apart from its pair.
    """

    def __init__(self, words: np.ndarray, number: np.ndarray, bounds: np.ndarray, shards: int, heavy: np.ndarray):
        """words: distinct codes, sorted; number: of each token its word's."""
        first = np.zeros(len(number), bool)
        first[bounds[:-1]] = True
        self.has_pair = np.flatnonzero(~first)
        follows = np.zeros(len(number), bool)
        follows[bounds[:-1] + 1] = True
        self.has_triple = np.flatnonzero(~(first | follows))
        cur = number.astype(np.uint64)
        pairs, of_pair = np.unique(cur[self.has_pair - 1] << _HALF | cur[self.has_pair], return_inverse=True)
        self.pair = np.full(len(number), -1)
        self.pair[self.has_pair] = of_pair
        triples, of_triple = np.unique(self.pair[self.has_triple - 1].astype(np.uint64) << _HALF | cur[self.has_triple], return_inverse=True)
        self.u, self.v = (pairs >> _HALF).astype(np.int64), (pairs & _LOW).astype(np.int64)
        parent, w = (triples >> _HALF).astype(np.int64), (triples & _LOW).astype(np.int64)
        much, lone = np.isin(words, heavy), W.mix(words)
        two = np.where(much[self.u], W.mix(words[self.u] ^ W.mix(lone[self.v])), lone[self.u])
        both = much[self.u] & much[self.v]
        home = (two % np.uint64(shards)).astype(np.int64)
        apart = home[parent]
        split = np.flatnonzero(both[parent])
        apart[split] = (W.mix(two[parent[split]] ^ lone[w[split]]) % np.uint64(shards)).astype(np.int64)
        split = split[apart[split] != home[parent[split]]]
        nodes = np.sort(np.concatenate([home << 32 | np.arange(len(pairs)), np.unique(apart[split] << 32 | parent[split])]))
        self.node_shard, self.node_pair = nodes >> 32, nodes & 0xFFFFFFFF
        self.at_home = home[self.node_pair] == self.node_shard
        node_of = np.empty(len(pairs), np.int64)
        node_of[self.node_pair[self.at_home]] = np.flatnonzero(self.at_home)
        of_node = node_of[parent]
        of_node[split] = np.searchsorted(nodes, apart[split] << 32 | parent[split])
        order = np.argsort(apart.astype(np.uint16) if shards <= 1 << 16 else apart, kind="stable")
        self.triple_shard, self.triple_w, self.triple_node, self.triple_count = apart[order], w[order], of_node[order], len(triples)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.triple = np.full(len(number), -1)
        self.triple[self.has_triple] = place[of_triple]
        self.new_word = np.ones(len(nodes), bool)
        self.new_word[1:] = (self.u[self.node_pair[1:]] != self.u[self.node_pair[:-1]]) | (self.node_shard[1:] != self.node_shard[:-1])


def _deal(shards: int, heavy):
    """Rows for shards (part >= 0: words, nodes of each, triples of each, training counts) and, with part -1, the block's documents."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for count, (ids, train, tokens, bounds) in enumerate(_blocks(batches)):
            block = (task << 24) + count
            words, number = np.unique(tokens, return_inverse=True)
            g = _Grams(words, number, bounds, shards, heavy)
            learn = np.repeat(np.array(train, bool), np.diff(bounds))
            of_pair = np.bincount(g.pair[learn & (g.pair >= 0)], minlength=len(g.u))
            of_node = np.where(g.at_home, of_pair[g.node_pair], 0).astype(np.uint32)
            of_triple = np.bincount(g.triple[learn & (g.triple >= 0)], minlength=g.triple_count).astype(np.uint32)
            each = np.bincount(g.triple_node, minlength=len(g.node_pair)).astype(np.uint32)
            known = np.array([x is not None for x in ids])
            skeleton = _pack(np.array([x or 0 for x in ids], np.int64), known, np.array(train, bool), np.diff(bounds), number.astype(np.uint32))
            rows = [(-1 - block, block, -1, skeleton)]
            ranks = np.arange(shards + 1)
            edges, ends = np.searchsorted(g.node_shard, ranks), np.searchsorted(g.triple_shard, ranks)
            seconds, thirds = (words[g.v[g.node_pair]] >> _SECOND).astype(np.uint32), (words[g.triple_w] >> _THIRD).astype(np.uint32)
            for k in np.flatnonzero(np.diff(edges)):
                a, b, c, d = edges[k], edges[k + 1], ends[k], ends[k + 1]
                at = np.flatnonzero(g.new_word[a:b])
                blob = _pack(words[g.u[g.node_pair[a:b][at]]], np.diff(at, append=b - a).astype(np.uint32), seconds[a:b], of_node[a:b], each[a:b], thirds[c:d], of_triple[c:d])
                rows.append((int(k), block, int(k), blob))
            for i in range(0, len(rows), 256):
                part = rows[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "block", "part", "blob"])

    return job


def _build(got: list[list[np.ndarray]], n: int) -> Trie:
    """The trie of a shard from its blocks' words, nodes, triples and training counts."""

    def coded(count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, np.rint(-np.log10(np.maximum(count, 1) / (n + 1)) * UNIT), UNSEEN).astype(np.uint16)

    words = np.unique(np.concatenate([g[0] for g in got]))
    keys = [np.repeat(np.searchsorted(words, w).astype(np.uint64), k) << np.uint64(SECOND_BITS) | second for w, k, second, *_ in got]
    pairs, seen = _sums(np.concatenate(keys), np.concatenate([g[3] for g in got]).astype(np.int64))
    deep = [np.repeat(np.searchsorted(pairs, key).astype(np.uint64), g[4]) << np.uint64(THIRD_BITS) | g[5] for key, g in zip(keys, got, strict=True)]
    triples, learnt = _sums(np.concatenate(deep), np.concatenate([g[6] for g in got]).astype(np.int64))
    triples, learnt = triples[learnt > 0], learnt[learnt > 0]
    each = np.bincount((triples >> np.uint64(THIRD_BITS)).astype(np.int64), minlength=len(pairs))
    keep = (seen > 0) | (each > 0)
    pairs, seen, each = pairs[keep], seen[keep], each[keep]
    of_word = (pairs >> np.uint64(SECOND_BITS)).astype(np.int64)
    many, counts = np.bincount(of_word, minlength=len(words)), np.bincount(of_word, seen, len(words)).astype(np.int64)
    some = many > 0
    seconds = Level(many[some], pairs & np.uint64((1 << SECOND_BITS) - 1), coded(seen), SECOND_BITS)
    thirds = Level(each, triples & np.uint64((1 << THIRD_BITS) - 1), coded(learnt), THIRD_BITS)
    return Trie(words[some], counts[some], [seconds, thirds])


def _answer(n: int):
    """A shard's rows become answers: each word with its count, each node's and each triple's code. Documents pass through."""

    def at(values: np.ndarray, i: np.ndarray, none: int) -> np.ndarray:
        out = np.full(len(i), none, values.dtype)
        out[i >= 0] = values[i[i >= 0]]
        return out

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return rows[["block", "part", "blob"]]
        got = [_unpack(b) for b in rows["blob"]]
        trie = _build(got, n)
        blobs = []
        for w, k, second, _, each, third, _ in got:
            word = trie.find_words(w)
            pair = trie.levels[0].find(np.repeat(word, k), second)
            triple = trie.levels[1].find(np.repeat(pair, each), third)
            blobs.append(_pack(w, at(trie.counts, word, 0), at(trie.levels[0].codes, pair, UNSEEN), at(trie.levels[1].codes, triple, UNSEEN)))
        del got, trie
        W.release()
        return pd.DataFrame({"block": rows["block"], "part": rows["part"], "blob": blobs})

    return job


def _gather(n: int, shards: int, heavy):
    """A block's documents with their log10 probabilities under every pair of strengths, and the leave-one-out sums of them all."""
    count_of = np.rint(10.0 ** (-np.arange(UNSEEN + 1) / UNIT) * (n + 1))
    count_of[UNSEEN] = 0

    def under(c1, cv, c2, cuv, c3) -> Iterator[np.ndarray]:
        """log10 p of tokens under every pair of strengths; where no pair stands before a token, cuv and c3 are 0 and p is that of the word before."""
        one = np.maximum(c1, 1) / (n + 1)
        for k in GRID:
            s = k * np.sqrt(1 + cv)
            two = (c2 + s * one) / (cv + s)
            for m in GRID:
                t = m * np.sqrt(1 + cuv)
                yield np.log10((c3 + t * two) / (cuv + t))

    def job(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        ids, known, train, sizes, number = _unpack(rows["blob"].iloc[0])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        number = number.astype(np.int64)
        got = [_unpack(b) for b in rows["blob"].iloc[1:]]
        words = np.unique(np.concatenate([START, END, *(x[0] for x in got)]))  # every word but the end stands before another
        g = _Grams(words, number, bounds, shards, heavy[0])
        counts = np.zeros(len(words), np.int64)
        counts[g.u[g.node_pair[g.new_word]]] = np.concatenate([x[1] for x in got])
        much = np.isin(words, heavy[0])
        counts[much] = heavy[1][np.searchsorted(heavy[0], words[much])]
        of_pair = np.zeros(len(g.u))
        of_pair[g.node_pair[g.at_home]] = count_of[np.concatenate([x[2] for x in got])[g.at_home]]
        of_triple = count_of[np.concatenate([x[3] for x in got])]
        at = g.has_pair
        deep = g.triple[at] >= 0
        c1, cv, c2 = counts[number[at]].astype(float), counts[number[at - 1]].astype(float), of_pair[g.pair[at]]
        c2 = np.minimum(c2, np.minimum(c1, cv))  # a rounded count is never above what it is a part of
        cuv = np.where(deep, np.minimum(of_pair[g.pair[at - 1]], cv), 0)
        c3 = np.where(deep, np.minimum(np.append(of_triple, 0)[g.triple[at]], np.minimum(c2, cuv)), 0)
        starts = bounds[:-1] - np.arange(len(ids))  # without the texts' starts
        scores = np.stack([np.add.reduceat(x, starts) for x in under(c1, cv, c2, cuv, c3)], axis=1)
        own = np.repeat(train, sizes - 1)
        less = [np.maximum(x[own] - 1, 0) for x in (c1, cv, c2, cuv, c3)]
        gains = [float(x.sum()) for x in under(*less)]
        return pd.DataFrame({
            "doc_id": pd.array([int(i) if k else None for i, k in zip(ids, known, strict=True)], "Int64"),
            "train": train, "n_tokens": sizes - 1, "n_known": np.add.reduceat((c1 > 0).astype(np.int64), starts),
            "log_counts": np.add.reduceat(np.log10(c1 + 1.0), starts), "scores": list(scores), "gains": [gains, *[None] * (len(ids) - 1)],
        })

    return job


def score(docs: DataFrame, train, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, log_counts, score, n, v, second, third): log_counts sums log10(c + 1), score log10 p.

    n, v are the model's totals, second and third the k of its strengths. train: Column, whether a row is learnt from.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    shard_bits = min(18, max(6, (docs.select("doc_id").count() // 4096).bit_length()))
    counted = durable(_count(docs, shard_bits), "counted")
    total = counted.agg(F.sum("v").alias("v"), F.sum("n").alias("n"), F.sum("ends").alias("ends")).first()
    n, v, ends = total["n"] or 0, total["v"] or 0, total["ends"] or 0
    heavy = _heavy(counted, n, ends)
    shards = max(8, -(-n // SHARD_TOKENS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.mapInArrow(_deal(shards, heavy[0]), "key long, block long, part long, blob binary")
    answered = dealt.groupBy("key").applyInPandas(_answer(n), "block long, part long, blob binary")
    columns = "doc_id long, train boolean, n_tokens long, n_known long, log_counts double, scores array<double>, gains array<double>"
    scored = durable(answered.groupBy("block").applyInPandas(_gather(n, shards, heavy), columns), "scored")
    gains = scored.where("gains is not null").select(F.posexplode("gains").alias("k", "gain")).groupBy("k").agg(F.sum("gain").alias("gain"))
    best = gains.agg(F.max_by("k", F.struct("gain", "k"))).first()[0] or 0  # of len(GRID) squared sums
    told = {"score": F.col("scores")[best], "n": F.lit(n).cast("long"), "v": F.lit(v).cast("long"), "second": F.lit(GRID[best // len(GRID)]), "third": F.lit(GRID[best % len(GRID)])}
    return scored.withColumns(told).drop("scores", "gains")
