"""Toxicity by votes of the nearest labelled examples under exact TF-IDF cosine.

Examples are a bounded sample of labelled rows (SAMPLE rows of at most SAMPLE_BYTES bytes); rows of one
label whose least LEAST_SHINGLES shingles are equal are copies and vote once. Terms are all words of
letters, digits and bytes above 0x7F (A-Z as a-z) that any example holds; none is left out. A term weighs
(1 + log tf) * idf * rf^POWER: idf from document frequencies counted over all documents, and rf, the
relevance frequency log2(2 + a / max(1, c)) of its a examples of label 1 and c others, which is at least 1. The
index is inverted and cut into blocks of BLOCK examples, like ones (by the nearest of PIVOTS examples)
side by side; each term holds its greatest weight in every block that it comes in. A query reads the
FIRST blocks of greatest upper bound, then only those whose bound is not below its k-th best cosine so
far, so the K neighbours are exact. Their votes are weighted by cosine; an isotonic fit turns the share of
votes into a probability, by the votes that each of PARTS parts of the examples gets from an index of the
others. The neighbours are returned as evidence, by the doc_id of the example.

Rows: null and empty texts, and texts without any of the terms, have no neighbours and get the share
of label 1 among such examples; ties between neighbours go to the example that comes first; repeated
rows are alike; texts of any length are read whole; an empty table gives an empty table; other
columns are kept, existing ones of the two output names are replaced. Without labelled rows every
score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandfold.llm import words as W
from strandfold.llm.quality import _KIND
from strandfold.llm.sampling import folds, labelled_rows

SAMPLE, SAMPLE_BYTES = 4000, 1 << 14
BLOCK, FIRST, PIVOTS, K = 64, 4, 32, 15
LEAST_SHINGLES = 4
PARTS = 4  # for calibration
POWER = 2.0  # of the relevance frequency, chosen by cross-validation on learnt rows (validate.py)
ROWS = 1024  # scored at a time
NONE = np.empty(0, np.int64)


def terms(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words of letters, n + 1 bounds of the texts among them)."""
    letter = _KIND[body] == 1
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= letter[1:] != letter[:-1]
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(body))
    keep = letter[at]
    code = W.codes(body, at, ends)[keep] if len(at) else W.EMPTY
    return code, np.searchsorted(at[keep], offsets)


def _counted(texts: pa.Array, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunk by chunk: (number of texts, numbers of their known terms, counts, n + 1 bounds of the texts among them); known: sorted codes."""
    body, offsets = W.raw(texts)
    for lo, hi in W.chunks(offsets):
        code, bounds = terms(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
        hit = np.flatnonzero(known[at] == code) if len(known) else NONE
        owner = np.repeat(np.arange(hi - lo, dtype=np.int64), np.diff(bounds))[hit]
        key, counts = np.unique(owner << 32 | at[hit], return_counts=True)
        yield hi - lo, key & 0xFFFFFFFF, counts, np.searchsorted(key >> 32, np.arange(hi - lo + 1))


def _bags(texts: pa.Array, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's (numbers of known terms, counts)."""
    for n, numbers, counts, bounds in _counted(texts, known):
        for a, b in zip(bounds[:n].tolist(), bounds[1:].tolist(), strict=True):
            yield numbers[a:b], counts[a:b]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after another, and the ranges' sizes."""
    sizes = end - start
    return np.arange(sizes.sum()) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes), sizes


class Index:
    """Block-max inverted index of unit vectors.

    Term t has entries edge[t] to edge[t + 1], one for each block it comes in: block, its greatest weight
    there (most) and where its postings (place of an example, weight) begin.
    """

    def __init__(self, known: np.ndarray, factor: np.ndarray, bags: list, labels: np.ndarray, ids: list | None = None):
        self.known, self.factor, self.labels = known, factor, labels
        self.ids = list(range(len(bags))) if ids is None else ids
        self.n = len(bags)
        self.blocks = -(-max(self.n, 1) // BLOCK)
        self.vectors = [self.vector(*bag) for bag in bags]
        own = np.repeat(np.arange(self.n), [len(v[0]) for v in self.vectors])
        term = np.concatenate([NONE, *[v[0] for v in self.vectors]])
        weight = np.concatenate([np.empty(0), *[v[1] for v in self.vectors]])
        #: The example at each place and the place of each example.
        self.example = self._order(own, term, weight)
        self.place_of = np.empty(self.n, np.int64)
        self.place_of[self.example] = np.arange(self.n)
        place = self.place_of[own]
        order = np.lexsort((place, term))
        self.place, self.weight, term = place[order].astype(np.int32), weight[order], term[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (self.place[1:] // BLOCK != self.place[:-1] // BLOCK)
        begin = np.flatnonzero(new)
        self.start = np.append(begin, len(term))
        self.block = (self.place[begin] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, begin) if len(begin) else np.empty(0)
        self.edge = np.searchsorted(term[begin], np.arange(len(known) + 1))
        self.steps, self.shares, self.empty = np.zeros(1), np.zeros(1), 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "vectors"}  # the postings tell them

    def _order(self, own: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The examples so that those nearest to one pivot are side by side."""
        best, nearest = np.zeros(self.n), np.full(self.n, -1)
        for k, pivot in enumerate(np.unique(np.linspace(0, self.n - 1, PIVOTS).astype(int)) if self.n else NONE):
            dense = np.zeros(len(self.known))
            dense[self.vectors[pivot][0]] = self.vectors[pivot][1]
            cosine = np.bincount(own, dense[term] * weight, self.n)
            nearer = cosine > best
            best[nearer], nearest[nearer] = cosine[nearer], k
        return np.argsort(nearest, kind="stable")

    def vector(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(np.maximum(counts, 1))) * self.factor[numbers]
        norm = np.sqrt((w * w).sum())
        return (numbers, w / norm) if norm > 0 else (numbers[:0], w[:0])

    def nearest(self, numbers: np.ndarray, weights: np.ndarray, k: int = K, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0, best first, and their cosines."""
        entries, sizes = _ranges(self.edge[numbers], self.edge[numbers + 1])
        weights, block = np.repeat(weights, sizes), self.block[entries]
        bounds = np.bincount(block, self.most[entries] * weights, self.blocks)
        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bounds, kind="stable")[:FIRST]] = True
        ids, cosines = self._best(self._sums(entries, weights, first[block], without), k)
        least = cosines[-1] - 1e-12 if len(cosines) == k else 0.0
        rest = ~first & (bounds > 0) & (bounds >= least)
        if rest.any():
            more, also = self._best(self._sums(entries, weights, rest[block], without), k)
            ids, cosines = np.append(ids, more), np.append(cosines, also)
            order = np.lexsort((ids, -cosines))[:k]
            ids, cosines = ids[order], cosines[order]
        return ids, cosines

    def _sums(self, entries: np.ndarray, weights: np.ndarray, read: np.ndarray, without: int) -> np.ndarray:
        """Cosines by place with the examples of some entries' blocks, 0 for the others."""
        entries = entries[read]
        postings, sizes = _ranges(self.start[entries], self.start[entries + 1])
        out = np.bincount(self.place[postings], self.weight[postings] * np.repeat(weights[read], sizes), self.n)
        if without >= 0:
            out[self.place_of[without]] = 0
        return out

    def _best(self, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(cosines)
        if len(some) > k:
            some = some[cosines[some] >= np.partition(cosines[some], -k)[-k]]
        ids = self.example[some]
        order = np.lexsort((ids, -cosines[some]))[:k]
        return ids[order], cosines[some[order]]

    def share(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        """Label 1's part of the votes, one vote of the base rate added."""
        return float((cosines @ self.labels[ids] + self.labels.mean()) / (cosines.sum() + 1))

    def calibrate(self, votes: np.ndarray) -> None:
        """Isotonic regression of the labels on shares of votes told without the example itself: pool adjacent violators."""
        lone = np.array([len(v[0]) == 0 for v in self.vectors], bool)
        self.empty = float((self.labels[lone].sum() + 0.5 * self.labels.mean()) / (lone.sum() + 0.5))
        some = np.flatnonzero(~lone)
        if not len(some):
            return
        shares = votes[some]
        pools: list[list[float]] = []  # sum of labels, rows, least share
        for s, y in sorted(zip(shares.tolist(), self.labels[some].tolist(), strict=True)):
            pools.append([y, 1, s])
            while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                y1, n1, _ = pools.pop()
                pools[-1][0] += y1
                pools[-1][1] += n1
        self.steps = np.array([p[2] for p in pools])
        self.shares = np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])

    def probability(self, share: float) -> float:
        return float(np.interp(share, self.steps, self.shares))

    def score(self, bag: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        """(probability, neighbours, cosines) of a text's terms and counts."""
        numbers, weights = self.vector(*bag)
        if not len(numbers):
            return self.empty, NONE, np.empty(0)
        ids, cosines = self.nearest(numbers, weights)
        return self.probability(self.share(ids, cosines)), ids, cosines


def _distinct(texts: pa.Array, labels: list) -> list[int]:
    """Rows but those whose least shingles and label are those of an earlier row; rows without words all stay, since their share of label 1 is what such texts score."""
    seen: set[tuple] = set()
    out = []
    i = 0
    for _, _, codes, bounds in W.word_codes(texts):
        for s in W.shingle_sets(codes, bounds):
            key = (labels[i] > 0, s[:LEAST_SHINGLES].tobytes())
            if not len(s) or key not in seen:
                out.append(i)
            seen.add(key)
            i += 1
    return out


def relevance(bags: list, labels: np.ndarray, n: int, power: float = POWER) -> np.ndarray:
    """log2(2 + a / max(1, c)) ** power of each of n terms: a examples of label 1 and c others hold it."""
    held = [np.bincount(np.concatenate([NONE, *[b[0] for b, y in zip(bags, labels, strict=True) if (y > 0) == one]]), minlength=n) for one in (True, False)]
    return np.log2(2 + held[0] / np.maximum(1, held[1])) ** power


def _frequencies(docs: DataFrame, known: np.ndarray, text: str) -> tuple[np.ndarray, int]:
    """In how many of all documents each known term comes, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sums = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            for n, numbers, _, _ in _counted(W.as_strings(batch.column(0)), known):
                sums[0] += n
                sums[1:] += np.bincount(numbers, minlength=len(known))
        some = np.flatnonzero(sums)
        W.release()
        yield pa.RecordBatch.from_arrays([pa.array(some - 1), pa.array(sums[some])], names=["term", "n"])

    out = np.zeros(len(known) + 1, np.int64)
    # Two numbers for each term of the examples come to the driver, so at most SAMPLE * SAMPLE_BYTES terms.
    got = docs.select(text).mapInArrow(job, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[got["term"].to_numpy() + 1] = got["n"].to_numpy()
    return out[1:], int(out[0])


def train(labelled: DataFrame, label, docs: DataFrame, text: str = "text", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Index | None:
    """labelled: rows with doc_id and text to learn from; docs: all documents, for the document frequencies."""
    rows = labelled_rows(labelled, label, most, most_bytes, text=text)
    if not len(rows):
        return None
    texts, labels = pa.array(rows["text"].tolist(), pa.large_string()), rows["label"].tolist()
    keep = _distinct(texts, labels)
    texts, y, ids = texts.take(pa.array(keep)), np.array([float(labels[i] > 0) for i in keep]), [rows["doc_id"].iloc[i] for i in keep]
    body, offsets = W.raw(texts)
    del rows
    found = [np.unique(terms(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0]) for lo, hi in W.chunks(offsets)]
    known = np.unique(np.concatenate(found))
    del found
    frequencies, n = _frequencies(docs, known, text)
    bags, part = list(_bags(texts, known)), folds(texts, PARTS, 1)
    del texts, body, offsets
    return _fitted(known, frequencies, n, bags, y, part, ids)


def _part(n: int, bags: list, rows: np.ndarray) -> tuple[np.ndarray, list]:
    """(of n terms those that some of the rows hold, all bags with numbers among those and without other terms)."""
    has = np.unique(np.concatenate([NONE, *[bags[i][0] for i in rows]]))
    place = np.full(n, -1)
    place[has] = np.arange(len(has))
    return has, [(place[t][place[t] >= 0], c[place[t] >= 0]) for t, c in bags]


def _fitted(known: np.ndarray, frequencies: np.ndarray, n: int, bags: list, y: np.ndarray, part: np.ndarray, ids: list | None = None, weigh=relevance) -> Index:
    """The index of examples, calibrated by the votes that the examples of the other parts give each one; weigh: factors of terms beside idf.

    The relevance of a term is learnt from labels, so the votes must come from an index that has not seen the example's own.
    """
    idf = np.log((n + 1) / (frequencies + 1)) + 1
    votes = np.full(len(y), y.mean())
    for k in np.unique(part):
        rest, out = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if not len(rest):
            continue
        has, among = _part(len(known), bags, rest)
        some = [among[i] for i in rest]
        index = Index(known[has], idf[has] * weigh(some, y[rest], len(has)), some, y[rest])
        votes[out] = [index.share(*index.nearest(*index.vector(*among[i]))) for i in out]
    index = Index(known, idf * weigh(bags, y, len(known)), bags, y, ids)
    index.calibrate(votes)
    return index


def cross_validated(texts: pa.Array, labels: list, fold: np.ndarray, docs: DataFrame, weigh=relevance, least: float = 0.7, text: str = "text") -> tuple[int, int, int, int]:
    """(found, label 1, alarms, label 0): rows scored `least` or more of either label, each by an index of the other folds' examples."""
    keep = np.array(_distinct(texts, labels))
    texts, y, fold = texts.take(pa.array(keep)), np.array([float(labels[i] > 0) for i in keep]), fold[keep]
    part = folds(texts, PARTS, 1)
    body, offsets = W.raw(texts)
    known = np.unique(np.concatenate([terms(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[0] for lo, hi in W.chunks(offsets)]))
    frequencies, n = _frequencies(docs, known, text)
    bags = list(_bags(texts, known))
    score = np.zeros(len(y))
    for k in np.unique(fold):
        rest, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        has, among = _part(len(known), bags, rest)
        index = _fitted(known[has], frequencies[has], n, [among[i] for i in rest], y[rest], part[rest], weigh=weigh)
        score[out] = [index.score(among[i])[0] for i in out]
    told = score >= least
    return int(told[y > 0].sum()), int((y > 0).sum()), int(told[y == 0].sum()), int((y == 0).sum())


EVIDENCE = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))


def score(docs: DataFrame, index: Index | None, text: str = "text", name: str = "score", evidence: str = "evidence") -> DataFrame:
    """docs with the columns score and evidence (neighbours: the example's doc_id, label, cosine). The index has a bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    names = (name.lower(), evidence.lower())
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() not in names] + [T.StructField(name, T.DoubleType()), T.StructField(evidence, EVIDENCE)])
    kept = schema.names[:-2]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            if index is None:
                found = [(0.0, NONE, np.empty(0))] * batch.num_rows
            else:
                found = [index.score(bag) for bag in _bags(W.as_strings(batch.column(text)), index.known)]
            near = np.concatenate([NONE, *[f[1] for f in found]])
            ids = pa.array([index.ids[i] for i in near] if index is not None else [], pa.int64())
            labels = pa.array(index.labels[near] if index is not None else [], pa.float64()).cast(pa.int32())
            each = pa.StructArray.from_arrays([ids, labels, pa.array(np.concatenate([np.empty(0), *[f[2] for f in found]]))], names=["doc_id", "label", "cosine"])
            bounds = np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), each)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array([f[0] for f in found], pa.float64()), lists], names=schema.names)
        W.release()

    return docs.mapInArrow(job, schema)
