"""Quality as logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader.

Here a word is a run of letters, digits and bytes above 0x7F, or a run of other visible bytes, so
that marks stuck to words count by themselves; A-Z count as a-z. Features are words and pairs of
neighbours (a word after itself, and a word that comes again after one other, are one feature each
whatever the word), hashed into 2^BITS slots, each with its count over the root of the number of words: a
score is a sparse dot product, one lookup and add per feature. Fitted on the driver on a bounded
sample of labelled rows (SAMPLE rows of at most SAMPLE_BYTES bytes); scored where the texts are.

Rows: null and empty texts get the score of the intercept; rows without a label are never learnt
from; repeated rows score alike; an empty table gives an empty table; other columns are kept, and
an existing column named score is replaced. Without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandfold.llm import words as W
from strandfold.llm.sampling import labelled_sample

BITS = 18
SAMPLE, SAMPLE_BYTES = 6000, 1 << 15
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01

AGAIN = W.mix(np.array([101, 102], np.uint64))

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _KIND[_low : _high + 1] = 1


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, n + 1 bounds of the texts among them, each text's factor 1 / root of its words)."""
    kind = _KIND[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(change)
    ends = np.append(at[1:], len(body))
    visible = kind[at] > 0
    starts, ends = at[visible], ends[visible]
    # Codes sum the bytes up to the next start, so all pieces, also blank ones, are coded and the blank ones dropped.
    code = W.codes(body, at, np.append(at[1:], len(body)))[visible] if len(at) else W.EMPTY
    bounds = np.searchsorted(starts, offsets)
    n = np.diff(bounds)
    first = np.zeros(len(code), bool)
    first[bounds[:-1][n > 0]] = True
    pair = np.zeros_like(code)
    pair[1:] = np.where(code[1:] == code[:-1], AGAIN[0], W.mix(code[:-1] * np.uint64(3) + W.mix(code[1:])))
    back = np.zeros(len(code), bool)
    back[2:] = (code[2:] == code[:-2]) & ~first[1:-1] & ~first[2:] & (code[2:] != code[1:-1])
    slots = np.full(3 * len(code), 1 << BITS)  # the slot past the end has no weight
    slots[0::3] = (code >> np.uint64(64 - BITS)).astype(np.int64)
    slots[1::3][~first] = (pair[~first] >> np.uint64(64 - BITS)).astype(np.int64)
    slots[2::3][back] = int(AGAIN[1] >> np.uint64(64 - BITS))
    return slots, 3 * bounds, 1 / np.sqrt(np.maximum(n, 1))


def fit(texts: pa.Array, labels: list[int]) -> np.ndarray:
    """Weights of all slots, one of 0, and last the intercept."""
    size = (1 << BITS) + 2
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        return -np.where(np.abs(z[at]) > L1, z[at] - np.sign(z[at]) * L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    rows = []
    body, offsets = W.raw(texts)
    for lo, hi in W.chunks(offsets):
        slots, bounds, factor = features(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for i in range(hi - lo):
            at, counts = np.unique(slots[bounds[i] : bounds[i + 1]], return_counts=True)
            seen = at < 1 << BITS
            rows.append((np.append(at[seen], size - 1), np.append(counts[seen] * factor[i], 1.0), labels[lo + i]))
    for _ in range(EPOCHS):
        for at, x, y in rows:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    out = weights(np.arange(size))
    out[1 << BITS] = 0
    return out


def train(docs: DataFrame, label, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    texts, labels = labelled_sample(docs, label, most, most_bytes)
    return fit(texts, [int(x > 0) for x in labels])


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of label 1. The broadcast weights have a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() != name] + [T.StructField(name, T.DoubleType())])
    kept = schema.names[:-1]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            body, offsets = W.raw(W.as_strings(batch.column(text)))
            out = np.full(batch.num_rows, w[-1])
            for lo, hi in W.chunks(offsets):
                slots, bounds, factor = features(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                some = np.flatnonzero(np.diff(bounds))
                if len(some):
                    out[lo + some] += np.add.reduceat(w[slots], bounds[:-1][some]) * factor[some]
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(p)], names=schema.names)

    return docs.mapInArrow(job, schema)
