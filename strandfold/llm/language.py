"""Language of documents by a bidirectional gated recurrent network over bytes, in numpy.

Every whole text is read in windows of WINDOW bytes, one after another, over words and blanks alike;
the last one is filled up with blanks. The network reads a window from both ends and gives each of
its positions a distribution over the languages. A document's log probability of a language is the
sum over all its letter positions (ASCII letters and bytes above 0x7F), divided by POOL since
neighbours say much the same, over that of all languages.

Trained on the driver by backpropagation through time (Adam) on a bounded sample: SAMPLE texts of at
most SAMPLE_BYTES bytes each, equally many windows of each language.

Rows: `und` with score 0 if the text is null or holds no letter; otherwise one of the learnt values;
ties go to the first in code point order; repeated rows are alike; texts of any length are read
whole; an empty table gives an empty table; other columns are kept, existing ones of the two
output names are replaced. Without any labelled row every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandfold.llm import words as W
from strandfold.llm.sampling import labelled_sample

WINDOW = 64
HIDDEN = 16
POOL = 16.0
SAMPLE, SAMPLE_BYTES = 3000, 1 << 14
WINDOWS_EACH = 2000
BATCH, EPOCHS, RATE = 64, 3, 0.01
CHUNK_BYTES = 1 << 20
ROWS = 2048  # windows read in step
BLANK = 0x20

_LETTER = np.zeros(256, bool)
for _low, _high in ((65, 90), (97, 122), (128, 255)):
    _LETTER[_low : _high + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ANY_LETTER = regex.compile(r"\p{L}").search


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, n + 1 bounds of the texts among them) of texts between offsets."""
    parts = -(-np.diff(offsets) // WINDOW)
    bounds = np.concatenate([[0], np.cumsum(parts)])
    owner = np.repeat(np.arange(len(parts)), parts)
    starts = offsets[owner] + (np.arange(len(owner)) - bounds[owner]) * WINDOW
    return starts, np.minimum(starts + WINDOW, offsets[owner + 1]), bounds


def read(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """n x WINDOW bytes, A-Z as a-z, blanks after the end."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], _FOLD[body[np.minimum(at, len(body) - 1)]], BLANK).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


class Network:
    """Parameters by name: for direction d, x_d (bytes to 3 gates), u_d (state to 3 gates), o_d (state to languages); b."""

    def __init__(self, languages: list[str], seed: int = 5, hidden: int = HIDDEN):
        self.languages, self.hidden = languages, hidden
        rng, h = np.random.default_rng(seed), hidden
        self.p = {"b": np.zeros(len(languages), np.float32)}
        for d in "fb":
            self.p |= {f"x_{d}": rng.normal(0, 0.3, (256, 3 * h)), f"u_{d}": rng.normal(0, 0.3, (h, 3 * h)), f"o_{d}": rng.normal(0, 0.3, (h, len(languages)))}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, data: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each position, L x n x H. data: n x L bytes in the direction's order."""
        h, (n, length), (x, u) = self.hidden, data.shape, (self.p[f"x_{d}"], self.p[f"u_{d}"])
        x_gates, x_new, u_gates, u_new = (np.ascontiguousarray(part) for w in (x, u) for part in (w[:, : 2 * h], w[:, 2 * h :]))
        seen = np.ascontiguousarray(data.T).astype(np.intp)
        state, out = np.zeros((n, h), x.dtype), np.empty((length, n, h), x.dtype)
        for t in range(length):
            gates = x_gates.take(seen[t], axis=0)
            gates += state @ u_gates
            _sigmoid(gates)
            z, r = gates[:, :h], gates[:, h:]
            c = x_new.take(seen[t], axis=0)
            c += (r * state) @ u_new
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((state, z, r, c))
            np.add(state, z * (c - state), out=out[t])
            state = out[t]
        return out

    def log_probabilities(self, data: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """n x L x languages, of n windows of L bytes each."""
        f = self._run(data, "f", kept["f"] if kept is not None else None)
        b = self._run(data[:, ::-1], "b", kept["b"] if kept is not None else None)[::-1]
        if kept is not None:
            kept["states"] = {"f": f.transpose(1, 0, 2), "b": b.transpose(1, 0, 2)}
        logits = (f.reshape(-1, self.hidden) @ self.p["o_f"]).reshape(*f.shape[:2], -1)
        logits += (b.reshape(-1, self.hidden) @ self.p["o_b"]).reshape(logits.shape)
        logits += self.p["b"]
        # A softmax in place; outputs are sums of bounded states, so they need no shift.
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return logits.transpose(1, 0, 2)

    def gradients(self, data: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions."""
        h, (n, length), kept = self.hidden, data.shape, {"f": [], "b": []}
        off = np.exp(self.log_probabilities(data, kept))
        off[np.arange(n), :, label] -= 1
        off /= n * length
        out = {"b": off.sum(axis=(0, 1))}
        for d, order in (("f", slice(None)), ("b", slice(None, None, -1))):
            states, grad, seen = kept["states"][d], off[:, order], data[:, order]
            out[f"o_{d}"] = np.einsum("nth,ntl->hl", states, off)
            dx, du, u = np.zeros_like(self.p[f"x_{d}"]), np.zeros_like(self.p[f"u_{d}"]), self.p[f"u_{d}"]
            back, gates = np.zeros((n, h), np.float32), np.empty((n, length, 3 * h), dx.dtype)
            for t in range(length - 1, -1, -1):
                before, z, r, c = kept[d][t]
                back = back + grad[:, t] @ self.p[f"o_{d}"].T
                dc = back * z * (1 - c * c)
                dz = back * (c - before) * z * (1 - z)
                through = dc @ u[:, 2 * h :].T
                dr = through * before * r * (1 - r)
                gate = np.concatenate([dz, dr, dc], axis=1)
                gates[:, t] = gate
                du[:, : 2 * h] += before.T @ gate[:, : 2 * h]
                du[:, 2 * h :] += (r * before).T @ dc
                back = back * (1 - z) + through * r + gate[:, : 2 * h] @ u[:, : 2 * h].T
            order = np.argsort(seen, axis=None, kind="stable")
            byte, first = np.unique(seen.ravel()[order], return_index=True)
            dx[byte] = np.add.reduceat(gates.reshape(-1, 3 * h)[order], first)
            out[f"x_{d}"], out[f"u_{d}"] = dx, du
        return out

    def pooled(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each window the sum of the log probabilities over its letters, n x languages."""
        out = np.zeros((len(starts), len(self.languages)))
        for i in range(0, len(starts), ROWS):
            data = read(body, starts[i : i + ROWS], ends[i : i + ROWS])
            out[i : i + ROWS] = np.einsum("nt,ntl->nl", _LETTER[data].astype(np.float32), self.log_probabilities(data))
        return out


def fit(texts: pa.Array, labels: list[str], seed: int = 9, hidden: int = HIDDEN) -> Network | None:
    """The trained network, or None without rows."""
    if not len(texts):
        return None
    rng, net = np.random.default_rng(seed), Network(sorted(set(labels)), hidden=hidden)
    body, offsets = W.raw(texts)
    starts, ends, bounds = windows(offsets)
    label = np.repeat([net.languages.index(x) for x in labels], np.diff(bounds))
    lettered = np.add.reduceat(_LETTER[body].astype(np.int64), starts) > 0 if len(starts) else np.empty(0, bool)
    # Equally many windows of each language: rarer ones are drawn more often.
    pool = [np.flatnonzero((label == k) & lettered) for k in range(len(net.languages))]
    picked = np.concatenate([rng.choice(x, WINDOWS_EACH) for x in pool if len(x)]) if any(map(len, pool)) else np.empty(0, int)
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(picked)
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            step += 1
            rate = RATE * (0.3**epoch)
            for name, g in net.gradients(read(body, starts[rows], ends[rows]), label[rows]).items():
                m[name] += 0.1 * (g - m[name])
                v[name] += 0.01 * (g * g - v[name])
                net.p[name] -= (rate * m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, label, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Network | None:
    return fit(*labelled_sample(docs, label, most, most_bytes))


def cross_validated(texts: pa.Array, labels: list[str], fold: np.ndarray, hidden: int = HIDDEN) -> tuple[int, float]:
    """(rows told rightly, sum of log10 probabilities of their languages) of all rows, each by a network fitted without its fold."""
    right, gain = 0, 0.0
    for k in np.unique(fold):
        rest, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        net = fit(texts.take(pa.array(rest)), [labels[i] for i in rest], hidden=hidden)
        if net is None:
            continue
        sums = _sums(net, *W.raw(texts.take(pa.array(out)))) / POOL
        p = np.exp(sums - sums.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for row, i in zip(p, out, strict=True):
            known = labels[i] in net.languages
            right += int(net.languages[row.argmax()] == labels[i])
            gain += float(np.log10(max(row[net.languages.index(labels[i])], 1e-12))) if known else -12.0
    return right, gain


def predict(docs: DataFrame, net: Network | None, text: str = "text", name: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns lang_pred and score. The broadcast network has a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = (name.lower(), score.lower())
    schema = T.StructType([f for f in docs.schema.fields if f.name.lower() not in names] + [T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    kept = schema.names[:-2]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = W.as_strings(batch.column(text))
            body, offsets = W.raw(texts)
            for lo, hi in W.chunks(offsets, CHUNK_BYTES):
                langs, scores = ["und"] * (hi - lo), np.zeros(hi - lo)
                if net is not None:
                    sums = _sums(net, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) / POOL
                    p = np.exp(sums - sums.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1)
                    for i, t in enumerate(texts[lo:hi].to_pylist()):
                        if _ANY_LETTER(t):
                            langs[i], scores[i] = net.languages[best[i]], p[i, best[i]]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in kept), pa.array(langs), pa.array(scores)], names=schema.names)
        W.release()

    return docs.mapInArrow(job, schema)


def _sums(net: Network, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the sum over its windows."""
    out = np.zeros((len(offsets) - 1, len(net.languages)))
    starts, ends, bounds = windows(offsets)
    if len(starts):
        some = np.flatnonzero(np.diff(bounds))
        out[some] = np.add.reduceat(net.pooled(body, starts, ends), bounds[:-1][some], axis=0)
    return out
