"""Byte-level BPE as a finite-state transducer, and streaming decoding by a UTF-8 state machine.

A BPE encoding is the one sequence of tokens in which every neighbouring pair encodes to
itself, so the last token of every prefix follows from the last tokens of shorter prefixes.
The transducer reads a piece byte by byte. A state holds the starts from which a longer token
may still come (the rest of the piece is a proper prefix of some token) with the last token
before each; a move tells the last token of the prefix read. Tokens are settled where all open
starts agree on them, at most the longest token's bytes after their end, and are emitted at a
piece's end or every LOOKAHEAD bytes. States and moves are made when first met (lazy
determinisation) and the table starts anew beyond MAX_MOVES, so memory is bounded too. A merge is
taken to rank above the merges that made its parts, as in any trained vocabulary.

Rows: null text counts as empty, an empty text has no tokens, ties and repeated rows are encoded
alike, texts of any length stream through in linear time, other columns are kept (an existing
column with an output's name is replaced), an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandfold.llm import words as W

MAX_MOVES = 400_000
MAX_PIECES = 200_000
LOOKAHEAD = 4096
NEVER = 1 << 60
NO_KIDS: dict[int, int] = {}
CHUNK_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a file with lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Encodes one piece at a time.

    A trie of the tokens with failure links tells the longest start still open (its node) and, through
    the links, all shorter ones. A state is that node with the last token before each open start and
    before the place itself; a move reads a byte and tells the last token of the prefix read so far.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.made_of: dict[int, list[bytes]] = {}
        self.spines: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.fits: dict[int, bool] = {}
        self._trie()
        self._reset()

    def _trie(self) -> None:
        """The nodes that each node's bytes lead to, the token that ends there or -1, the node of the longest proper suffix."""
        self.kids: list[dict[int, int]] = [{}]
        self.ends, depth, order = [-1], [0], []
        for text, t in self.ranks.items():
            node = 0
            for byte in text:
                below = self.kids[node].get(byte)
                if below is None:
                    below = len(self.kids)
                    if not self.kids[node]:
                        self.kids[node] = {}
                    self.kids[node][byte] = below
                    self.kids.append(NO_KIDS)
                    self.ends.append(-1)
                    depth.append(depth[node] + 1)
                node = below
            self.ends[node] = t
        self.shorter, order = [0] * len(self.kids), [0]
        for node in order:
            for byte, below in self.kids[node].items():
                self.shorter[below] = self._below(self.shorter[node], byte) if node else 0
                order.append(below)
        self.depth = depth
        self.open: dict[int, dict[int, int]] = {}
        self.edges: dict[int, tuple[int, list[tuple[int, int]], list[int]]] = {}

    def _below(self, node: int, byte: int) -> int:
        """The longest node that ends in this byte after a suffix of the node."""
        while True:
            below = self.kids[node].get(byte)
            if below is not None or not node:
                return below or 0
            node = self.shorter[node]

    def _open(self, node: int) -> dict[int, int]:
        """How far back the starts lie from which a longer token may come, the furthest first, with their places in a state; 0 is always one."""
        if node not in self.open:
            far, at = [], node
            while at:
                if self.kids[at]:
                    far.append(self.depth[at])
                at = self.shorter[at]
            self.open[node] = {d: k for k, d in enumerate([*far, 0])}
        return self.open[node]

    def _edge(self, node: int, byte: int) -> tuple[int, list[tuple[int, int]], list[int]]:
        """(next node, tokens that may end after the byte, longest first, each with the place of what stands before it, places that stay)."""
        key = node << 8 | byte
        if key not in self.edges:
            below, here = self._below(node, byte), self._open(node)
            ends, at = [], below
            while at:
                t = self.ends[at]
                if t >= 0 and len(self.halves(t)) <= 2:
                    ends.append((t, here[self.depth[at] - 1]))
                at = self.shorter[at]
            self.edges[key] = below, ends, [here[d - 1] for d in self._open(below) if d]
        return self.edges[key]

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.held: list[tuple] = []
        self.moves: dict[int, int] = {}
        self._state((0, -1))

    def forget(self) -> None:
        self.fits.clear()
        self.edges.clear()
        self.open.clear()
        self._reset()

    def _state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.held)
            self.held.append(key)
        return self.states[key]

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: merge the neighbours of least rank, the leftmost first, until at most two are left or none merge. Used on single tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, t: int) -> list[bytes]:
        """The two parts whose merge makes token t, or itself if it is one byte; more parts if no merges make it."""
        if t not in self.made_of:
            self.made_of[t] = self.merged(self.token[t])
        return self.made_of[t]

    def spine(self, t: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of token t while it is made, each with the rank of the merge that takes it up."""
        known = self.spines.get((t, side))
        if known is None:
            known, top, taken = [], t, NEVER
            while True:
                known.append((self.token[t], taken))
                parts = self.halves(t)
                if len(parts) == 1:
                    break
                t, taken = self.ranks[parts[side]], t
            self.spines[top, side] = known
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b side by side stay apart: no merge over their border comes before the merges that take its sides up.

        A merge ranks above the merges that made its sides, so it suffices to look at sides that stand
        there at the same time: the two ends are taken apart, the later merge first.
        """
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            left, right, rank = self.spine(a, -1), self.spine(b, 0), self.ranks.get
            i = j = 0
            while True:
                (x, x_taken), (y, y_taken) = left[i], right[j]
                m = rank(x + y)
                if m is not None and m < x_taken and m <= y_taken:
                    known = False
                    break
                before = left[i + 1][1] if i + 1 < len(left) else -1
                after = right[j + 1][1] if j + 1 < len(right) else -1
                if before < 0 and after < 0:
                    known = True
                    break
                if before > after:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > MAX_MOVES:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        """The next state and, in the low bits, the last token up to here."""
        held = self.held[state]
        below, ends, stay = self._edge(held[0], byte)
        for t, k in ends:
            before = held[k + 1]
            if before < 0 or self._fits(before, t):
                break
        else:
            raise ValueError("the vocabulary can't spell this piece")
        after = self._state((below, *[held[k + 1] for k in stay], t))
        made = self.moves[state << 8 | byte] = after << 20 | t
        return made

    def encode(self, piece: bytes) -> list[int]:
        """The piece's ids."""
        known = self.ranks.get(piece)
        if known is not None:
            return [known]
        if len(self.moves) > MAX_MOVES:
            self._reset()
        if len(piece) > LOOKAHEAD:
            return self._long(piece)
        state, last, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> 20
            last.append(move & 0xFFFFF)
        return self._back(last, len(last))

    def _back(self, last: list[int], at: int) -> list[int]:
        """The tokens up to a place, told by the last token of each prefix."""
        out = []
        while at > 0:
            out.append(last[at - 1])
            at -= self.size[last[at - 1]]
        out.reverse()
        return out

    def _long(self, piece: bytes) -> list[int]:
        """The same with bounded memory: every LOOKAHEAD bytes, what all open starts agree on is emitted."""
        state, last, out = 0, [], []
        for byte in piece:
            move = self.moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            state = move >> 20
            last.append(move & 0xFFFFF)
            if len(last) >= 2 * LOOKAHEAD:
                places = {len(last) - d for d in self._open(self.held[state][0])}
                while len(places) > 1:  # the furthest place steps back by its token until all have met
                    furthest = max(places)
                    places.remove(furthest)
                    places.add(furthest - self.size[last[furthest - 1]])
                at = places.pop()
                out += self._back(last, at)
                last = last[at:]
        return out + self._back(last, len(last))


class Encoder(dict):
    """Pieces and their ids. Beyond MAX_PIECES those not met since the last clearing go."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.split, self.older = Transducer(ranks), regex.compile(pattern).findall, {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        """Drops what was learnt from texts, at the end of a task; the vocabulary's own tables stay."""
        self.clear()
        self.older = {}
        self.transducer.forget()
        W.release()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))


def _utf8_moves() -> dict[str, list[str]]:
    """From each state, the state that each byte leads to. 'ok': between characters; 'bad': no text."""
    tail = {"one": "ok", "two": "one", "three": "two"}
    moves = {s: ["bad"] * 256 for s in ("ok", *tail, "e0", "ed", "f0", "f4")}
    for b in range(256):
        if b < 0x80:
            moves["ok"][b] = "ok"
        elif 0xC2 <= b <= 0xDF:
            moves["ok"][b] = "one"
        elif 0xE0 <= b <= 0xEF:
            moves["ok"][b] = {0xE0: "e0", 0xED: "ed"}.get(b, "two")
        elif 0xF0 <= b <= 0xF4:
            moves["ok"][b] = {0xF0: "f0", 0xF4: "f4"}.get(b, "three")
        if 0x80 <= b <= 0xBF:
            for state, after in tail.items():
                moves[state][b] = after
            if b >= 0xA0:  # no overlong forms
                moves["e0"][b] = "one"
            else:  # no surrogates
                moves["ed"][b] = "one"
            moves["f0" if b >= 0x90 else "f4"][b] = "two"
    return moves


class Decoder:
    """Turns ids into text as they come; bytes of an unfinished character wait for the next ids.

    Broken characters become U+FFFD, as bytes.decode(errors="replace") has it.
    """

    MOVES = _utf8_moves()

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.waiting = tokens, b""

    def feed_bytes(self, ids: Iterable[int]) -> bytes:
        """The finished characters as UTF-8."""
        data = self.waiting + b"".join(map(self.tokens.__getitem__, ids))
        whole = len(data)
        for start in range(len(data) - 1, max(-1, len(data) - 4), -1):  # the last character begins here at the earliest
            if data[start] & 0xC0 != 0x80:
                state = "ok"
                for b in data[start:]:
                    state = self.MOVES[state][b] if state != "bad" else "bad"
                whole = len(data) if state in ("ok", "bad") else start
                break
        self.waiting, data = data[whole:], data[:whole]
        try:
            data.decode()
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()
        return data

    def feed(self, ids: Iterable[int]) -> str:
        return self.feed_bytes(ids).decode()

    def end_bytes(self) -> bytes:
        rest, self.waiting = self.waiting.decode("utf-8", "replace").encode(), b""
        return rest

    def end(self) -> str:
        return self.end_bytes().decode()


def _coders(shared) -> tuple[Encoder, dict[int, bytes]]:
    """This worker's encoder for a broadcast vocabulary and its pattern."""
    if shared.id not in getattr(_coders, "made", {}):
        _coders.made = {shared.id: (Encoder(shared.value[0], shared.pattern), shared.value[1])}
        gc.freeze()  # the tables hold many small tuples and no cycles
        gc.set_threshold(200_000)
    return _coders.made[shared.id]


class _Vocabulary:
    """A broadcast vocabulary (its file has a fixed size) under a name, of its content and pattern, that workers remember it by."""

    def __init__(self, spark, path: str, pattern: str = ""):
        ranks = read_ranks(path)
        self.shared, self.pattern = spark.sparkContext.broadcast((ranks, {i: b for b, i in ranks.items()})), pattern
        told = repr((sorted(ranks.items()), pattern)).encode()
        self.id = hashlib.sha256(told).hexdigest()

    @property
    def value(self):
        return self.shared.value


def _with(df: DataFrame, names: dict[str, T.DataType]) -> T.StructType:
    clash = {n.lower() for n in names}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in clash] + [T.StructField(n, t) for n, t in names.items()])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the array<int> column ids of each whole text and, if a name is given, the bytes that the ids decode to."""
    vocabulary = _Vocabulary(df.sparkSession, path, pattern)
    schema = _with(df, {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {}))
    kept = [f.name for f in schema.fields if f.name not in (ids, decoded)]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = _coders(vocabulary)
        for batch in batches:
            texts = W.as_strings(batch.column(text))
            for lo, hi in W.chunks(W.raw(texts)[1], CHUNK_BYTES):
                out = [encoder.encode(t) for t in texts[lo:hi].to_pylist()]
                columns = [batch.column(n).slice(lo, hi - lo) for n in kept] + [_lists(out)]
                if decoded:
                    columns.append(pa.array([_decoded(tokens, x) for x in out], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, *([decoded] if decoded else [])])
        encoder.forget()

    return df.mapInArrow(job, schema)


def _lists(rows: list[list[int]]) -> pa.Array:
    """Rows of ids as one list column."""
    sizes = np.fromiter(map(len, rows), np.int32, len(rows))
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


def _decoded(tokens: dict[int, bytes], ids: list[int], step: int = 1 << 16) -> bytes:
    decoder = Decoder(tokens)
    return b"".join([*(decoder.feed_bytes(ids[i : i + step]) for i in range(0, len(ids), step)), decoder.end_bytes()])


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the binary column decoded (UTF-8) of each array of ids; null ids count as none."""
    vocabulary = _Vocabulary(df.sparkSession, path)
    schema = _with(df, {decoded: T.BinaryType()})
    kept = [f.name for f in schema.fields if f.name != decoded]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = vocabulary.value[1]
            out = pa.array([_decoded(tokens, x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), out], names=[*kept, decoded])

    return df.mapInArrow(job, schema)
