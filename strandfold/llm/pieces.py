"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the sentencepiece library.

A text is normalised as its vocabulary says (a blank in front, blanks as U+2581) and cut at every place
that no merge can reach over: where the two characters stand side by side in no piece. A segment's
characters are merged by an agenda: of all adjacent pairs that make a piece the one of the highest score
goes first, the leftmost among equals; pairs whose sides have changed meanwhile are passed over. What
is no piece falls back to its bytes. Workers remember the ids of the short segments they met; the
segments that an Arrow batch meets for the first time are also given to the library, all together, and
a difference is an error. That holds for whole texts too, since both sides take the same cuts.

Rows: null text counts as empty, an empty text has no ids and decodes to an empty text; ties and
repeated rows are encoded alike; texts of any length are encoded whole, in memory that follows the
longest run between cuts; other columns are kept (one with an output's name is replaced); an empty
table gives an empty table. Null ids decode as none.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandfold.llm import words as W
from strandfold.llm.bpe import CHUNK_BYTES, _lists, _with

BLANK = "▁"
MAX_SEGMENTS = 200_000
SHORT = 64
NEVER = 1 << 60
#: Kinds of pieces and the merge-type model, as the library's files number them (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2

codecs.register_error("strandfold.each", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A vocabulary: pieces with ids and scores, and what its texts are normalised to."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != MERGES or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies without user-defined or unused pieces")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies that keep characters and blanks as they are")
        self.model, self.first_blank = model, norm.add_dummy_prefix
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        places = {s: k for k, s in enumerate(sorted({s for s, _ in self.rank.values()}))}
        self.place = {p: places[s] for p, (s, _) in self.rank.items()}  # equal scores have equal places
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.plain = [p.piece.replace(BLANK, " ") if p.type == NORMAL else "" for p in proto.pieces]
        self.plain[self.unknown] = proto.trainer_spec.unk_surface
        long = [p for p in self.rank if len(p) > 1]
        self.beside = {p[i : i + 2] for p in long for i in range(len(p) - 1)}
        inner = any(x[1] == BLANK and x[0] != BLANK for x in self.beside)
        merging = set().union(*long)
        self.alone = "".join(c for c in map(chr, range(1, 128)) if c not in merging and c != " ")
        alone = re.escape(self.alone)
        rest = f"[^{BLANK}{alone}]+"
        one = f"|[{alone}]" if alone else ""
        self.cut = re.compile((f"(?:{BLANK}|{rest})+" if inner else f"{BLANK}*{rest}|{BLANK}+") + one).findall

    def normalised(self, text: str) -> str:
        return (BLANK if self.first_blank and text else "") + text.replace(" ", BLANK)

    def parts(self, segment: str) -> list[str]:
        """A long segment at all places where its neighbours stand together in no piece."""
        at = [0, *(i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.beside), len(segment)]
        return [segment[a:b] for a, b in zip(at, at[1:])]

    def merged(self, segment: str) -> list[str]:
        """The symbols that are left when the agenda is empty. Here it is one list, as short as the segment."""
        get, symbols = self.place.get, list(segment)
        agenda = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)  # the leftmost
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def merged_long(self, segment: str) -> list[str]:
        """The same by a heap, whose entries may be out of date."""
        rank, symbols, n = self.rank.get, list(segment), len(segment)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]

        def pair(i: int, j: int) -> tuple | None:
            found = rank(symbols[i] + symbols[j])
            return found and (found[0], i, j, len(symbols[i]) + len(symbols[j]))

        agenda = [p for i in range(n - 1) if (p := pair(i, i + 1))]
        heapify(agenda)
        while agenda:
            _, i, j, size = heappop(agenda)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one side was merged with another meanwhile
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if p := pair(i, k):
                    heappush(agenda, p)
            if (k := before[i]) >= 0 and (p := pair(k, i)):
                heappush(agenda, p)
        return [s for s in symbols if s]

    def encode(self, segment: str) -> list[int]:
        """The ids of one segment."""
        out = []
        for part in [segment] if len(segment) <= SHORT else self.parts(segment):
            for symbol in self.merged(part) if len(part) <= SHORT else self.merged_long(part):
                known = self.rank.get(symbol)
                if known:
                    out.append(known[1])
                elif self.bytes:
                    out.extend(self.bytes[b] for b in symbol.encode())
                elif not out or out[-1] != self.unknown:  # a run of unknown characters is one
                    out.append(self.unknown)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of byte pieces are read as UTF-8, each broken byte as U+FFFD; one blank in front goes."""
        out, held = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                held.append(byte)
                continue
            if held:
                out.append(held.decode("utf-8", "strandfold.each"))
                held.clear()
            out.append(self.plain[i])
        if held:
            out.append(held.decode("utf-8", "strandfold.each"))
        text = "".join(out)
        if self.first_blank and text.startswith(" "):
            first = next((i for i in ids if i in self.byte_of or self.plain[i]), None)
            if first is not None and first not in self.byte_of and first != self.unknown:
                return text[1:]
        return text


class Encoder(dict):
    """Segments and their ids; those not met since the last clearing go beyond MAX_SEGMENTS."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.older, self.new = pieces, {}, {}

    def __missing__(self, segment: str) -> list[int]:
        ids = self.older.get(segment)
        if ids is None:
            ids = self.pieces.encode(segment)
            self.new[segment] = ids
        if len(segment) <= SHORT:
            if len(self) >= MAX_SEGMENTS:
                self.older = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.pieces.cut(self.pieces.normalised(text)))))

    def check(self, library) -> None:
        """Holds the segments met since the last call against the library's own encoding of them."""
        blank, alone = self.pieces.normalised("x")[:-1], self.pieces.alone[:1]
        texts = [t for t in self.new if t != blank]  # the library puts one blank in front of any text, none in front of no text
        bare = [bool(blank) and not t.startswith(blank) for t in texts]  # stands behind a character that merges with nothing
        front = self.pieces.encode(blank) + self.pieces.encode(alone) if any(bare) else []
        asked = [(alone + t if b else t[len(blank) :]).replace(BLANK, " ") for t, b in zip(texts, bare, strict=True)]
        for text, b, ids in zip(texts, bare, library.encode(asked, num_threads=1), strict=True):
            if (front + self.new[text] if b else self.new[text]) != ids:
                raise ValueError(f"not as the library encodes it: {text[:80]!r}")
        self.new.clear()

    def forget(self) -> None:
        """Drops what was learnt from texts, at the end of a task."""
        self.clear()
        self.older, self.new = {}, {}
        W.release()


class Vocabulary:
    """A broadcast vocabulary file (a fixed size) under a name of its content, which workers remember it by."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            model = file.read()
        Pieces(model)  # an error here rather than in a task
        self.id, self.shared = hashlib.sha256(model).hexdigest(), spark.sparkContext.broadcast(model)


def _coders(vocabulary: Vocabulary):
    """This worker's encoder and the library's processor for a vocabulary."""
    if vocabulary.id not in getattr(_coders, "made", {}):
        import sentencepiece

        model = vocabulary.shared.value
        _coders.made = {vocabulary.id: (Encoder(Pieces(model)), sentencepiece.SentencePieceProcessor(model_proto=model))}
        gc.freeze()
    return _coders.made[vocabulary.id]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, check: bool = True) -> DataFrame:
    """df with the array<int> column ids of each whole text and, if a name is given, the text that the ids decode to.

    check: hold newly met segments against the library, batch by batch.
    """
    vocabulary = Vocabulary(df.sparkSession, path)
    schema = _with(df, {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {}))
    kept = [f.name for f in schema.fields if f.name not in (ids, decoded)]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, library = _coders(vocabulary)
        for batch in batches:
            texts = W.as_strings(batch.column(text))
            for lo, hi in W.chunks(W.raw(texts)[1], CHUNK_BYTES):
                out = [encoder.encode(t) for t in texts[lo:hi].to_pylist()]
                if check:
                    encoder.check(library)
                columns = [batch.column(n).slice(lo, hi - lo) for n in kept] + [_lists(out)]
                if decoded:
                    columns.append(pa.array(map(encoder.pieces.decode, out), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, *([decoded] if decoded else [])])
        encoder.forget()

    return df.mapInArrow(job, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text column decoded of each array of ids."""
    vocabulary = Vocabulary(df.sparkSession, path)
    schema = _with(df, {decoded: T.StringType()})
    kept = [f.name for f in schema.fields if f.name != decoded]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _coders(vocabulary)[0].pieces
        for batch in batches:
            out = pa.array([pieces.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), out], names=[*kept, decoded])

    return df.mapInArrow(job, schema)
