"""Fingerprints of sentences: bits by majority over the words' digests, in numpy over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 200_000  # words whose digests a task remembers


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, pos, sentence): parts between . ! ? and line ends, of at least ten characters without outer blanks."""
    parts = F.filter(F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.btrim(s, F.lit(" "))), lambda s: F.length(s) >= 10)
    return docs.select(F.col(doc_id).alias("item_id"), F.posexplode(parts).alias("pos", "sentence"))


def sentence_samples(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, pos, ts, dhash, ahash, mean): of each word's MD5 the first four 16-bit parts vote on dhash, the rest on ahash; mean is the length, 255 at most."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        digests: list[bytes] = []
        for batch in batches:
            if len(places) > MEMO:
                places.clear()
                digests.clear()
            split = pc.split_pattern(batch.column(2), " ")
            told = split.flatten().dictionary_encode()
            numbers = np.zeros(len(told.dictionary) or 1, np.int64)
            for k, w in enumerate(told.dictionary.to_pylist()):
                n = places.get(w)
                if n is None:
                    n = places[w] = len(digests)
                    digests.append(hashlib.md5(w.encode()).digest())
                numbers[k] = n if w else -1
            at = numbers[told.indices.to_numpy()]
            bounds = np.concatenate([[0], np.cumsum(at >= 0)])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]
            at = at[at >= 0]
            sizes = np.minimum(255, pc.utf8_length(batch.column(2)).to_numpy()).astype(np.int16)
            parts = np.frombuffer(b"".join(digests), ">u2").reshape(-1, 8)[:, [3, 2, 1, 0, 7, 6, 5, 4]]
            known = np.ascontiguousarray(parts).view(np.uint8)
            hashes, words = np.zeros((batch.num_rows, 2), ">i8"), np.diff(bounds)
            for lo in range(0, batch.num_rows, 1024):  # the votes of some sentences at a time
                some = lo + np.flatnonzero(words[lo : lo + 1024])
                if len(some):
                    bits = np.unpackbits(known[at[bounds[lo] : bounds[min(lo + 1024, batch.num_rows)]]], axis=1)
                    first = bounds[some] - bounds[lo]
                    short = words[some].max() < 256  # eight votes, a byte each, are added at once
                    votes = np.add.reduceat(bits.view(np.uint64), first, axis=0).view(np.uint8) if short else np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                    hashes[some] = np.packbits(votes > (words[some, None] // 2).astype(votes.dtype), axis=1).view(">i8")
            hashes = hashes.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(1).cast(pa.float64()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array(sizes)],
                names=["item_id", "pos", "ts", "dhash", "ahash", "mean"],
            )

    return sentences(docs, doc_id, text).mapInArrow(job, "item_id long, pos int, ts double, dhash long, ahash long, mean smallint")
