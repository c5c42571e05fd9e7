"""Perceptual hashes of grey frames, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, HEIGHT = 27, 24
FRAME_BYTES = WIDTH * HEIGHT
REGION = "struct<dhash: long, ahash: long, mean: smallint>"
_KIND = pa.struct([("dhash", pa.int64()), ("ahash", pa.int64()), ("mean", pa.int16())])


def hashes(tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dhash, ahash, mean) of n x 8 x 9 grey tiles: falls to the right; at least the floor mean of the first eight columns."""
    tiles = tiles.astype(np.int64)
    falls = tiles[:, :, :8] > tiles[:, :, 1:]
    square = tiles[:, :, :8].reshape(-1, 64)
    mean = square.sum(axis=1) // 64
    pack = lambda bits: np.packbits(bits.reshape(-1, 64), axis=1).view(">i8").ravel().astype(np.int64)
    return pack(falls), pack(square >= mean[:, None]), mean.astype(np.int16)


def regional(frames: np.ndarray) -> tuple[tuple, tuple]:
    """Hashes of n x 24 x 27 frames shrunk by means of 3 x 3 to 8 x 9, and of their nine tiles of 8 x 9."""
    n = len(frames)
    small = frames.reshape(n, 8, 3, 9, 3).astype(np.int64).sum(axis=(2, 4)) // 9
    tiles = frames.reshape(n, 3, 8, 3, 9).transpose(0, 1, 3, 2, 4).reshape(n * 9, 8, 9)
    return hashes(small), hashes(tiles)


def frame_samples(frames: DataFrame) -> DataFrame:
    """(item_id, pos, ts, dhash, ahash, mean, regions) of (item_id, pos, ts, pixels); frames of another size than 648 bytes are dropped."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column(3)
            right = [p is not None and len(p) == FRAME_BYTES for p in pixels.to_pylist()]
            batch = batch.filter(pa.array(right))
            if not batch.num_rows:
                continue
            data = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, HEIGHT, WIDTH)
            whole, tiles = regional(data)
            flat = pa.StructArray.from_arrays([pa.array(x) for x in tiles], fields=list(_KIND))
            regions = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * 9, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x) for x in whole), regions], names=["item_id", "pos", "ts", "dhash", "ahash", "mean", "regions"])

    return frames.select("item_id", "pos", "ts", "pixels").mapInArrow(job, f"item_id long, pos int, ts double, dhash long, ahash long, mean smallint, regions array<{REGION}>")
