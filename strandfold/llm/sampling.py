"""Bounded, repeatable samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandfold.llm import words as W


def labelled_rows(docs: DataFrame, label, most: int, most_bytes: int, doc_id: str = "doc_id", text: str = "text") -> pd.DataFrame:
    """At most `most` rows (doc_id, text, label), the same at each run: those whose hashed ids are least.

    docs holds the label as Column `label`; rows with a null label or text, and texts of over
    most_bytes bytes, are left out. So at most most * most_bytes bytes come to the driver.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label.alias("label"), F.octet_length(text).alias("bytes"))
    rows = rows.where("label is not null and text is not null").where(F.col("bytes") <= most_bytes)
    order = F.xxhash64("doc_id", F.lit(11))
    picked = rows.select(order.alias("at"), "doc_id").orderBy("at", "doc_id").limit(most).agg(F.max("at").alias("last"), F.count(F.lit(1)).alias("n"))
    last = picked.first()["last"]
    if last is None:
        return pd.DataFrame({"doc_id": [], "text": [], "label": []})
    return rows.where(order <= F.lit(last)).orderBy(order, "doc_id", "text").limit(most).select("doc_id", "text", "label").toPandas()


def labelled_sample(docs: DataFrame, label, most: int, most_bytes: int, doc_id: str = "doc_id", text: str = "text") -> tuple[pa.Array, list]:
    """(texts, labels) of those rows."""
    rows = labelled_rows(docs, label, most, most_bytes, doc_id, text)
    return pa.array(rows["text"].tolist(), pa.large_string()), rows["label"].tolist()


def folds(texts: pa.Array, n: int = 3, seed: int = 0) -> np.ndarray:
    """A fold for each text, told by its least shingle, so that copies and most near copies are in one."""
    least = [int(s[0]) if len(s) else 0 for _, _, codes, bounds in W.word_codes(texts) for s in W.shingle_sets(codes, bounds)]
    return (W.mix(np.array(least, np.uint64) ^ np.uint64(seed << 40)) % np.uint64(n)).astype(np.int64)
