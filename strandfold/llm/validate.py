"""Choices of classifiers by cross-validation on the rows that their queries may learn from; no held-out label is read.

    python -m strandfold.llm.validate SF_DIR [language | toxicity]
"""

from __future__ import annotations

import sys
from functools import partial

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandfold.llm import language, toxicity
from strandfold.llm.queries import _crc, _labelled, _read
from strandfold.llm.sampling import folds, labelled_rows, labelled_sample

UNITS = (8, 12, 16)
POWERS = (0.0, 1.0, 2.0, 3.0)


def language_units(spark: SparkSession, sf_dir: str, most: int = language.SAMPLE) -> dict[int, tuple[int, float, int]]:
    """By number of units: (rows told rightly, sum of log10 probabilities, rows), over the sample that op8 learns from."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(_crc(5) != 0)
    texts, labels = labelled_sample(docs, F.col("lang"), most, language.SAMPLE_BYTES)
    return {h: (*language.cross_validated(texts, labels, folds(texts), h), len(labels)) for h in UNITS}


def toxicity_powers(spark: SparkSession, sf_dir: str, most: int = toxicity.SAMPLE) -> dict[float, tuple[int, int, int, int]]:
    """By power of the relevance frequency (0: plain TF-IDF): (found, toxic, alarms, clean), over the sample that op9 learns from."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = labelled_rows(_labelled(spark, sf_dir, "toxic", _crc(3) != 1), F.col("toxic"), most, toxicity.SAMPLE_BYTES)
    texts, labels = pa.array(rows["text"].tolist(), pa.large_string()), rows["label"].tolist()
    return {power: toxicity.cross_validated(texts, labels, folds(texts), docs, partial(toxicity.relevance, power=power)) for power in POWERS}


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    for name, chosen in (("toxicity", toxicity_powers), ("language", language_units)):
        if name in sys.argv[2:] or not sys.argv[2:]:
            for choice, figures in chosen(session, sys.argv[1]).items():
                print(name, choice, figures, flush=True)
