"""The queries opN_<name> over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandfold.llm import bpe, embeddings, fingerprints, language, licences, lm, manifest, mixing, near_dedup, pieces, quality, toxicity, trie


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the bytes they decode to."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _crc(modulus: int):
    """crc32(doc_id as text) mod modulus; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every whole text under the corpus's own trigram model."""
    held = F.coalesce(_crc(7) == 2, F.lit(False))
    scored = lm.score(_read(spark, sf_dir, "documents"), ~held)
    base = F.col("log_counts") - F.col("n_tokens") * F.log10((F.col("n") + F.col("v") + 1).cast("double"))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.col("n").alias("train_tokens"), base.alias("base_score"), "score", "second", "third"
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that passages of the documents match."""
    return licences.scan(_read(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text."""
    found = fingerprints.edits(_read(spark, sf_dir, "documents"))
    like = fingerprints.likeness
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("fingerprint", "edited_fingerprint").alias("near_edited"), like("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.train(docs.where(_crc(5) != 0), F.col("lang"))
    return language.predict(docs.select("doc_id", "text"), net).select(
        "doc_id", F.coalesce(_crc(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def _labelled(spark: SparkSession, sf_dir: str, label: str, learnt) -> DataFrame:
    """Documents with the label of their id; of several rows of an id the greatest label counts."""
    labels = _read(spark, sf_dir, "labels").where(learnt).groupBy("doc_id").agg(F.max(label).alias(label))
    return _read(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, with the nearest examples."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.train(_labelled(spark, sf_dir, "toxic", _crc(3) != 1), F.col("toxic"), docs)
    return toxicity.score(docs, index).select(
        "doc_id", F.coalesce(_crc(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence"
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    weights = quality.train(_labelled(spark, sf_dir, "quality", _crc(4) != 2), F.col("quality"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs, weights).select(
        "doc_id", F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the text they decode to, checked against the library."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the conversations' prefix trie with what its subtree sums up."""
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof in the manifest by language, and whether tampering shows."""
    docs = _read(spark, sf_dir, "documents")
    hashed = lambda n_chars: manifest.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.when((_crc(7) == 0) & F.col("n_chars").isNotNull(), hashed(more))
    made = manifest.manifest(docs, F.col("lang"), [F.col("doc_id")], hashed(F.col("n_chars")), {"doc_id": F.col("doc_id"), "tampered": tampered})
    return made.proofs(asked="tampered").select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_mix_sources": op4_mix_sources,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op5_license_scan": licences.oracle_sql(), "op7_minhash_near_dedup": near_dedup.oracle_sql(), "op12_prefix_trie": trie.oracle_sql(), "op13_merkle_manifest": manifest.oracle_sql()}
