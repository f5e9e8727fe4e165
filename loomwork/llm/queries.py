"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, media, mixing, neardup, pagetext, pii, quality, structure, suffixdup, toxicity, whitening
from .common import crc_mod

#: The ranked tokens of a public byte-level vocabulary; another file may be named in the environment.
TOKENIZER = os.environ.get("LOOMWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents; those with crc32(doc_id) mod 3 = 1 are held out."""
    docs = _read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.filter(~held))
    return langid.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of a document and a benchmark item that stands in it."""
    return decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated towards the target weights (rows per source ** 0.5)."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mix(docs)


def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(_read(spark, sf_dir, "pages"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from the labelled ones."""
    docs = _read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = media.media_table(_read(spark, sf_dir, "documents"))
    return t.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "sample_bits")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, read back from the formatted output."""
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(planted), TOKENIZER)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_read(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those with crc32(doc_id) mod 5 = 0 are held out."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable vectors in the coordinates of the first eight components."""
    return whitening.report(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 100 bytes that start earlier."""
    return suffixdup.remove_repeats(_read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a hash of their turns' ids and repaired."""
    rows = _read(spark, sf_dir, "conversations")
    fixed = structure.repair(structure.damage(rows))
    hashes = structure.digests(fixed.turns)
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(fixed.audits, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    out = out.join(hashes, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id,
        "op2_decontaminate": decontaminate,
        "op3_mix_sources": mix_sources,
        "op4_html_extract": html_extract,
        "op5_quality": quality_scores,
        "op6_near_duplicates": near_duplicates,
        "op7_media_columns": media_columns,
        "op8_chat_format": chat_format,
        "op9_personal_data": personal_data,
        "op10_toxicity": toxicity_scores,
        "op11_embedding_whitening": embedding_whitening,
        "op12_suffix_dedup": suffix_dedup,
        "op13_conversation_repair": conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixing.oracle(), "op8_chat_format": chat.oracle(), "op9_personal_data": pii.oracle(), "op13_conversation_repair": structure.oracle()}
