"""Named queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from waymesh.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece model."""
    from waymesh.llm.token_counts import with_token_counts

    return with_token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), 4096)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document and the offsets of its toxic spans, as "start-end" in code points."""
    from waymesh.llm.toxicity import score_toxicity

    out = score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), mod=4, remainder=2, threshold=0.3)
    offsets = F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return out.withColumn("n_spans", F.size("spans")).withColumn("spans", F.array_join(offsets, ","))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components that they link into."""
    from waymesh.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, t=2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    from waymesh.llm.decontamination import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, licence and licence notices of every document."""
    from waymesh.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, encoded and decoded."""
    from waymesh.llm.piece_sampling import sampled_pieces

    return sampled_pieces(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), k=2, arcs=8_000_000)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    from waymesh.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), mod=3, remainder=1, threshold=0.5)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    from waymesh.llm.token_store import token_index

    return token_index(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end=2)


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    from waymesh.llm.merkle import edited_likeness

    return edited_likeness(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the leading components of all different ones, whitened; a deviation too large for 64 bits is null."""
    from waymesh.llm.whitening import whiten

    out = whiten(_table(spark, sf_dir, "embeddings"), k=4, scale=256)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of all sources takes."""
    from waymesh.llm.mixing import mix

    out = mix(_table(spark, sf_dir, "documents"), keep=("doc_id",), weights=(5, 2, 1), limit=3)
    return out.select("kept.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the manifest of all, and whether it still leads to the root after some were tampered with."""
    from waymesh.llm.manifest import verified

    return verified(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline's rows; see corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_toxicity": op1_toxicity,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_license_scan": op4_license_scan,
        "op5_html_main_text": op5_html_main_text,
        "op6_token_counts": op6_token_counts,
        "op7_piece_sampling": op7_piece_sampling,
        "op8_quality": op8_quality,
        "op9_token_ids": op9_token_ids,
        "op10_merkle_fingerprints": op10_merkle_fingerprints,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_source_mixing": op12_source_mixing,
        "op13_dataset_manifest": op13_dataset_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from waymesh.llm.licenses import scan_sql
    from waymesh.llm.manifest import verified_sql
    from waymesh.llm.mixing import mix_sql

    return {
        "op4_license_scan": scan_sql(),
        "op12_source_mixing": mix_sql(),
        "op13_dataset_manifest": verified_sql(),
    }
