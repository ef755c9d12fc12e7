"""The queries that apply each operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, jaccard, license_scan, merkle, oracle, packing, quality, repeats, sharding, token_counts, topk, toxicity, url_filter
from .scratch import prepare, saved
from .tokens import public_path

TOKENIZER = "word_bpe_49k.json"
#: <|endoftext|> of that file.
END_OF_TEXT = 49407


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log weight and whether it is selected, the rows labelled of quality 1 being the target."""
    return quality.select(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the places of licence phrases and its labels."""
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds within a tenth of edits."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every query, all rows whose id is divisible by 20 being queries."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; labels of the held-out fold are not learnt from."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, counted in flat token files of all of them."""
    from pyspark.sql import functions as F

    files = saved(token_counts.token_files(_table(spark, sf_dir, "documents"), public_path(TOKENIZER), END_OF_TEXT), "tokens")
    counts = token_counts.count_tokens(files.where("content is not null"), END_OF_TEXT)
    named = files.where("doc_ids is not null").select("file_id", "first_ordinal", F.posexplode("doc_ids").alias("k", "doc_id"))
    return counts.join(named.select("file_id", (F.col("first_ordinal") + F.col("k")).alias("ordinal"), "doc_id"), ["file_id", "ordinal"], "left").select("doc_id", "file_id", "ordinal", "n_tokens", "ended")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and its component of links."""
    return jaccard.linked(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document id with its slot and shard."""
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_path(TOKENIZER))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the bytes that repeated strings of 200 bytes cover."""
    return repeats.digest(_table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict: by the written rules, else by the model of the labelled urls."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.fit(url_filter.labelled_urls(spark)))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root and proof, and whether it still holds after tampering."""
    return merkle.verified(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms are from the other sources' of its language, and the terms it has most more of."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_resampling": op1_quality_resampling,
        "op2_license_scan": op2_license_scan,
        "op3_decontamination": op3_decontamination,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_sharding": op8_sharding,
        "op9_packing": op9_packing,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
        "op11_url_filter": op11_url_filter,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force, exact round trips and held-out labels."""
    return {
        "op2_license_scan": oracle.license_sql(),
        "op4_exact_top_k": oracle.top_k_sql(),
        "op7_ngram_jaccard_join": oracle.jaccard_sql(),
        "op8_sharding": oracle.sharding_sql(),
        "op10_suffix_array_dedup": oracle.repeats_sql(),
        "op11_url_filter": oracle.url_filter_sql(),
        "op12_merkle_manifest": oracle.merkle_sql(),
        "op13_source_divergence": oracle.divergence_sql(),
    }
