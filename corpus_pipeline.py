"""A corpus pipeline: toxic texts go, near copies go, repeated passages go, benchmark texts go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next stage's docs. All but the
last keep the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesselle.llm import decontamination, jaccard, packing, repeats, toxicity
from tesselle.llm.queries import TOKENIZER
from tesselle.llm.scratch import prepare, saved
from tesselle.llm.tokens import public_path

#: Words of a near-copy n-gram and the least similarity of near copies, in percent.
SHINGLE, PERCENT = 5, 80
#: SQL cannot express the stages.
ORACLE_SQL = None
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic, by models of the labelled rows among ``docs``."""
    prepare(spark)
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that links join, the row of the smallest doc_id; of repeated rows, one."""
    prepare(spark)
    return jaccard.without_copies(docs, SHINGLE, PERCENT)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the strings of 200 bytes that occur more than once."""
    prepare(spark)
    return repeats.without_repeats(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    prepare(spark)
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in sequences of tokens."""
    prepare(spark)
    return packing.pack(docs, public_path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("benchmark_decontamination", drop_benchmark),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
