"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

1. Toxicity: documents predicted toxic go; the lexicon and the regression are learnt from the labels table. 2. Exact
deduplication: of equal texts the smallest id stays. 3. N-gram Jaccard join: of each group of near copies the document with
the smallest id stays. 4. Benchmark decontamination: documents with windows of two or more benchmark items go, and
the removal spans are cut out of the others. 5. BPE encoding: the token ids are added, with their number and what they
decode to.

An empty input gives an empty result at every stage. Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadlake.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from threadlake.llm.common import materialize, table
from threadlake.llm.queries import word_bpe


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    length = "n_chars" if "n_chars" in docs.columns else None
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), length_col=length)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.with_tokens(docs, word_bpe(), decoded_col="decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stage_toxicity),
    ("exact dedup", stage_exact_dedup),
    ("n-gram Jaccard join", stage_near_dedup),
    ("benchmark decontamination", stage_decontaminate),
    ("BPE encoding and decoding", stage_bpe),
]

#: SQL can express neither the first nor the last stage; tests hold run() against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
