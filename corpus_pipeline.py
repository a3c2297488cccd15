"""A training corpus from documents: quality, near-duplicates, repeated spans, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import jaccard, mixing, packing, quality, spans
from graphloom.llm.common import held_out, settle, small_batches, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learnt from labels that are not held out, does not reject."""
    small_batches(spark)
    ensemble = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return quality.score(docs, ensemble).filter("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated spans and without repeated runs of 50 words."""
    small_batches(spark)
    return spans.dedup(docs, words=spans.WORDS).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The runs of words that the mix takes, as often as it takes them."""
    small_batches(spark)
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of what is left stands in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near_duplicates", unlike),
    ("repeated_spans", unrepeated),
    ("source_mix", mixed),
    ("packing", packed),
]
#: Hashes, seeded selection and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages but packing over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages: where each piece stands."""
    return STAGES[-1][1](spark, prepared(spark, sf_dir), sf_dir)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages: the packed sequences of ids themselves."""
    docs = prepared(spark, sf_dir)
    return packing.sequences(docs, settle(STAGES[-1][1](spark, docs, sf_dir), "pipeline-packing"))
