"""A training-data pipeline over ``documents``, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexmill.llm import exact_dedup, langid, ngram_join, packing, pii
from codexmill.llm.queries import tokenizer_file
from codexmill.llm.shared import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages; without letters, or far from all profiles, they go."""
    return langid.known(docs, ~langid.held_out("doc_id", 4, 2))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the largest id; null and empty texts are equal."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a Jaccard similarity of 0.75 or more, that with the least id; rows without words all stay."""
    return ngram_join.keep_one(docs)


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and keys in texts replaced by pseudonyms; all rows and other columns stay, null texts are null."""
    hits = next(n for k in range(len(docs.columns) + 1) if (n := f"_pii{k}") not in docs.columns)
    return pii.pseudonymize(docs, pii.DEMO_KEY, hits_col=hits).drop(hits)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are packed one by one."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", hide_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language profiles, near copies, pseudonyms and tokens are beyond SQL: the tests hold run() against plain Python.
ORACLE_SQL: str | None = None
