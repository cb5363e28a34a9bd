"""A training corpus from raw documents: quality rules, near-duplicates, personal data, mix, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.mixing import mixed_documents
from tessera.llm.near_duplicates import drop_similar
from tessera.llm.packing import cut_documents, pack_pieces
from tessera.llm.personal_data import redact
from tessera.llm.quality import judge
from tessera.llm.queries import BYTE_END, BYTE_TOKENIZER, tokenizer_path
from tessera.runtime import discard, release, scratch, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a risk-controlled cutoff rejects."""
    judged = judge(docs, table(spark, sf_dir, "labels"), whole=True)
    return judged.where("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts with four fifths of their five-word shingles in common."""
    return drop_similar(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, replaced by its kind."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and cut so that the sources meet their target weights."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their place in fixed-length sequences."""
    pieces = cut_documents(docs, tokenizer_path(BYTE_TOKENIZER), BYTE_END)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(stored(digests, "pieces"))


def _after(before: str | None, name: str, stage: Stage) -> Stage:
    """``stage``, which removes the inner tables of the one before it: this one's result is written when a stage gets it as ``docs``."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before:
            release(f"stage-{before}", docs)
        with scratch(f"stage-{name}"):
            return stage(spark, docs, sf_dir)

    return run_stage


_ORDER = [quality, near_duplicates, personal_data, mixing, packing]
STAGES = [(f.__name__, _after(b and b.__name__, f.__name__, f)) for b, f in zip([None, *_ORDER[:-1]], _ORDER, strict=True)]

#: The stages' regular expressions, fingerprints, tokens and draws have no DuckDB form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread for the next."""
    docs = table(spark, sf_dir, "documents")
    given = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if given is not None:
            discard(given)
        given = docs
    return STAGES[-1][1](spark, docs, sf_dir)
