"""A corpus pipeline of the training-data operators.

Each stage takes and returns documents (doc_id, text, lang, source, n_chars); the last
returns packed pieces.  Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import langid, linededup, mixing, neardup, packing
from claimloom.llm.common import materialize, small_batches, words_of

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents whose language is less certain than this go.
LEAST_SCORE = 0.5
#: So many ids (8 bytes each) may be sent to every task; more are joined by a shuffle.
MAX_SENT_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no certain language, go.

    Null and empty texts go, as they have no letter; a null lang or source is no reason to go, and the
    model learns nothing from it.  Long texts are scored whole.  Repeated rows stay or go alike.  An
    empty table stays empty; from a table without any label everything goes.
    """
    small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents that lose all their words so go too.

    A null text becomes an empty one and stays, as nothing was dropped.  Rows of one doc_id are one
    document; rows with a null doc_id are kept whole.  Of equal lines the smallest doc_id keeps its own.
    """
    small_batches(spark)
    kept = linededup.dedup_lines(docs)
    kept = kept.where((F.col("n_dropped") == 0) | (words_of(F.col("kept")) > 0))
    return kept.withColumns({"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest doc_id.

    Documents without words are near nothing and stay, as do rows with a null doc_id.  Repeated rows
    of a doc_id stay or go together.
    """
    small_batches(spark)
    gone = materialize(neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "dup-gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MAX_SENT_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the mix takes them, in training order.

    A copy is taken whole if the mix takes at least half of its words.  Documents without words are never
    taken.  A null source is a source of its own; ties of position go by doc_id.
    """
    return mixing.in_training_order(mixing.mix(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents; a document that is there twice is packed twice.

    A null or empty text is the end id alone; a text above the capacity is several pieces.
    """
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the table ``documents``; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
