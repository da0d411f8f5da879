"""Corpus pipeline over ``documents``: reject toxic texts, drop repeated lines, keep one of each group of near
duplicates, reject benchmark leaks, pack the rest.

Every stage takes ``(spark, docs, sf_dir)`` and works on what the one before it kept; all but the last return
the columns of ``documents``.  A stage's defined cases are those of its operator.  Rows that a text change
leaves without a word stay, with ``n_chars`` counted anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import ready, table, write_table
from evidloom.llm.decontaminate import drop_leaks
from evidloom.llm.line_dedup import drop_repeated_lines
from evidloom.llm.mixture_pack import mixture_pack
from evidloom.llm.near_dup import near_duplicates
from evidloom.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def reject_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture_pack(docs, public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dup", dedup_documents),
    ("decontamination", reject_leaks),
    ("packing", pack),
]

# The stages learn, hash and tokenise: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; the text between them is written once to the shared folder."""
    ready(spark)
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
