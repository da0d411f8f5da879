"""Token counts by the whole-token shortcut.

Defined cases: null text counts as empty (0 tokens); rows with equal or null ``doc_id`` each return their
own count; an empty table gives an empty result.  Columns of the input named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import ready


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    ready(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from evidloom.llm.tokens import word_counter

        count = word_counter(vocabulary)
        for batch in texts:
            yield pd.Series([count(t) if t else 0 for t in batch], dtype="int64")

    names = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    return (
        docs.select(*names, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                    tokens("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
