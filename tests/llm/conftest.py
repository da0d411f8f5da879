from __future__ import annotations

import random

import pytest

SYLLABLES = ["ka", "lo", "mi", "nu", "re", "sha", "ti", "vo", "wen", "zu", "bri", "del"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows, parts=3):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(400)]
