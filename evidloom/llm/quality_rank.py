"""Quality by Bradley-Terry ranking of preference pairs.

Each pair prefers a document of quality 1 to one of quality 0.  A document's strength is linear in
standardised text features; the weights minimise the logistic loss of strength differences (Bradley-Terry).
The cut is a quantile of the strengths of the training sample, the one that agrees best with its labels.
A strength at the cut maps to ``threshold``, others follow the logistic curve.

Bounds (parameters): ``max_rows`` labelled rows, ``per_row`` pairs for each of them.  All features come from
whole texts.

Defined cases: null or empty text has all counts 0; rows with equal ``doc_id`` are scored one by one; a null
``doc_id`` is never held out; with labels of one kind only, every score is ``threshold``; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import crc_mod, ready

FEATURES = 16
_ROW = re.compile(r"[^\n]+")


def text_features(text: str | None) -> list[float]:
    """Shares and logarithms that do not depend on a language."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(len(text), 1)
    letters = sum(map(str.isalpha, words))
    upper = sum(map(str.isupper, words))
    bare = len(text.translate(_SYMBOLS))
    counts = Counter(words)
    lines = _ROW.findall(text)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    repeats = sum(c - 1 for c in triples.values())
    most = max(counts.values(), default=0)
    n1 = max(n, 1)
    return [
        np.log1p(n), np.log1p(min(n, 60)), sum(map(len, words)) / n1, upper / n1, letters / n1,
        (len(text) - bare) / chars, text.count("!") / n1, text.count("|") / n1,
        sum(map(text.count, "0123456789")) / chars, sum(map(text.count, ".,;:?")) / n1,
        len(counts) / n1, most / n1, 1 - len(set(lines)) / max(len(lines), 1), repeats / n1,
        np.log1p(n / max(len(lines), 1)), sum(1 for w in words if w[-1:] in "%$&*#!") / n1,
    ]


_SYMBOLS = {ord(c): None for c in "#*$%&|<>@^~={}\\/_+"}


@dataclass
class RankModel:
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    cut: float = 0.0
    threshold: float = 0.3

    def strengths(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -6, 6)
        return np.column_stack([x, x * x]) @ self.weights

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(features), self.threshold)
        z = self.strengths(features) - self.cut + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights that minimise log(1 + exp(-(s(better) - s(worse)))) over pairs, by Newton steps."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        slope = -d.T @ p + ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_ranking(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 20_000, per_row: int = 20,
                threshold: float = 0.3) -> RankModel:
    """Learn from ``labels`` (``doc_id, quality``) of rows outside the held-out fold."""
    ready(docs.sparkSession)
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("y"))
    truth = truth.where(crc_mod(F.col("doc_id"), folds) != 0)
    truth = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @F.pandas_udf("array<double>")
    def measure(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([text_features(t) for t in texts])

    found = docs.select("doc_id", "text").join(F.broadcast(truth), "doc_id").select(
        "doc_id", measure("text").alias("x"), "y").toPandas().sort_values("doc_id", kind="stable")
    model = RankModel(threshold=threshold)
    y = found["y"].to_numpy()
    if len(set(y.tolist())) < 2:
        return model
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), FEATURES)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    z = np.column_stack([z, z * z])
    good, bad = z[y == 1], z[y == 0]
    pairs = np.arange(per_row * max(len(good), len(bad)))
    # every row of either side meets others at fixed strides
    model.weights = bradley_terry(good[pairs % len(good)], bad[(pairs + pairs // len(good)) % len(bad)])
    strengths = model.strengths(x)
    cuts = np.quantile(strengths, np.linspace(0, 1, 401))
    # balanced agreement: both kinds of error weigh as often as they occur
    agree = [np.mean((strengths >= c) == (y == 1)) for c in cuts]
    best = np.flatnonzero(np.array(agree) >= max(agree) - 1e-12)
    model.cut = float(cuts[best[len(best) // 2]])
    return model


def score_quality(docs: DataFrame, model: RankModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    ready(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            x = np.array([text_features(t) for t in texts], dtype=float).reshape(len(texts), FEATURES)
            yield pd.Series(model.scores(x), dtype="float64")

    names = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*names, score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.threshold).cast("int"))
