"""Resampling of documents towards a target distribution by hashed n-gram importance weights.

Features are all runs of 1 to ``longest`` consecutive words, joined by one space; a feature's bucket is the
CRC-32 of its UTF-8 bytes modulo ``buckets``.  The CRCs of a batch come from length-bucketed matrices: distinct
features of equal length form one two-dimensional byte array, all CRC registers of the array advance column
by column, and the buckets are scattered back to where the features stand.  Features of more than
``MATRIX_BYTES`` bytes (a text without any break is one word) would make matrices of few rows and very many
columns; their CRC, the same value, is taken whole.

The text is read once: its buckets are written, and counting and weighting read them.  With ``s`` and
``t`` the counts of a bucket among all ``S`` features of the documents and all ``T`` of the target, its gain
is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); a document's weight is the floored mean gain of
its features, and its score adds Gumbel noise drawn from a hash of its id, so the highest scores are a draw
without replacement in proportion to exp(weight / 1000).  Counts cover all documents; only one number for each
bucket, and one count for each distinct score (whole numbers, at most some 160,000 of them), reach the driver.

Defined cases: null and empty text and text without words have no features, weight 0, and are never drawn;
a null ``doc_id`` hashes as an empty id; rows with equal ``doc_id`` are documents of their own, equal scores of
equal ids are ranked in any order; an empty target leaves gains that depend on the documents alone; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidloom.llm.common import delete_path, ready, word_pieces, write_table

MATRIX_BYTES = 64
BATCH_WORDS = 200_000
# Digits, letters and everything beyond ASCII are word bytes; A-Z are folded.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 (polynomial 0xEDB88320)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    return step


STEP = crc_table()


def crc_matrices(features: list[bytes]) -> np.ndarray:
    """CRC-32 of every feature: equal lengths side by side, one byte column after the other."""
    out = np.empty(len(features), dtype=np.uint32)
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges) if len(order) else []:
        width = int(lengths[group[0]])
        if width > MATRIX_BYTES:
            out[group] = [zlib.crc32(features[i]) for i in group]
            continue
        matrix = np.frombuffer(b"".join([features[i] for i in group]), dtype=np.uint8).reshape(len(group), width)
        register = np.full(len(group), 0xFFFFFFFF, dtype=np.uint32)
        for column in matrix.T:
            register = (register >> np.uint32(8)) ^ STEP[(register & np.uint32(255)) ^ column]
        out[group] = ~register
    return out


def feature_buckets(words: list[bytes], longest: int, buckets: int, fresh: int = 0) -> np.ndarray:
    """Buckets of all features of ``words`` that end at word ``fresh`` or later."""
    features = words[fresh:]
    for n in range(2, longest + 1):
        first = max(0, fresh - n + 1)
        features = features + [b" ".join(words[i:i + n]) for i in range(first, len(words) - n + 1)]
    if not features:
        return np.zeros(0, dtype=np.uint32)
    codes, distinct = pd.factorize(np.array([*features, None], dtype=object)[:-1])
    return (crc_matrices(distinct.tolist()) % np.uint32(buckets))[codes]


def _hashed(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``doc_id, n_words, features``: the buckets of a document as little-endian 32-bit numbers."""

    def one(data: bytes | None) -> tuple[int, bytes]:
        n, parts, tail = 0, [], []
        for words in word_pieces(data, WORD_BYTES):
            n += len(words)
            parts.append(feature_buckets(tail + words, longest, buckets, len(tail)).tobytes())
            tail = (tail + words)[-(longest - 1):] if longest > 1 else []
        return n, b"".join(parts)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, found = batch.column("text").cast(pa.binary()), [], []
            at = 0
            while at < len(texts):
                # short texts share one set of matrices
                words: list[bytes] = []
                counts: list[int] = []
                while longest == 1 and at < len(texts) and len(words) < BATCH_WORDS:
                    data = texts[at].as_py() or b""
                    if len(data) > 8 * BATCH_WORDS:
                        break
                    own = data.translate(WORD_BYTES).split()
                    words += own
                    counts.append(len(own))
                    at += 1
                if counts:
                    every, lo = feature_buckets(words, 1, buckets), 0
                    for n in counts:
                        n_words.append(n)
                        found.append(every[lo:lo + n].tobytes())
                        lo += n
                else:
                    n, data = one(texts[at].as_py())
                    n_words.append(n)
                    found.append(data)
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(found, pa.binary())],
                names=["doc_id", "n_words", "features"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(hashed, f"doc_id {kind}, n_words long, features binary")


def _bucket_counts(hashed: DataFrame, buckets: int) -> np.ndarray:
    """Features in every bucket; each task sums its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for data in batch.column("features"):
                total += np.bincount(np.frombuffer(data.as_buffer(), dtype="<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())],
                                         names=["bucket", "n"])

    sums = hashed.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for row in sums.collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    size = float(len(source))
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def importance_weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000,
                       text: str = "text") -> tuple[DataFrame, str]:
    """``doc_id, n_words, n_features, weight`` of every row as a written table, and its path.

    ``docs`` has ``doc_id`` and ``text``, ``target`` has ``text``.
    """
    spark = docs.sparkSession
    ready(spark)
    own = docs.select("doc_id", F.col(text).alias("text"))
    hashed, path = write_table(_hashed(own, longest, buckets), "feature_buckets")
    wanted = _hashed(target.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")), longest, buckets)
    gains = bucket_gains(_bucket_counts(hashed, buckets), _bucket_counts(wanted, buckets))
    shared = spark.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n, weight = [], []
            for data in batch.column("features"):
                found = np.frombuffer(data.as_buffer(), dtype="<u4")
                n.append(len(found))
                weight.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                names=["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)["doc_id"]
    out = write_table(hashed.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long"), "weights")
    delete_path(spark, path)
    return out


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20,
                        longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_features, weight, score, rank`` (null where not drawn).

    Drawn are floor(percent * N / 100) of the N documents with ``min_words`` words or more, by highest score, equal
    scores by smaller id.  Ranks are places inside one score value plus the counts above it; no task sees all rows.
    """
    spark = docs.sparkSession
    weights, _ = importance_weights(docs, target, longest, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = weights.withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= min_words
    counts = rows.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
    counts.sort(key=lambda r: -r.score)
    wanted = percent * sum(r.n for r in counts) // 100
    above, places = 0, []
    for r in counts:
        if above >= wanted:
            break
        places.append((r.score, above))
        above += r.n
    out = ["doc_id", "n_features", "weight", "score"]
    if not places:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawable = able & (F.col("score") >= places[-1][0])
    ahead = spark.createDataFrame(places, "score long, above long")
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    drawn = rows.where(drawable).withColumn("place", place).join(F.broadcast(ahead), "score").select(
        *out, (F.col("above") + F.col("place")).alias("rank"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return drawn.unionByName(rows.where(~drawable).select(*out, F.lit(None).cast("long").alias("rank")))
