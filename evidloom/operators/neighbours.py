"""Approximate nearest neighbours by inverted lists.

Coarse centroids are fitted on a bounded sample of unit vectors; every vector is then filed under its nearest
centroid.  A query probes the lists of its nearest centroids, and a list meets its queries as one matrix product inside a
task.  Equal vectors are collapsed first, so a block of copies is one entry, and long lists are cut into parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.functions import vectors as V
from evidloom.operators.blocks import best_columns, half_up, unit_rows, vector_top_k
from evidloom.operators.skew import top_rows
from evidloom.session import through_table

FIT_ROWS = 20_000
MOST_LISTS = 4_096
PART_ROWS = 4_096
NEAR_ROWS = 1_024


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every row, and the product with it; ``NEAR_ROWS`` rows at a time, since the
    products of a whole batch grow with the number of lists."""
    own, most = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
    for lo in range(0, len(vectors), NEAR_ROWS):
        near = vectors[lo:lo + NEAR_ROWS] @ centroids.T
        own[lo:lo + NEAR_ROWS], most[lo:lo + NEAR_ROWS] = near.argmax(axis=1), near.max(axis=1)
    return own, most


def fit_centroids(sample: np.ndarray, lists: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids of spherical k-means; an empty cluster takes the row that is worst served."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), size=min(lists, len(sample)), replace=False)]
    for _ in range(steps):
        own, most = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(length == 0)
        if len(empty):
            worst = most.argsort()[:len(empty)]
            sums[empty[:len(worst)]], length[empty[:len(worst)]] = sample[worst], 1.0
        centroids = sums / np.where(length == 0, 1.0, length)[:, None]
    return centroids


class NeighbourIndex:
    """Inverted lists over ``chunks(chunk_id, vector)``; vectors without length are not indexed.

    ``lists`` defaults to four times the square root of the number of distinct vectors, at most ``MOST_LISTS``; the
    centroids are fitted on the ``fit_rows`` distinct vectors that a hash of the vector puts first.
    """

    def __init__(self, chunks: DataFrame, k: int = 10, lists: int | None = None, fit_rows: int = FIT_ROWS) -> None:
        self.k, self.id_type = k, dict(chunks.dtypes)["chunk_id"]
        spark = chunks.sparkSession
        v = V.as_double(F.col("vector"))
        rows = chunks.select("chunk_id", v.alias("vector")).where(V.norm(F.col("vector")) > 0)
        rows = rows.withColumn("vkey", F.xxhash64("vector"))
        # no later copy can enter a top-k through its vector
        self.copies = through_table(
            top_rows(rows, ["vkey", "vector"], [F.asc("chunk_id")], k, "copy_no"), "vector-copies")
        entries = self.copies.where("copy_no = 1").select("vkey", "chunk_id", "vector")
        self.n = entries.count()
        wanted = lists or min(MOST_LISTS, max(1, round(4 * self.n ** 0.5)))
        sample = entries.select("vector", "vkey").orderBy("vkey", "vector").limit(fit_rows).select("vector").toArrow()
        self.centroids = fit_centroids(unit_rows(sample.column("vector")), wanted) if self.n else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(self.centroids)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = nearest(unit_rows(batch.column("vector")), shared.value)[0] if batch.num_rows else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), *(batch.column(c) for c in ("vkey", "chunk_id", "vector"))],
                    names=["list", "vkey", "chunk_id", "vector"])

        filed = through_table(entries.mapInArrow(
            file, f"list int, vkey long, chunk_id {self.id_type}, vector array<double>"), "filed-vectors")
        # one row per list: at most MOST_LISTS of them
        self.sizes = through_table(filed.groupBy("list").agg(F.count(F.lit(1)).alias("size")).withColumn(
            "parts", F.ceil(F.col("size") / PART_ROWS).cast("int")), "list-sizes")
        part = F.pmod(F.col("vkey"), F.col("parts")).cast("int")
        self.filed = filed.join(F.broadcast(self.sizes), "list").select("list", part.alias("part"), "chunk_id", "vector")
        self.shared = shared

    def probes(self, queries: DataFrame, probes: int) -> DataFrame:
        """``query_id, vector, list, size, parts`` of the ``probes`` nearest lists of each query."""
        shared, kind = self.shared, dict(queries.dtypes)["query_id"]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = unit_rows(batch.column("vector")) @ shared.value.T if batch.num_rows else np.zeros((0, 1))
                rows, lists = best_columns(np.where(np.isnan(scores), -np.inf, scores), probes)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(at), batch.column("vector").take(at), pa.array(lists, pa.int32())],
                    names=["query_id", "vector", "list"])

        asked = queries.select("query_id", V.as_double(F.col("vector")).alias("vector"))
        if not self.n:
            asked = asked.limit(0)
        found = asked.mapInArrow(near, f"query_id {kind}, vector array<double>, list int")
        return found.join(F.broadcast(self.sizes), "list")

    def top_k(self, queries: DataFrame, probes: int = 8, digits: int = 6) -> DataFrame:
        """``query_id, chunk_id, score, rank``: the best ``k`` chunks of the probed lists by exact cosine."""
        kind, k = dict(queries.dtypes)["query_id"], self.k
        asks = self.probes(queries, probes).select(
            "query_id", "vector", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        schema = f"query_id {kind}, chunk_id {self.id_type}, score double"
        empty = queries.sparkSession.createDataFrame([], schema).toArrow()

        def meet(qs: pa.Table, held: pa.Table) -> pa.Table:
            if not qs.num_rows or not held.num_rows:
                return empty
            held = held.take(pc.sort_indices(held.column("chunk_id")))
            scores = half_up(unit_rows(qs.column("vector")) @ unit_rows(held.column("vector")).T, digits)
            # copies of an entry share its score, so equal scores at the border all stay
            least = np.sort(scores, axis=1)[:, -min(k, scores.shape[1])]
            rows, cols = np.nonzero(scores >= least[:, None])
            return pa.table({"query_id": qs.column("query_id").take(pa.array(rows)),
                             "chunk_id": held.column("chunk_id").take(pa.array(cols)), "score": scores[rows, cols]})

        found = asks.groupBy("list", "part").cogroup(self.filed.groupBy("list", "part")).applyInArrow(meet, schema)
        entry = self.copies.where("copy_no = 1").select(F.col("chunk_id").alias("entry"), "vkey", "vector")
        best = top_rows(found.withColumnRenamed("chunk_id", "entry"), ["query_id"], [F.desc("score"), F.asc("entry")], k, "__at")
        border = best.groupBy("query_id").agg(F.min("score").alias("border"))
        kept = found.withColumnRenamed("chunk_id", "entry").join(border, "query_id").where("score >= border").drop("border")
        named = kept.join(entry, "entry").join(self.copies.drop("copy_no"), ["vkey", "vector"])
        return top_rows(named.select("query_id", "chunk_id", "score"), ["query_id"],
                        [F.desc("score"), F.asc("chunk_id")], k)

    def candidate_share(self, queries: DataFrame, probes: int = 8) -> DataFrame:
        """One row ``candidates, pairs, share``: entries that the probed lists hold, out of all (query, entry) pairs."""
        asked = queries.where(V.norm(F.col("vector")) > 0).agg((F.count(F.lit(1)) * self.n).alias("pairs"))
        found = self.probes(queries, probes).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("candidates"))
        return found.withColumn("pairs", asked.scalar()).withColumn("share", F.col("candidates") / F.nullif(F.col("pairs"), F.lit(0)))


    def tuned_probes(self, chunks: DataFrame, queries: DataFrame, target: float = 0.95, sample: int = 256) -> int:
        """The least number of probes, doubled from two, whose recall on at most ``sample`` of the queries (the first by a
        hash of the id) reaches ``target`` against the exact search.  Vectors without structure need many."""
        some = through_table(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample), "sample-queries")
        exact = through_table(vector_top_k(chunks, some, self.k), "exact-neighbours")
        wanted, probes = exact.count(), 2
        while probes < len(self.centroids):
            hits = exact.join(self.top_k(some, probes), ["query_id", "chunk_id"], "left_semi").count()
            if hits >= target * wanted:
                break
            probes *= 2
        return min(probes, max(1, len(self.centroids)))


def approximate_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5, lists: int | None = None,
                      probes: int = 8) -> DataFrame:
    """R9 in one call; keep a :class:`NeighbourIndex` to ask it more than once."""
    return NeighbourIndex(chunks, k, lists).top_k(queries, probes)
