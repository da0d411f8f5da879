"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct word shingles, as 64-bit hashes.  One permutation (a multiplier on
the hash) scatters a shingle to a slot, a second one (a permutation of all slots) is circularly shifted:
coordinate ``k`` of a signature is the least value of the second permutation at ``slot + k``.  So two
permutations give every coordinate, and a shingle's coordinates are one slice of a table.

Equal sets are collapsed first.  Candidates share a band of ``rows`` coordinates.  Only links that may
join two components are verified: first each document against one pivot of its buckets, twice more
against up to ``pivots`` others.  At last all pairs of a bucket that are still in different components are
compared by the low bytes of ``length`` coordinates, in blocks of rows inside tasks, and only those that may
reach the threshold come out, once each after a distinct, for verification.  Every candidate pair is thus either
verified, inside one component, or ruled out by size or by an estimate more than 4.5 standard
deviations below the threshold.  A pair at the threshold shares no band with a chance of
(1 - t^rows)^bands, 1.3e-6 with the defaults.

Defined cases: null or empty text and text without words have an empty set and link with nothing; rows
with equal ``doc_id`` are one document; a row without ``doc_id`` links with nothing, has no component and is
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import delete_path, ready, spread, write_table
from evidloom.session import new_table_path

SLOT_BITS = 20
BAND_BITS = 6
# Rows of a bucket, and shingles in their sets, that one task compares with as many others.
BLOCK = 2000
BLOCK_SHINGLES = 4_000_000
BATCH_WORDS = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    at = 0
    while at < len(texts):
        words: list[bytes] = []
        counts = []
        while at < len(texts) and (not counts or len(words) < BATCH_WORDS):
            own = (texts[at] or "").encode().lower().split()
            words += own
            counts.append(len(own))
            at += 1
        hashed = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else \
            np.zeros(0, dtype=np.uint64)
        weight = _mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
        n = max(0, len(words) - size + 1)
        rolled = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            rolled += hashed[i:i + n] * weight[i]
        rolled = _mix(rolled)
        lo = 0
        for count in counts:
            if count >= size:
                yield np.unique(rolled[lo:lo + count - size + 1])
            elif count:
                yield _mix((hashed[lo:lo + count] * weight[:count]).sum(keepdims=True, dtype=np.uint64)
                           + np.uint64(count))
            else:
                yield rolled[:0]
            lo += count


class Circulant:
    """Signatures of ``length`` coordinates and band keys (band number in the low bits) of shingle sets."""

    def __init__(self, bands: int, rows: int, length: int, seed: int = 11) -> None:
        if bands > 1 << BAND_BITS or bands * rows > length:
            raise ValueError("at most 64 bands, and no more coordinates than the signature has")
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.k = bands, rows, length
        slots = 1 << SLOT_BITS
        second = rng.permutation(slots).astype(np.uint32)
        circle = np.concatenate([second, second[:self.k]])
        self.slices = np.lib.stride_tricks.sliding_window_view(circle, self.k)
        self.first = np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
        self.weight = rng.integers(1 << 62, size=rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.number = np.arange(bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        slot = ((shingles * self.first) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slices[slot[:1024]].min(axis=0)
        for lo in range(1024, len(slot), 1024):
            np.minimum(out, self.slices[slot[lo:lo + 1024]].min(axis=0), out=out)
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        wide = signature[:self.bands * self.rows].astype(np.uint64).reshape(self.bands, self.rows)
        return (_mix((wide * self.weight).sum(axis=1, dtype=np.uint64)) << np.uint64(BAND_BITS)) | self.number


def _sketches(docs: DataFrame, size: int, bands: int, rows: int, length: int) -> DataFrame:
    """``id, n, h1, h2`` (the set's size and hash), band ``keys`` and the signature's low bytes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Circulant(bands, rows, length)
        for batch in batches:
            n, h1, h2, keys, low = [], [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), size):
                n.append(len(s))
                h1.append(int(_mix(s).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(_mix(s * np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64).view(np.int64)))
                signature = hasher.signature(s) if len(s) else None
                keys.append(hasher.keys(signature).view(np.int64) if len(s) else [])
                low.append((signature & 255).astype(np.uint8).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                names=["id", "n", "h1", "h2", "keys", "low_bytes"])

    return docs.mapInArrow(
        sketch, "id long, n long, h1 long, h2 long, keys array<bigint>, low_bytes binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = [s.view(np.int64) for s in shingle_sets(part.column("text").to_pylist(), size)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    return docs.mapInArrow(sets, "id long, shingles array<bigint>")


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """``id, component`` (the least id reachable) of every endpoint of ``a, b``; and the table's path.

    Alternating large and small stars: the links of a node move to its least neighbour until all
    components are stars.  Nodes with many links are split like any join key.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links, path = write_table(links, "links")
    before = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        links, new = write_table(small, "links")
        delete_path(spark, path)
        path = new
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())
        if now == before:
            break
        before = now
    labels = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels.union(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()), path


class Blocks:
    """Members of one bucket, or of two of its blocks, that a task compares by the low bytes of their signatures."""

    def __init__(self, part: dict[str, np.ndarray], length: int, percent: int) -> None:
        self.ids, self.c, self.n, self.block = (part[x] for x in ("id", "c", "n", "block"))
        # without signatures every pair of fitting sizes counts as near
        self.low = part["low"].reshape(-1, length) if "low" in part else None
        self.one_block = part["i"][0] == part["j"][0]
        self.percent = percent
        t = percent / 100
        self.least = int(np.ceil(length * (t - 4.5 * (t * (1 - t) / length) ** 0.5)))
        names, number, size = np.unique(self.c, return_inverse=True, return_counts=True)
        # members of the largest component need no comparison among themselves
        self.main = number == size.argmax()
        self.parts = len(names)

    def near(self, x: int, later: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Rows that may reach the threshold with row ``x``: ``later`` or in the largest component, and ``apart``."""
        other = apart & (self.main | later)
        if not self.one_block:
            other &= self.block != self.block[x]
        other &= np.minimum(self.n, self.n[x]) * 100 >= np.maximum(self.n, self.n[x]) * self.percent
        at = np.flatnonzero(other)
        if self.low is None or not len(at):
            return at
        return at[(self.low[at] == self.low[x]).sum(axis=1) >= self.least]

    def hopeful(self) -> np.ndarray:
        """Positions of all rows that may be close to a row of another component."""
        mark = np.zeros(len(self.ids), dtype=bool)
        for x in np.flatnonzero(~self.main):
            at = self.near(x, self.ids > self.ids[x], self.c != self.c[x])
            if len(at):
                mark[x] = True
                mark[at] = True
        return np.flatnonzero(mark)

    def links(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Verified links that join components, at most one for each component less one."""
        _, label = np.unique(self.c, return_inverse=True)
        sizes = np.array([len(s) for s in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        mark = np.zeros(len(codes), dtype=np.int64)
        for x in np.flatnonzero(~self.main):
            at = self.near(x, self.ids > self.ids[x], label != label[x])
            if not len(at):
                continue
            own = codes[ends[x] - sizes[x]:ends[x]]
            mark[own] = 1
            theirs = np.concatenate([codes[ends[y] - sizes[y]:ends[y]] for y in at])
            common = np.add.reduceat(mark[theirs], np.cumsum(sizes[at]) - sizes[at])
            mark[own] = 0
            for y in at[common * 100 >= (sizes[at] + sizes[x] - common) * self.percent]:
                if label[y] != label[x]:
                    label[label == label[y]] = label[x]
                    yield int(min(self.ids[x], self.ids[y])), int(max(self.ids[x], self.ids[y]))


def _buckets(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[dict[str, np.ndarray], pa.Table]]:
    """One bucket (or pair of blocks) at a time from rows sorted by (key, i, j)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        at = [held.column(x).to_numpy() for x in ("key", "i", "j")]
        change = [0, *(np.flatnonzero(np.any([np.diff(x) != 0 for x in at], axis=0)) + 1).tolist()]
        yield from (_part(held.slice(lo, hi - lo), columns) for lo, hi in itertools.pairwise(change))
        held = held.slice(change[-1])
    if held is not None:
        yield _part(held, columns)


def _part(table: pa.Table, columns: list[str]) -> tuple[dict[str, np.ndarray], pa.Table]:
    part = {x: table.column(x).to_numpy() for x in columns}
    if "low_bytes" in table.column_names:
        part["low"] = np.frombuffer(b"".join(table.column("low_bytes").to_pylist()), dtype=np.uint8)
    return part, table


_MET = ["key", "i", "j", "block", "id", "c", "n"]
_MET_SCHEMA = "key long, i int, j int, block int, id long, c long, n long"


def _hopeful_rows(rows: DataFrame, length: int, percent: int) -> DataFrame:
    """The rows of ``_MET_SCHEMA`` with ``low_bytes``, sorted by (key, i, j), that may be close to another one: rows, never
    pairs, and without the bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _buckets(batches, _MET):
            if len(part["id"]) > 1:
                at = Blocks(part, length, percent).hopeful()
                if len(at):
                    yield from table.select(_MET).take(pa.array(at)).combine_chunks().to_batches()

    return rows.mapInArrow(scan, _MET_SCHEMA)


def _last_links(rows: DataFrame, length: int, percent: int) -> DataFrame:
    """Verified links ``a, b`` of the same rows with their ``shingles``, enough to join what is close."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in _buckets(batches, _MET):
            if len(part["id"]) > 1:
                sets = [x.values.to_numpy(zero_copy_only=False) for x in table.column("shingles")]
                found = list(Blocks(part, length, percent).links(sets))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return rows.mapInArrow(scan, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = 50, rows: int = 5,
                    length: int = 1024, pivots: int = 8) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    sketches, _ = write_table(_sketches(texts, size, bands, rows, length), "sketches")
    filled = sketches.where("n > 0 AND id IS NOT NULL")
    groups = filled.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    firsts = filled.join(
        groups, (filled.h1 == groups.h1) & (filled.h2 == groups.h2) & (filled.id == groups.rep), "left_semi")
    bucketed = firsts.select("id", F.explode("keys").alias("key"))
    shared = bucketed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    members, members_path = write_table(bucketed.join(shared.select("key", "low"), "key"), "band_members")
    # the sets of documents that share a bucket, bucketed by id: verification moves only pairs
    wanted = members.select("id").distinct().hint("merge")
    sets_name, buckets = f"shingle_sets_{uuid.uuid4().hex}", spread(spark)
    sets_path = new_table_path(spark, sets_name)
    (_sets(texts.join(wanted, "id", "left_semi"), size).repartition(buckets, "id").write.bucketBy(buckets, "id")
     .sortBy("id").option("path", sets_path).saveAsTable(sets_name))

    def verified(pairs: DataFrame) -> tuple[DataFrame, str]:
        """Those of the distinct pairs ``a, b`` whose full sets reach the threshold, and the table's path."""
        sets = spark.table(sets_name).hint("merge")
        first = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
        both = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        both = both.where(F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * percent)
        common = F.size(F.array_intersect("sa", "sb"))
        together = F.size("sa") + F.size("sb") - common
        return write_table(both.where(common * 100 >= together * percent).select("a", "b").distinct(), "links")

    def last_links(open_rows: DataFrame) -> tuple[DataFrame, str]:
        """Links between components from all pairs of a bucket, looked at and verified inside tasks."""
        sizes = firsts.select("id", "n").dropDuplicates(["id"])
        sized, sized_path = write_table(open_rows.join(sizes, "id").select("key", "id", "c", "n"), "open_rows")
        totals = sized.groupBy("key").agg(
            F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        # a row meets every block of its bucket, its own included
        met = sized.join(totals, "key").withColumn("block", block).withColumn(
            "o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "id", "c", "n")
        met = met.join(firsts.select("id", "low_bytes").dropDuplicates(["id"]), "id").select(*_MET, "low_bytes")
        met = met.repartition(buckets, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        hopeful, hopeful_path = write_table(_hopeful_rows(met, length, percent), "hopeful_rows")
        delete_path(spark, sized_path)
        full = hopeful.join(spark.table(sets_name).hint("merge"), "id").select(*_MET, "shingles")
        full = full.repartition(buckets, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        out = write_table(_last_links(full, length, percent), "links")
        delete_path(spark, hopeful_path)
        return out

    # each document against the least pivot of its buckets
    first = members.where("low < id").groupBy("id").agg(F.min("low").alias("a"))
    found, found_path = verified(first.select("a", F.col("id").alias("b")))
    labels, label_path = connected_components(found)
    delete_path(spark, found_path)
    for step in range(3):
        named = members.select("key", "id").join(labels, "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("c"))
        # buckets that still hold several components
        split = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m"))
        open_rows = named.join(split.where("c0 < c1").select("key", "m"), "key")
        if step < 2:
            order = F.xxhash64("id", F.lit(step))
            pivot = open_rows.groupBy("key").agg(F.min_by(F.struct("id", "c"), order).alias("p"))
            pairs = (
                open_rows.join(pivot, "key").where(F.col("c") != F.col("p.c"))
                .select("id", F.col("p.id").alias("p")).groupBy("id")
                .agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("p", F.lit(step)), "p"))), 1, pivots)
                     .alias("ps"))
                .select("id", F.explode("ps.p").alias("p"))
            )
            pairs = pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
            found, found_path = verified(pairs)
        else:
            found, found_path = last_links(open_rows)
        if not found.isEmpty():
            stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
            labels, new = connected_components(stars.union(found))
            delete_path(spark, label_path)
            label_path = new
        delete_path(spark, found_path)
    delete_path(spark, members_path)
    spark.sql(f"DROP TABLE IF EXISTS {sets_name}")
    delete_path(spark, sets_path)
    own = sketches.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "h1", "h2")
    placed = (
        own.join(groups, ["h1", "h2"], "left")
        .join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left")
    )
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return placed.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
