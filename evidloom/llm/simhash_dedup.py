"""Near-duplicate groups by SimHash, compared on vertical bit planes.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64 values (seed 42) of the text's word
shingles, repeats included.  Two fingerprints link if at most ``radius`` bits differ.  Cut into ``radius + 2`` blocks of bits,
such fingerprints agree in at least two blocks, so each fingerprint goes to one bucket for every pair of blocks and
no link is lost.  Equal fingerprints are one node from the start.

Inside a bucket the comparison is bit-sliced.  Plane ``b`` holds bit ``b`` of 64 fingerprints in each machine word; xor
with the spread bit of one fingerprint gives 64 difference bits at once, which a carry-save chain of bitwise counters adds
to 64 running distances.  The counters start so that the chain overflows just beyond the radius; overflow bits
collect in one word, and a word whose 64 lanes have all exceeded the radius is abandoned.  A task gives out a forest over
the rows it has compared, never all pairs.  Buckets of more than ``block`` fingerprints are cut into blocks, and
each pair of blocks is compared in a task of its own.

Defined cases: texts without words (null and empty ones too) have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; rows with equal ``doc_id`` are documents of their own and share the
component if their fingerprints link; a row without ``doc_id`` gets its fingerprint, links with nothing and has no
component; ids must be whole numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import delete_path, ready, spread, word_pieces, write_table
from evidloom.llm.near_dup import connected_components

BITS = 64
BLOCK = 32_768
TILE = 2048
CELLS = 1 << 16
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
# White space separates words, A-Z are folded.
SPACED = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 9 <= b <= 13 else b for b in range(256))


def fingerprint(data: bytes | None, size: int = 3) -> int:
    """Unsigned SimHash of an encoded text."""
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    total, counts, tail = 0, np.zeros(BITS, dtype=np.int64), []
    for words in word_pieces(data, SPACED):
        words = tail + words
        n = len(words) - size + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(words[i:n + i] for i in range(size)), strict=True))
            hashed = np.fromiter(map(digest, shingles), dtype="<u8", count=n)
            counts += np.unpackbits(hashed.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        tail = words[-(size - 1):] if size > 1 else []
    if not total:
        return digest(b" ".join(tail)) if tail else 0
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprints(docs: DataFrame, size: int) -> DataFrame:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(t.as_py(), size) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "simhash"])

    return docs.mapInArrow(prints, "doc_id long, simhash long")


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """``[BITS, words]``: bit ``b`` of 64 fingerprints in each word of row ``b``."""
    rows = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(len(prints), 8), axis=1, bitorder="little")
    packed = np.zeros((BITS, -(-len(prints) // 64) * 8), dtype=np.uint8)
    packed[:, :-(-len(prints) // 8)] = np.packbits(rows.T, axis=1, bitorder="little")
    return packed.view("<u8")


def within_radius(prints: np.ndarray, ends: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions ``(i, j)``, i < j < ends[i], whose fingerprints differ in at most ``radius`` bits, in portions."""
    planes = bit_planes(prints)
    mine = np.where((prints[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1), ONES, np.uint64(0))
    # a cell is one fingerprint against one word of 64 others
    at = np.arange(len(prints))
    first, last = (at + 1) >> 6, (ends - 1) >> 6
    each = np.where(ends > at + 1, last - first + 1, 0)
    upto = np.cumsum(each)
    lo = 0
    while lo < len(prints):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CELLS, side="right")))
        query = np.repeat(at[lo:hi], each[lo:hi])
        if len(query):
            start = np.cumsum(each[lo:hi]) - each[lo:hi]
            word = np.arange(len(query)) - np.repeat(start, each[lo:hi]) + first[query]
            yield from _cells(planes, mine, query, word, ends, radius)
        lo = hi


def _cells(planes: np.ndarray, mine: np.ndarray, query: np.ndarray, word: np.ndarray, ends: np.ndarray,
           radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    # lanes up to the row itself and beyond its bucket count as too far from the start
    low = np.clip(query + 1 - (word << 6), 0, 64).astype(np.uint64)
    high = np.clip(ends[query] - (word << 6), 0, 64).astype(np.uint64)
    below = np.where(low >= 64, ONES, (np.uint64(1) << (low % np.uint64(64))) - np.uint64(1))
    above = np.where(high >= 64, np.uint64(0), ONES << (high % np.uint64(64)))
    over = below | above
    places = radius.bit_length()
    begin = (1 << places) - 1 - radius
    counters = [np.full(len(query), ONES if begin >> i & 1 else np.uint64(0)) for i in range(places)]
    for b in range(BITS):
        carry = planes[b][word] ^ mine[b][query]
        for counter in counters:
            kept = counter & carry
            counter ^= carry
            carry = kept
        # a lane that has overflowed stays over, whatever its counters do then
        over |= carry
        if b % 8 == 7:
            alive = over != ONES
            if not alive.all():
                query, word, over = query[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(query):
                    return
    lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(len(over), 8), axis=1, bitorder="little")
    cell, lane = np.nonzero(lanes)
    yield query[cell], (word[cell] << 6) + lane


def forest(prints: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """For every position the least one that it is linked with over positions of its bucket, itself included."""
    root = np.arange(len(prints))
    for i, j in within_radius(prints, ends, radius):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != root[root]).any():
                root = root[root]
    return root


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` that connect what is close, of rows ``key, i, j, id, simhash`` sorted by their first three."""

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            part = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "id", "simhash")]
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            change = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
            if len(change) and len(held[0]) >= TILE:
                yield [x[:change[-1]] for x in held]
                held = [x[change[-1]:] for x in held]
        if held is not None and len(held[0]):
            yield held

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, i, j, ids, prints in tiles(batches):
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            sizes = np.diff(np.concatenate([[0], change, [len(key)]]))
            ends = np.repeat(np.cumsum(sizes), sizes)
            root = forest(prints.view(np.uint64), ends, radius)
            own = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["a", "b"])

    return rows.mapInArrow(scan, "a long, b long")


def bucket_keys(simhash: Column, radius: int) -> Column:
    """One key for each pair of the ``radius + 2`` bit blocks: a hash of the pair's number and its bits."""
    edges = [BITS * k // (radius + 2) for k in range(radius + 3)]
    keys = []
    for number, pair in enumerate(combinations(range(radius + 2), 2)):
        mask = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in pair)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(number), simhash.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def simhash_duplicates(docs: DataFrame, size: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, simhash`` (signed), ``fingerprint`` (hexadecimal), ``component_id``."""
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints, _ = write_table(_fingerprints(texts, size), "simhashes")
    groups, _ = write_table(
        prints.where("doc_id IS NOT NULL").groupBy("simhash").agg(F.min("doc_id").alias("id")), "simhash_groups")
    keyed = groups.select("id", "simhash", F.explode(bucket_keys(F.col("simhash"), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    # a row of a cut bucket meets every other block once, together with its own
    others = F.when(blocks == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), blocks - 1), lambda b: b != F.col("own")))
    met = (
        keyed.join(sizes, "key").withColumn("own", own)
        .select("key", "id", "simhash", "own", F.explode(others).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "simhash")
        .repartition(spread(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    )
    links, path = write_table(_links(met, radius).distinct(), "simhash_links")
    labels, _ = connected_components(links)
    delete_path(spark, path)
    named = groups.join(labels, "id", "left").select("simhash", F.coalesce("component", "id").alias("component"))
    digits = F.lower(F.lpad(F.hex("simhash"), 16, "0"))
    return prints.join(named, "simhash", "left").select(
        "doc_id", "simhash", digits.alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
