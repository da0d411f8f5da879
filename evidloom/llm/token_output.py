"""Packed token matrices by best-fit decreasing.

Documents are tokenised, overlong ones are cut into pieces of one row's width without loss, and shards of a
bounded number of tokens are packed on their own: pieces in falling length, each into the open row with
the least capacity that still holds it, found in a segment tree over capacities.  Every result row is one
row of the id matrix, with cumulative segment lengths and the offsets at which positions restart.

Defined cases: null or empty text is a document of the end id alone; rows with equal or null ``doc_id`` are
packed one by one; an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import ready, write_table
from evidloom.llm.tokens import token_table

ROWS = ("sequence_id long, doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, "
        "position_resets array<int>, n_tokens int, ids binary")


class CapacityTree:
    """Segment tree over capacities 0 .. width: how many open rows are below each node."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << (width + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of a row with the least capacity of at least ``size``, taken out; or None."""
        node = self.leaves + size
        if not self.count[node]:
            # up to the first node with rows right of the path, then down its left edge
            while node > 1 and (node & 1 or not self.count[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        self._change(capacity, -1)
        return capacity, row


def best_fit_decreasing(lengths: list[int], width: int) -> list[int]:
    """Row number of every piece."""
    tree, rows, used = CapacityTree(width), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = width, used
            used += 1
        capacity, rows[i] = found
        if capacity > lengths[i]:
            tree.add(capacity - lengths[i], rows[i])
    return rows


def pack_matrix(docs: DataFrame, json_path: str, ranks_path: str, end_id: int, pad_id: int, width: int = 2048,
                shard_tokens: int = 2_000_000) -> DataFrame:
    """One row per matrix row: ``sequence_id, doc_ids, starts, cu_seqlens, position_resets, n_tokens, ids``.

    ``ids`` holds ``width`` little-endian 16-bit ids; ``starts`` are the pieces' places in their documents.
    """
    ready(docs.sparkSession)
    rows, _ = write_table(token_table(docs, json_path, ranks_path, end_id, "doc_id"), "token_rows")
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    shards = max(1, -(-total // shard_tokens))
    spread = F.pmod(F.xxhash64("doc_id", F.octet_length("ids"), "ids"), F.lit(shards)).alias("shard")
    dealt = rows.select("doc_id", "ids", spread)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "ids"], kind="stable", na_position="first")
        pieces = []
        for doc, raw in zip(part["doc_id"], part["ids"], strict=True):
            ids = np.frombuffer(raw, dtype="<u2")
            doc = None if pd.isna(doc) else int(doc)
            pieces += [(doc, at, ids[at:at + width]) for at in range(0, len(ids), width)]
        placed = best_fit_decreasing([len(p[2]) for p in pieces], width)
        held: dict[int, list] = {}
        for piece, row in zip(pieces, placed, strict=True):
            held.setdefault(row, []).append(piece)
        out = []
        for row in sorted(held):
            own = held[row]
            matrix = np.full(width, pad_id, dtype="<u2")
            edges = np.cumsum([0, *(len(p[2]) for p in own)])
            for (_, _, ids), at in zip(own, edges, strict=False):
                matrix[at:at + len(ids)] = ids
            out.append(((int(key[0]) << 32) + row, [p[0] for p in own], [p[1] for p in own], edges.tolist(),
                        edges[:-1].tolist(), int(edges[-1]), matrix.tobytes()))
        return pd.DataFrame(out, columns=["sequence_id", "doc_ids", "starts", "cu_seqlens", "position_resets",
                                          "n_tokens", "ids"])

    return dealt.groupBy("shard").applyInPandas(pack, ROWS)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Write the matrix rows as Parquet files, replacing what stands at ``path``."""
    packed.write.mode("overwrite").parquet(path)
