"""Mixture-controlled packing: deficit round-robin over source queues.

Each round adds its quantum to the deficit of every source queue: the queue's share of ``window`` tokens.  A queue
then gives out whole documents while its deficit lasts, and what is left of it, hundreds of tokens before a long
document, carries over to the next round.  The documents so served are laid end to end, and the windows are cut from
that stream, so a document is cut at ends of windows only, and what is carried passes from window to window and from
partition to partition.

Nothing is packed in sequence.  A queue with quantum ``u`` has been given ``(r + 1) * u`` tokens by the end of round ``r``,
so the document that ends at token ``e`` of its queue is served in round ``ceil(e / u) - 1``, whatever the other queues
do.  Two prefix sums over narrow rows (no ids) give first ``e``, then the place in the stream ordered by round and
queue: rows are range partitioned, summed inside their partition and moved by the sums of the partitions before.

Each source whose quantum reaches one token of a window has a queue of its own; sources below that share one queue with
their summed quantum, so there are at most ``window + 1`` queues, whatever the number of sources.  A queue that runs
dry leaves its place to the others in their proportions.

Full windows need no padding; the rest of less than a window is cut into powers of two.

Defined cases: null or empty text is a document of the end id alone; a null source is a source of its
own; rows with equal or null ``doc_id`` are packed one by one; an empty table gives an empty result; a share below 1e-8
counts as none.  Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidloom.llm.common import delete_path, ready, spread, write_table
from evidloom.llm.tokens import token_table

LEAST_SHARE = 1e-8

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64())])


class Windows:
    """Sequences cut from a stream of ``total`` tokens: full windows, then powers of two."""

    def __init__(self, total: int, window: int) -> None:
        if window < 1:
            raise ValueError("window must be positive")
        self.window, self.full = window, total // window * window
        edges, left = [self.full], total - self.full
        while left:
            edges.append(edges[-1] + (1 << (left.bit_length() - 1)))
            left = total - edges[-1]
        self.edges = np.array(edges, dtype=np.int64)

    def pieces(self, place: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequence ids, offsets and starts in the document of ``length`` tokens from ``place`` on."""
        stop = place + length
        ends = np.arange((place // self.window + 1) * self.window, min(stop, self.full + 1), self.window, dtype=np.int64)
        closing = self.edges[(self.edges > max(place, self.full)) & (self.edges < stop)]
        begin = np.concatenate([np.array([place], dtype=np.int64), ends, closing])
        inside, last = begin < self.full, np.searchsorted(self.edges, begin, "right") - 1
        return (np.where(inside, begin // self.window, self.full // self.window + last),
                np.where(inside, begin % self.window, begin - self.edges[last]), begin - place)


def prefix_sums(rows: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, str]:
    """``rows`` with ``before``, the sum of ``n`` of all rows earlier in ``order``; and the path of the table behind it."""
    names = [*rows.columns, "part", "inside"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            until = done + np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(until - n)], names=names)
            done = int(until[-1]) if len(n) else done

    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, inside long"
    summed, path = write_table(ranged.mapInArrow(add, schema), "prefix_sums")
    sums = summed.groupBy("part").agg(F.sum("n").alias("s"))
    # one row a partition
    earlier = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("earlier"))
    return summed.join(F.broadcast(earlier), "part").select(
        *rows.columns, (F.col("inside") + F.col("earlier")).alias("before")), path


def mixture_pack(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 1, window: int = 2048,
                 shares: dict[str | None, float] | None = None, part_rows: int = 1_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``shares`` are target proportions by source (the corpus' own by default); a queue that runs dry
    leaves its quantum to the others.  What they leave of 1 goes to the other sources by their tokens; sources without a
    share close the pack.  ``with_ids`` adds the piece's 16-bit ids.
    """
    if shares and min(shares.values()) < 0:
        raise ValueError("shares must not be negative")
    spark = docs.sparkSession
    ready(spark)
    rows = token_table(docs.select("doc_id", "text", "source"), json_path, ranks_path, end_id,
                       "doc_id", "source")
    rows = rows.withColumn("hash", F.xxhash64("doc_id", "n", F.xxhash64("ids"))).withColumn(
        "row", F.monotonically_increasing_id())
    rows, _ = write_table(rows, "token_rows")
    by_source = rows.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    total, count = (int(x or 0) for x in by_source.agg(F.sum("n"), F.sum("m")).first())
    whole, spare = 1.0, 1.0
    given = spark.createDataFrame(list((shares or {}).items()), "name string, share double")
    if shares:
        whole, spare = max(1.0, sum(shares.values())), max(0.0, 1 - sum(shares.values()))
    found = by_source.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left")
    loose = int(found.where("share IS NULL").agg(F.sum("n")).first()[0] or 0)
    found = found.select("source", "n", F.coalesce("share", F.col("n") * spare / max(1, loose)).alias("share"))
    reaches = F.col("share") * window >= whole
    # at most ``window`` rows
    large = sorted(found.where(reaches).collect(), key=lambda r: (r["source"] is not None, r["source"]))
    others = found.where(~reaches).agg(F.sum("share")).first()[0] or 0.0
    queues = [(int(r["n"]), r["share"]) for r in large] + [(total - sum(int(r["n"]) for r in large), others)]
    # queues without a share follow after the rounds of the others
    quanta = [window * share / whole if share >= LEAST_SHARE else 0.0 for _, share in queues]
    rounds = max([int(np.ceil(n / u)) + 1 for (n, _), u in zip(queues, quanta, strict=True) if u], default=0)
    base = np.cumsum([0, *(n for n, _ in queues)]).tolist()
    parts = max(spread(spark), count // part_rows + 1)
    known = [(r["source"], i, base[i], quanta[i] or float(window), 0 if quanta[i] else rounds) for i, r in enumerate(large)]
    number = spark.createDataFrame(known, "name string, queue int, origin long, quantum double, since long")
    pool = (len(large), base[len(large)], quanta[-1] or float(window), 0 if quanta[-1] else rounds)
    queued = rows.join(F.broadcast(number), F.col("source").eqNullSafe(F.col("name")), "left").select(
        "row", "n", "hash", *(F.coalesce(c, F.lit(v)).alias(c)
                              for c, v in zip(("queue", "origin", "quantum", "since"), pool, strict=True)))
    # the place of a document's end in its queue gives its round
    in_queue, queue_path = prefix_sums(queued, ["queue", "hash", "row"], parts)
    end = F.col("before") - F.col("origin") + F.col("n")
    served = in_queue.select("row", "n", "queue", "hash", (F.col("since") + F.ceil(end / F.col("quantum")) - 1).alias("round"))
    # documents of one queue and round keep their order
    in_stream, _ = prefix_sums(served, ["round", "queue", "hash", "row"], parts)
    delete_path(spark, queue_path)
    placed = rows.select("row", "doc_id", "ids").join(
        in_stream.select("row", F.col("before").alias("place")).hint("merge"), "row")
    windows, schema = Windows(total, window), PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # small slices keep the pieces of a batch in bounded memory
            for lo in range(0, batch.num_rows, 256):
                yield from _cut(batch.slice(lo, 256), windows, schema)

    names_types = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return placed.select("doc_id", "ids", "place").mapInArrow(cut, names_types + (", ids binary" if with_ids else ""))


def _cut(batch: pa.RecordBatch, windows: Windows, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: dict[str, list] = {name: [] for name in schema.names}
    docs, places = (batch.column(c).to_pylist() for c in ("doc_id", "place"))
    for doc, ids, place in zip(docs, batch.column("ids"), places, strict=True):
        raw = np.frombuffer(ids.as_buffer(), dtype="<u2")
        wide = raw.astype("<u4").tobytes()
        seq, off, at = windows.pieces(place, len(raw))
        ends = np.append(at[1:], len(raw))
        out["doc_id"] += [doc] * len(seq)
        out["start"].append(at)
        out["length"].append(ends - at)
        out["ids_crc32"] += [zlib.crc32(wide[4 * a:4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
        out["doc_tokens"].append(np.full(len(seq), len(raw)))
        out["sequence_id"].append(seq)
        out["offset"].append(off)
        if "ids" in out:
            out["ids"] += [raw[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    flat = ("start", "length", "doc_tokens", "sequence_id", "offset")
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(v) if name in flat else v, type=schema.field(name).type)
         for name, v in out.items()], schema=schema)
