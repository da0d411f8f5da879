"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact shingle similarity.

A document matches an item of ``L`` words when some window of ``L`` words of it (the whole document, if that
is shorter) has a weighted Jaccard similarity of at least ``percent`` / 100 with the item: word shingles
weigh as often as they occur, the sum of minima over the sum of maxima.

1. Anchors are document positions whose shingle stands in some item.  A window that reaches the threshold
   holds at least ``2 g p / (1 + p)`` anchors of the item among its ``g`` shingles, so only window starts
   with that many are fingerprinted.  This loses no window.
2. A 64-bit SimHash of the window's weighted shingles is cut into ``radius + 1`` blocks; two fingerprints
   within ``radius`` bits agree in a whole block, so joining on (length, block, value) finds all of them.
   At the threshold two bits differ with a chance of .172, 11 of 64 on average; the default radius of 23
   is four standard deviations beyond.
3. Candidates are verified on the full weighted shingles.

Everything is DataFrame work.  Anchors and windows are the only rows that move, but for the text of
documents that hold a window.

Defined cases: null or empty texts and items match nothing; an item under ``size`` words has one shingle,
its whole sequence; rows with equal or null ``doc_id`` are matched one by one; an empty benchmark matches
nothing.  Only ``doc_id``, ``text``, ``item_id`` are read by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import ascii_lower, ready, word_array, write_table
from evidloom.session import broadcast_if_small

ROW = ["r1", "r2"]
# Largest number of item shingles that is broadcast: some 64 MB.
BROADCAST_SHINGLES = 2_000_000


def row_key() -> list[Column]:
    """128 bits that identify a document row by id and text."""
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("r2")]


def _word_hashes(text: Column) -> Column:
    return F.transform(word_array(ascii_lower(text)), lambda w: F.xxhash64(w))


def _shingles(k: int) -> Column:
    """Hashes of all runs of ``k`` words of the column ``words``."""
    words = F.col("words")
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(0), F.size(words) - k),
        lambda i: F.xxhash64(F.lit(k), *[words[i + j] for j in range(k)]))).otherwise(
            F.array().cast("array<bigint>"))


def _marks(shingles: str) -> Column:
    """A hash per shingle and occurrence, so that weights become set membership."""
    ordered = F.col(shingles)
    return F.transform(ordered, lambda g, i: F.xxhash64(g, i - F.array_position(ordered, g)))


def simhash(marks: str) -> Column:
    column, one, none = F.col(marks), F.lit(1).cast("long"), F.lit(0).cast("long")

    def bit(b: Column) -> Column:
        ones = F.size(F.filter(column, lambda m: F.call_function("shiftright", m, b).bitwiseAND(one) == one))
        return F.when(ones * 2 > F.size(column), F.call_function("shiftleft", one, b)).otherwise(none)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda found, b: found.bitwiseOR(bit(b)))


def blocks(radius: int) -> list[tuple[int, int]]:
    """Offset and mask of ``radius + 1`` blocks of 64 bits."""
    n = radius + 1
    if not 0 <= radius < 64:
        raise ValueError("radius must lie in 0..63")
    cuts = [64 * i // n for i in range(n + 1)]
    return [(lo, (1 << (hi - lo)) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _block_rows(frame: DataFrame, radius: int) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("block"),
                      F.shiftrightunsigned("print", lo).bitwiseAND(F.lit(_signed(mask))).alias("value"))
             for i, (lo, mask) in enumerate(blocks(radius))]
    return frame.withColumn("part", F.explode(F.array(*parts))).select("*", "part.block", "part.value").drop("part")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 75,
               radius: int = 23) -> DataFrame:
    """``r1, r2, doc_id, item_id, n_windows, start, similarity`` of every document row and item that match.

    ``start`` is the first word of the best window (the earliest of equals).
    """
    spark = docs.sparkSession
    ready(spark)
    items = (
        benchmark.select("item_id", _word_hashes(F.col("text")).alias("words"))
        .where(F.size("words") > 0).withColumn("n_words", F.size("words"))
        .withColumn("k", F.least(F.lit(size), "n_words"))
    )
    sizes = sorted(r[0] for r in items.select("k").distinct().collect()) or [size]  # at most ``size`` values
    cut = F.lit(None)
    for k in sizes:
        cut = F.when(F.col("k") == k, _shingles(k)).otherwise(cut)
    items = items.select("item_id", "n_words", "k", F.array_sort(cut).alias("shingles"))
    items = items.select("*", _marks("shingles").alias("marks"))
    items = items.select("*", simhash("marks").alias("print"))
    items, _ = write_table(items, "benchmark_items")
    lists = items.select("item_id", "n_words", "k", F.explode(F.array_distinct("shingles")).alias("g"))
    lists, _ = broadcast_if_small(lists, BROADCAST_SHINGLES)
    texts = docs.select("doc_id", "text", *row_key())
    found = None
    for k in sizes:
        words = texts.select("doc_id", *ROW, _word_hashes(F.col("text")).alias("words"))
        grams = words.select("doc_id", *ROW, F.size("words").alias("n"), F.posexplode(_shingles(k)).alias("pos", "g"))
        anchors = grams.join(lists.where(F.col("k") == k), "g").select(
            "doc_id", *ROW, "n", "item_id", "n_words", "k", "pos")
        found = anchors if found is None else found.union(anchors)
    g = F.col("n_words") - F.col("k") + 1
    here = F.least(g, F.col("n") - F.col("k") + 1)
    need = F.ceil((here + g) * percent / F.lit(100 + percent)).cast("int")
    at, count = F.col("at"), F.size("at")

    def starts(i: Column) -> Column:
        low = F.greatest(F.lit(0), at[i + F.col("need") - 1] - g + 1)
        high = F.least(at[i], F.col("n") - F.col("n_words"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    spots = (
        found.groupBy("doc_id", *ROW, "n", "item_id", "n_words", "k").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        .withColumn("need", F.greatest(F.lit(1), need)).where(count >= F.col("need"))
    )
    spots = spots.select(
        *ROW, "n_words", "k",
        F.explode(F.when(F.col("n") < F.col("n_words"), F.array(F.lit(0))).otherwise(F.array_distinct(F.flatten(
            F.transform(F.sequence(F.lit(0), count - F.col("need")), starts))))).alias("start")).distinct()
    spots, _ = write_table(spots, "window_starts")
    windows = None
    for k in sizes:
        own = spots.where(F.col("k") == k)
        # the same join at every size: what is looked up grows with the corpus
        held = texts.join(own.select(*ROW).distinct().hint("merge"), ROW, "left_semi")
        held = held.select("doc_id", *ROW, _word_hashes(F.col("text")).alias("words"))
        held = held.select("doc_id", *ROW, _shingles(k).alias("all"), F.size("words").alias("n"))
        cutout = held.join(own, ROW).select(
            "doc_id", *ROW, "n_words", "k", "start",
            F.array_sort(F.slice("all", F.col("start") + 1, g)).alias("shingles"))
        windows = cutout if windows is None else windows.union(cutout)
    windows = windows.select("doc_id", *ROW, "n_words", "k", "start", _marks("shingles").alias("marks"))
    windows = windows.select("*", simhash("marks").alias("print"))
    windows, _ = write_table(windows, "windows")
    left = _block_rows(windows, radius)
    right = _block_rows(items.select("item_id", "n_words", "k", F.col("marks").alias("item_marks"), "print"), radius)
    right = right.withColumnRenamed("print", "item_print")
    differ = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(_signed(mask << lo))) == 0, F.lit(i))
                         for i, (lo, mask) in enumerate(blocks(radius))])
    near = left.join(right, ["n_words", "k", "block", "value"]).where(
        (F.bit_count(differ) <= radius) & (first == F.col("block")))
    common = F.size(F.array_intersect("marks", "item_marks"))
    together = F.size("marks") + F.size("item_marks") - common
    return (
        near.select("doc_id", *ROW, "item_id", "start", common.alias("common"), together.alias("together"))
        .where(F.col("common") * 100 >= F.col("together") * percent)
        .withColumn("similarity", F.col("common") / F.col("together"))
        .groupBy("doc_id", *ROW, "item_id")
        .agg(F.count("*").alias("n_windows"), F.min_by("start", F.struct(-F.col("similarity"), "start")).alias("start"),
             F.max("similarity").alias("similarity"))
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    # names that no column of ``docs`` has, whatever it is called
    own = ["".join(["_", *docs.columns, c]) for c in ROW]
    leaks = find_leaks(docs, benchmark, **settings).select(*ROW).distinct().toDF(*own).hint("merge")
    keys = docs.withColumns(dict(zip([f"{c}_" for c in own], row_key(), strict=True)))
    same = [F.col(f"`{c}_`") == F.col(f"`{c}`") for c in own]
    return keys.join(leaks, same[0] & same[1], "left_anti").select(*docs.columns)
