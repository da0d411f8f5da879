"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams, with fixed thresholds.

Two multinomials over ``2 ** bits`` buckets of hashed word 1-grams and 2-grams are counted in one pass: one over
trusted texts, one over the whole raw corpus.  A document's score is the mean over its n-grams of the log ratio of
their smoothed probabilities; a score under ``min_score`` rejects it, always and alike at every size.

All work is DataFrame work.  N-grams are counted and looked up as they are exploded, so the only rows that
move are bucket counts, one sum per document, and each text once to meet the ids of trusted rows in a merge join;
the bucket table has a fixed number of rows and is broadcast.  Both sides count all their texts.  Repeated word
windows are found inside the row by sorting window hashes.

Defined cases: null or empty text has no words, fails the base rule and has no score; without trusted
texts no score rejects; rows with equal ``doc_id`` are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidloom.llm.common import ready, strip_space, word_array, write_table

ROW = ["r1", "r2"]
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _grams(words: str, bits: int) -> Column:
    """Buckets of all 1-grams and 2-grams of an array of word hashes."""
    column = F.col(words)
    mask = F.lit((1 << bits) - 1).cast("long")
    pairs = F.when(F.size(column) > 1, F.zip_with(
        column, F.concat(F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))), F.array(F.lit(None).cast("long"))),
        lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b).bitwiseAND(mask))))
    return F.concat(F.transform(column, lambda w: w.bitwiseAND(mask)),
                    F.coalesce(F.array_compact(pairs), F.array().cast("array<bigint>")))


def _hashed(docs: DataFrame, *keep: Column | str) -> DataFrame:
    return docs.select(*keep, F.transform(word_array(F.col("text")), lambda w: F.xxhash64(w)).alias("words"))


def llr_model(docs: DataFrame, trusted: DataFrame, bits: int = 18, smoothing: float = 0.5) -> DataFrame:
    """``bucket, ratio``: log of trusted over raw probability, for each bucket that occurs.

    ``trusted`` holds the distinct ids of trusted rows of ``docs``, as many as there are.
    """
    # never a broadcast: the ids grow with the corpus
    marked = docs.join(trusted.select("doc_id", F.lit(1).alias("good")).hint("merge"), "doc_id", "left")
    grams = _hashed(marked, "good").select("good", F.explode(_grams("words", bits)).alias("bucket"))
    both = grams.groupBy("bucket").agg(F.count("*").alias("n_raw"), F.count("good").alias("n_trusted"))
    # written once: the sums and the ratios both read it
    both, _ = write_table(both, "gram_counts")
    sums = both.agg(F.sum("n_raw").alias("all_raw"), F.sum("n_trusted").alias("all_trusted"))
    size = float(1 << bits)

    def log_share(n: str, total: str) -> Column:
        return F.log((F.col(n) + smoothing) / (F.col(total) + smoothing * size))

    # one row of sums
    return both.crossJoin(F.broadcast(sums)).select(
        "bucket", F.when(F.col("all_trusted") > 0, log_share("n_trusted", "all_trusted") - log_share("n_raw", "all_raw"))
        .otherwise(0.0).alias("ratio"))


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(F.split(text, "\n", -1), lambda line: strip_space(line) != "")
    names = [c for c in docs.columns if not c.startswith("__")]
    # plain searches are far cheaper than the pattern, and most texts hold no symbol
    any_symbol = F.lit(False)
    for symbol in SYMBOLS:
        any_symbol = any_symbol | F.contains(text, F.lit(symbol))
    symbols = F.when(any_symbol, F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).otherwise(0)
    first = docs.select(*names, word_array(text).alias("__w"), filled.alias("__lines"),
                        symbols.alias("__sym"))
    second = first.select(
        *names, F.size("__w").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.col("__sym").cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    h = F.col("__h")
    third = second.select(
        *[c for c in second.columns if c != "__h"],
        F.when(F.size(h) >= 3, F.transform(F.sequence(F.lit(0), F.size(h) - 3),
                                           lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))).alias("__win"))
    # windows found twice or more: equal neighbours once sorted by hash, then by place
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    fourth = third.withColumn("__sorted", F.when(repeats, F.array_sort(F.transform(
        "__win", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    s = F.col("__sorted")
    fifth = fourth.withColumn("__at", F.when(s.isNotNull(), F.array_sort(F.transform(
        F.filter(F.transform(s, lambda x, i: F.struct(
            x["i"].alias("i"),
            (((i > 0) & (F.get(s, i - 1)["g"] == x["g"]))
             | F.coalesce(F.get(s, i + 1)["g"] == x["g"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"]))))
    at = F.col("__at")
    covered = F.aggregate(
        at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return fifth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        *names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_rules(docs: DataFrame, trusted: DataFrame, bits: int = 18, smoothing: float = 0.5,
                  min_score: float = -0.4, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, base counts, ``base_failed``, ``score`` and ``kept``.

    ``trusted`` has the ``doc_id`` of trusted rows; all of them are counted.
    """
    ready(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("r1"),
                        F.xxhash64(F.lit(1), "text", "doc_id").alias("r2"))
    target = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    model = llr_model(docs.select("doc_id", "text"), target, bits, smoothing)
    grams = _hashed(keyed, *ROW).select(*ROW, F.explode(_grams("words", bits)).alias("bucket"))
    # at most 2 ** bits rows; equal rows add up on both sides of the mean
    scores = grams.join(F.broadcast(model), "bucket").groupBy(*ROW).agg(F.avg("ratio").alias("score"))
    counts = base_counts(keyed).drop("text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return (
        counts.join(scores, ROW, "left").withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                (~failed & (F.coalesce("score", F.lit(0.0)) >= min_score)).alias("kept"), "score")
    )
