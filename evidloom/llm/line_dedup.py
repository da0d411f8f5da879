"""Line dedup on levelled sorted runs of line hashes.

A run is a table of line keys, hashed to 128 bits, bucketed and sorted by the hash.  Documents come
in batches of falling ids.  A batch is merge-joined with every run: a key that no run holds is fresh,
so this batch holds its largest document; any other key only adds to its count.  The batch then
becomes a run of level 0, and ``fanout`` runs of one level are compacted into one of the next.
Buckets of batch and runs line up, so the merge joins shuffle nothing but the batch.

Defined cases: null or empty text is one empty line; rows without a ``doc_id`` count as no document and
keep all lines; rows with equal ``doc_id`` are one document, and each row returns; an empty table gives an
empty result.  Only the columns ``doc_id`` and ``text`` are read by name, all others pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import ascii_lower, delete_path, ready, spread, strip_space, write_table
from evidloom.session import new_table_path

KEY = ["__h1", "__h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(strip_space(line))


class LineRuns:
    """Sorted runs by level; each run has columns ``__h1, __h2, docs, keeper`` with unique keys."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None) -> None:
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or spread(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_table_path(self.spark, name)
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", self.paths[name]).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of ``__h1, __h2, docs, keeper`` with unique keys, ids below those before."""
        rows = batch.repartition(self.buckets, *KEY)
        seen = F.lit(False)
        for i, name in enumerate(self._names()):
            held = self.spark.table(name).select(*KEY, F.lit(True).alias(f"__in{i}"))
            rows = rows.join(held.hint("merge"), KEY, "left")
            seen = seen | F.coalesce(F.col(f"__in{i}"), F.lit(False))
        fresh = ~seen
        self._write(rows.select(*KEY, "docs", F.when(fresh, F.col("keeper")).alias("keeper")), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            for name in old:
                self._drop(name)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """One row per key: counts add up, and the only keeper stays."""
        # read by path: a union of bucketed scans is taken as dealt by key even where it is not
        schema = self.spark.table(names[0]).schema
        rows = self.spark.read.schema(schema).parquet(*[self.paths[name] for name in names])
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys in at least ``min_docs`` documents, with the largest document."""
        return self._merged(self._names()).where(F.col("docs") >= min_docs)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self.paths.pop(name))

    def close(self) -> None:
        for name in self._names():
            self._drop(name)
        self.levels = []


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4,
                        fanout: int = 3) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; adds ``n_lines`` and ``n_dropped``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines except in the largest ``doc_id`` that holds them.
    """
    spark = docs.sparkSession
    ready(spark)
    content = F.coalesce(F.col("text"), F.lit(""))
    known = docs.select("doc_id", content.alias("text")).where(F.col("doc_id").isNotNull())
    cuts = known.agg(F.percentile_approx(
        "doc_id", [i / batches for i in range(1, batches)]).alias("c")).first()["c"] or []
    number = F.lit(batches - 1)
    for cut in sorted(set(cuts)):
        number = number - (F.col("doc_id") > cut).cast("int")
    lines = (
        known.select("doc_id", F.xxhash64("text").alias("__row"), F.posexplode(F.split("text", "\n", -1)))
        .where(F.char_length("col") >= min_chars)
        .select("doc_id", "__row", F.col("pos").alias("__pos"), line_key(F.col("col")).alias("__key"))
        .where(F.char_length("__key") >= min_chars)
        .select("doc_id", "__row", "__pos", F.xxhash64("__key").alias("__h1"),
                F.xxhash64(F.lit(1), "__key").alias("__h2"), number.alias("__batch"))
    )
    lines, _ = write_table(lines, "line_hashes", "__batch")
    runs = LineRuns(spark, fanout)
    for i in range(batches):
        part = lines.where(F.col("__batch") == i).select(*KEY, "doc_id").distinct()
        runs.add(part.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")))
    frequent, _ = write_table(runs.frequent(min_docs).select(*KEY, "keeper"), "frequent_lines")
    runs.close()
    gone = (
        lines.join(frequent, KEY).where(F.col("doc_id") != F.col("keeper"))
        .groupBy(F.col("doc_id").alias("__doc"), "__row").agg(F.collect_set("__pos").alias("__gone"))
    )
    split = (
        docs.withColumn("__row", F.xxhash64(content)).withColumn("__doc", F.col("doc_id"))
        .join(gone.hint("shuffle_hash"), ["__doc", "__row"], "left")
        .withColumn("__lines", F.split(content, "\n", -1))
    )
    numbers = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.transform(F.array_except(numbers, F.col("__gone")), lambda i: F.col("__lines")[i])
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return split.select(
        *names,
        F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
