"""Text keys and written tables shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.session import new_table_path, tune

# The white space and the letters that word and line keys fold.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Characters whose Unicode lower-case form may differ from themselves, A-Z aside.
_OTHER_CASE = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Session settings; Python workers find this package, and take long texts in small batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    The built-in ``lower`` does the same wherever no other cased character stands; only the other
    texts take the slower character table.
    """
    return F.when(text.rlike(_OTHER_CASE), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def strip_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def word_array(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null text has none."""
    inner = strip_space(F.coalesce(text, F.lit("")))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def word_pieces(data: bytes | None, table: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of an encoded text, a stretch of about ``limit`` bytes at a time, so that a very long text never
    stands in memory as one list.  ``table`` maps every byte; what it maps to a space separates words."""
    at, data = 0, data or b""
    while at < len(data):
        end, step = at + limit, 4096
        piece = data[at:end].translate(table)
        while end < len(data) and not piece.endswith(b" "):
            more = data[end:end + step].translate(table)
            cut = more.find(b" ")
            piece += more if cut < 0 else more[:cut + 1]
            end += len(more) if cut < 0 else cut + 1
            step *= 2
        yield piece.split()
        at = end


def crc_mod(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the decimal id modulo ``folds``; a null id counts as remainder 1 (never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Write a frame to the shared folder; the frame that reads it, and its path."""
    spark = df.sparkSession
    path = new_table_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
